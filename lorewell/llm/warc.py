"""WARC archives with deduplicated payloads, and their index by an external merge.

Records are made by SQL functions and written by Spark's text writer, whose line end is the record separator: files
appear all at once when a task commits, in any store.  Reading parses whole records and gives one locally sorted run of
captures (URL key, timestamp, page) for each file.  The runs are cut into ranges of keys, and in each range a loser tree
merges the runs' pieces, so the parts one after the other are one globally ordered capture history.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import work_path, written

CRLF = "\r\n"
#: Records of an archive file; reading holds one file at a time.
RECORDS_PER_FILE = 2000
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RUN_SCHEMA = "urlkey string, ts string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"


def base32(hex40: Column) -> Column:
    """RFC 4648 base32 of 20 bytes given as 40 hexadecimal digits: five bytes make eight characters."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _B32)


def url_key(url: str) -> str:
    """Host labels from the last to the first, a port, then path and query in lower case: captures of a site sort
    together."""
    m = re.match(r"(?:[^:/?#]*://)?([^/?#]*)([^#]*)", url.lower(), re.S)
    host, _, port = m[1].rpartition("@")[2].partition(":")
    return ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One WARC record (without its final separator) for each of (page_id, url, html).

    Of equal payloads of at least least_bytes bytes the one with the smallest page_id is a response, and so are its
    repeated rows; the others are revisits without a payload.  The partial minimum of each digest is taken before the
    shuffle, and only digests that repeat are joined, so a payload that a third of all pages share is no hot spot.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    firsts = rows.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("sha", "first_id")
    rows = rows.join(firsts, "sha", "left")
    revisit = F.coalesce((F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    uuid = lambda c: F.regexp_replace(F.md5(F.concat(F.lit("page:"), F.coalesce(c.cast("string"), F.lit("null")))), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    # A capture's time: the tables have none, so pages count as fetched a second apart.
    ts = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid(F.col("page_id")), F.lit(">"))),
        line("WARC-Date", ts),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), uuid(F.col("first_id")), F.lit(">"))), line("X-Refers-To-Page", F.coalesce(F.col("first_id").cast("string"), F.lit(""))))).otherwise(""),
        line("X-Page", page),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Gzipped archive files of at most RECORDS_PER_FILE records below a path; offsets count unpacked bytes."""
    records(pages, least_bytes).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers with lower-case names, block, offset, length) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = end + 4
        stop = begin + int(headers["content-length"])
        yield headers, data[begin:stop], at, stop + 4 - at
        at = stop + 4


def capture(headers: dict[str, str], block: bytes, file: str, offset: int, length: int) -> tuple:
    """A row of a run; a response's size and digest are those of its payload as read."""
    kind = headers["warc-type"]
    size, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{file}: the payload at byte {offset} differs from its digest")
    page, other = headers["x-page"], headers.get("x-refers-to-page")
    ts = re.sub(r"\D", "", headers["warc-date"])
    return url_key(headers["warc-target-uri"]), ts, None if page == "null" else int(page), kind, int(other) if other else None, size, digest, file, offset, length


def sort_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def read_runs(spark, path: str) -> DataFrame:
    """The captures of all archives below a path, each file's sorted: RUN_SCHEMA and their place in the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                rows = sorted((capture(h, b, file, o, n) for h, b, o, n in parse(gzip.decompress(data))), key=sort_key)
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in RUN_SCHEMA.split(", ")])
                out["refers_to"], out["page_id"] = out["refers_to"].astype("Int64"), out["page_id"].astype("Int64")
                out["place"] = range(len(out))
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(run, RUN_SCHEMA + ", place long")


class LoserTree:
    """Merges sorted iterables: each inner node keeps the loser of its match, so the next row costs one path of
    comparisons, log2 of the number of runs."""

    def __init__(self, runs: Iterable[Iterable[tuple]], key=sort_key):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.n = len(self.runs)
        self.heads: list = [self._next(i) for i in range(self.n)]
        self.losers = [-1] * max(self.n, 1)
        for i in range(self.n):
            self._replay(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, i: int, j: int) -> bool:
        """Equal keys come in the order of the runs; a run that has ended loses."""
        a, b = self.heads[i], self.heads[j]
        return b is None or (a is not None and a[:2] < b[:2])

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.n) // 2
        while node > 0:
            loser = self.losers[node]
            if loser < 0:  # the other side hasn't played yet
                self.losers[node] = winner
                return
            if self._beats(loser, winner):
                self.losers[node], winner = winner, loser
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.n and (head := self.heads[i := self.losers[0]]) is not None:
            yield head[2]
            self.heads[i] = self._next(i)
            self._replay(i)


def merged(runs: DataFrame) -> DataFrame:
    """The globally ordered capture history: RUN_SCHEMA, part and place; by (part, place) captures are in order of URL
    key, time and page, null pages first.  Ranges are cut by the whole key, so a site with very many captures spreads.
    """
    names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, pieces = TaskContext.get().partitionId(), {}
        for pdf in batches:
            for file, rows in pdf.groupby("file", sort=False):
                pieces.setdefault(file, []).append(rows)
        loaded = [[tuple(None if pd.isna(v) else v for v in r) for p in pieces[f] for r in p[names].itertuples(index=False)] for f in sorted(pieces)]
        pieces.clear()
        out, place = [], 0
        for row in LoserTree(loaded):
            out.append((*row, part, place))
            place += 1
            if len(out) >= 5000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*names, "part", "place"])
        out["refers_to"], out["page_id"] = out["refers_to"].astype("Int64"), out["page_id"].astype("Int64")
        return out

    ranged = runs.repartitionByRange("urlkey", "ts", "page_id", "file").sortWithinPartitions("file", "place")
    return ranged.mapInPandas(run, RUN_SCHEMA + ", part int, place long")


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of (page_id, url, html), read the archives back and merge their runs.

    Per row: page_id, payload_bytes, payload_digest (SHA-1 in base32), record_type, refers_to, urlkey, ts, part and place
    in the history.  A null html is an empty payload, a null url an empty target.  Repeated rows of the smallest id stay
    responses; a null id never is the one that others refer to, its rows are responses if no other id has the payload.
    An empty table gives an empty result; other columns are not kept.
    """
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    write_warc(own, path, least_bytes)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "part", "place"]
    if not spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").take(1):
        return spark.createDataFrame([], RUN_SCHEMA + ", part int, place long").select(*columns)
    return merged(written(read_runs(spark, path), "runs", True)).select(*columns)
