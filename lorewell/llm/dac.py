"""Token ids in a binary format with random access: directly addressable codes.

An id is split into 8-bit chunks, the lowest first.  Level 0 has a chunk of every id, level k+1 those of the ids that
go on; a continuation bitmap at each level tells which, and a rank directory (ones before every 512th bit) finds a
chunk's place at the next level without decoding anything before it.

A file holds a segment of consecutive documents: 8 magic bytes, the length of a JSON header as u32, the header, then
int64 document ids, int64 document bounds, and for each level its chunks, bitmap and directory.  Numbers are
little-endian.  What follows the last level (a line end that the writer adds) is ignored.
"""

from __future__ import annotations

import array
import gc
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, id_and_text, work_path, written
from .units import Memo, UnitTable, portions

MAGIC = b"LWDAC01\n"
RANK_BITS = 512
NULL_ID = -(1 << 63)


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level."""
    out, left = [], ids.astype("<u4")
    while True:
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, dtype=bool)
        padded[: len(more)] = more
        ones = padded.reshape(-1, RANK_BITS).sum(axis=1)
        out.append(((left & 255).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)]).astype("<u4")))
        left = left[more] >> 8
        if not len(left):
            return out


def pack(ids: np.ndarray, doc_ids: np.ndarray, bounds: np.ndarray, **header) -> bytes:
    levels = encode_levels(ids)
    head = json.dumps(header | {"n_ids": len(ids), "n_docs": len(doc_ids), "levels": [len(c) for c, _, _ in levels]}).encode()
    parts = [MAGIC, len(head).to_bytes(4, "little"), head, doc_ids.astype("<i8").tobytes(), bounds.astype("<i8").tobytes()]
    return b"".join([*parts, *(x.tobytes() for level in levels for x in level)])


class DacFile:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n = int.from_bytes(data[8:12], "little")
        self.header = json.loads(data[12 : 12 + n])
        at = 12 + n

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.doc_ids = take(self.header["n_docs"], "<i8")
        self.bounds = take(self.header["n_docs"] + 1, "<i8")
        self.levels = [(take(m, "u1"), take(-(-m // 8), "u1"), take(-(-m // RANK_BITS) + 1, "<u4")) for m in self.header["levels"]]

    def __len__(self) -> int:
        return self.header["n_ids"]

    def get(self, i: int) -> int:
        """The id at a position, by one rank for each further level."""
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            inside = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i, shift = int(ranks[block]) + int(inside.sum()), shift + 8
        return value

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Ids of a range of positions, at every level only the bits and chunks of that range."""
        out = np.zeros(end - begin, dtype="<u4")
        where, shift = np.arange(end - begin), 0
        for chunks, bits, ranks in self.levels:
            if begin >= end:
                break
            out[where] |= chunks[begin:end].astype("<u4") << shift
            first = begin // RANK_BITS * RANK_BITS
            flags = np.unpackbits(bits[first // 8 : -(-end // 8)], bitorder="little").astype(bool)
            own = flags[begin - first : end - first]
            begin = int(ranks[first // RANK_BITS]) + int(flags[: begin - first].sum())
            end = begin + int(own.sum())
            where, shift = where[own], shift + 8
        return out


#: Units of letters that are certainly letters, marks that are certainly none, and single line ends: their pieces are known.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?)]*(?:\n[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?)]*)*").fullmatch
_PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+|[.,;:!?)]+|\n").findall
#: Fixed value: the letters that stand for bytes 0 to 255 in a byte-level vocabulary; printable ones stand for themselves.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


class UnitEncoder:
    """Ids of whole texts by the tokenizers library, as it gives them without special tokens around a text.

    Equal units of a batch are encoded once.  Where a unit's pieces are certain, each goes to the library's model by
    itself and is kept in a bounded table; other units, texts that can't be cut and those with the string of an added
    token go through the whole library.
    """

    def __init__(self, path: str, max_pieces: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        gc.set_threshold(100_000, 50, 1000)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        how = config.get("pre_tokenizer") or {}
        cuts = how.get("type") == "ByteLevel" and not how.get("add_prefix_space") and how.get("use_regex", True) and not config.get("normalizer")
        self.model = self.tokenizer.model
        self.pieces = Memo(max_pieces)
        added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.table = UnitTable(self._units, self._whole, added, cuts)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode("utf-8").decode("latin-1").translate(_LETTERS)
        return array.array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _units(self, units: list[str]) -> list[bytes]:
        out = list(map(self.pieces.new.get, units))
        left = [i for i, x in enumerate(out) if x is None]
        plain = [i for i in left if _PLAIN(units[i])]
        cut = [_PIECES(units[i]) for i in plain]
        distinct = list(dict.fromkeys(itertools.chain.from_iterable(cut)))
        ids = dict(zip(distinct, self.pieces.found(distinct, lambda some: list(map(self._piece, some)))))
        for i, c in zip(plain, cut):
            out[i] = ids[c[0]] if len(c) == 1 else b"".join(map(ids.__getitem__, c))
        other = [i for i in left if out[i] is None]
        if other:
            for i, e in zip(other, self.tokenizer.encode_batch_fast([units[i] for i in other], add_special_tokens=False)):
                out[i] = array.array("I", e.ids).tobytes()
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.table.encode(texts)


_ENCODERS = Kept()


def encoder(path: str) -> UnitEncoder:
    """One encoder in a worker for each file, as long as tasks use it."""
    return _ENCODERS.get(path, lambda: UnitEncoder(path))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, segment_ids: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, end it with end_id and write files in ascending order of documents.

    Rows are dealt by ranges of (id, hash of the text) and sorted, so files follow one another in that order: ids that
    are null come first, repeated ids by their text's hash.  A null or empty text is its end id alone.  A file closes
    after segment_ids ids or with a longer document.  An empty table gives no files.  Spark's own writer commits the
    files: a lost executor leaves none behind, and any store that Spark writes to will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, seq = TaskContext.get().partitionId(), 0, 0
        end = int(end_id).to_bytes(4, "little")
        docs_, ids_, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal before, seq, docs_, ids_, size
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids_])])
            data = pack(np.frombuffer(b"".join(ids_), "<u4"), np.array(docs_, dtype="<i8"), bounds, part=part, seq=seq, before=before)
            before, seq, docs_, ids_, size = before + size, seq + 1, [], [], 0
            return pa.RecordBatch.from_pydict({"data": [data]})

        for batch in batches:
            for some in portions(batch):
                enc = encoder(tokenizer_path)
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1))):
                    docs_.append(doc_id)
                    ids_.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield close()
        if docs_:
            yield close()

    rows = id_and_text(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    key = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key)
    # The text writer copies a value's bytes as they are and adds a line end, which readers of the format skip.
    dealt.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                f = DacFile(bytes(data))
                crc = []
                for a, b in itertools.pairwise(f.bounds.tolist()):
                    crc.append(zlib.crc32(f.slice(a, b).tobytes()))
                yield pd.DataFrame({"doc_id": f.doc_ids, "part": f.header["part"], "inside": f.bounds[:-1] + f.header["before"], "n_tokens": np.diff(f.bounds), "ids_crc32": np.array(crc, dtype="int64")})

    if not spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = written(files.mapInPandas(run, "doc_id long, part int, inside long, n_tokens long, ids_crc32 long"), "dac-read")
    # One total for each partition that wrote: as many as the writing job had tasks, whatever the number of documents.
    totals = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = dict(zip((p for p, _ in totals), itertools.accumulate((n for _, n in totals), initial=0)))
    bases = [starts.get(p, 0) for p in range(max(starts) + 1)]
    base = F.element_at(F.lit(bases).cast("array<long>"), F.col("part") + 1)
    doc_id = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    return found.select(doc_id.alias("doc_id"), (base + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write a table's token files (to a new path in the shared folder if none is given) and read them back."""
    spark = docs.sparkSession
    path = path or work_path(spark, "dac")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(spark, path)
