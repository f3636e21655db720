"""URL filters: rules on hosts and paths, and for the rest a ratio of character language models.

Two smoothed Markov models of variable order, one of accepted URLs and one of rejected ones, give the next character's
probability after the longest known context, each order interpolated with the one below (Witten and Bell).  A URL's
score is the difference of its log likelihoods divided by its length; the threshold is calibrated on labelled URLs that
the models haven't counted.

Counts are made over all labelled URLs by one aggregation, and the models keep every context.  They stay a table: the ratios of all grams that occur are made by joins, order by order, and each URL sums those of its
characters; nothing of the models is gathered in one place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .winnow import let

ORDER = 5
#: Most grams whose ratios are broadcast (some 40 bytes each), and the least uses of one: what most URLs have needs no shuffle.
FREQUENT_MOST = 100_000
FREQUENT_LEAST = 1000
#: Probability of any character where nothing is known.
BASE = 1 / 256
#: Quantiles of the labelled scores that are tried as thresholds.
CANDIDATES = 199


@dataclass(frozen=True)
class Rule:
    """Holds for a host and its subdomains, for paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed rules of the query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty if the url is null or lacks ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct<name, verdict> of the longest rule that holds, else null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        holds = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(holds, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def grams_of(seen: Column, order: int, shorter: bool) -> Column:
    """Grams that end at each character of a text, the end included: the longest, with `shorter` all lengths.

    The text becomes an array of characters first: substrings would count from the text's beginning each time."""
    text = F.concat(F.lit("\x02"), seen, F.lit("\x03"))

    def gram(chars: Column, i: Column, before: Column) -> Column:
        return F.array_join(F.slice(chars, i - before, before + 1), "")

    def at(chars: Column, i: Column) -> Column:
        most = F.least(F.lit(order), i - 1)
        return F.transform(F.sequence(F.lit(0), most), lambda k: gram(chars, i, k)) if shorter else gram(chars, i, most)

    found = let(F.split(text, ""), lambda chars: F.transform(F.sequence(F.lit(2), F.size(chars)), lambda i: at(chars, i)))
    return F.flatten(found) if shorter else found


def context_counts(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(context, next, accepted, rejected, uses): how often a character follows each context of up to `order` characters.

    urls: seen (what the models read), rejected (null: neither, its grams get rows all the same).  The end of a URL counts
    as a character.  uses: by all URLs."""
    rows = urls.select("rejected", F.explode(grams_of(F.col("seen"), order, True)).alias("gram"))
    sums = rows.groupBy("gram").agg(F.count_if(~F.col("rejected")).alias("accepted"), F.count_if("rejected").alias("rejected"), F.count("*").alias("uses"))
    return sums.select(F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), F.expr("right(gram, 1)").alias("next"), "accepted", "rejected", "uses")


class Models:
    """Both models in memory, for checks: for each context its counts of next characters."""

    def __init__(self, rows: list[tuple[str, str, int, int]], order: int = ORDER):
        self.order = order
        self.nodes: tuple[dict, dict] = ({}, {})
        for context, char, *counts in rows:
            for nodes, n in zip(self.nodes, counts):
                if n:
                    node = nodes.setdefault(context, [0, 0, {}])
                    node[0] += n
                    node[1] += 1
                    node[2][char] = n
        self.known: dict[str, float] = {}

    def probability(self, nodes: dict, context: str, char: str) -> float:
        p = BASE
        for k in range(len(context) + 1):
            node = nodes.get(context[len(context) - k :])
            if node is None:
                break
            total, kinds, chars = node
            p = (chars.get(char, 0) + kinds * p) / (total + kinds)
        return p

    def ratio(self, gram: str) -> float:
        """log of the rejected by the accepted model's probability of a gram's last character after the others."""
        found = self.known.get(gram)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            a, r = (self.probability(nodes, gram[:-1], gram[-1]) for nodes in self.nodes)
            found = self.known[gram] = math.log(r / a)
        return found

    def score(self, seen: str) -> float:
        """Mean log ratio of a URL's characters; above 0 it looks rejected."""
        text = "\x02" + seen + "\x03"
        return sum(self.ratio(text[max(0, i - self.order) : i + 1]) for i in range(1, len(text))) / (len(text) - 1)


def gram_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio, uses): what Models.ratio gives for each gram of context_counts."""
    nodes = counts.groupBy("context").agg(*(x for c in ("accepted", "rejected") for x in (F.sum(c).alias(f"{c}_n"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))))
    # A context has no more rows than there are characters, so neither join has a hot key.
    grams = written(counts.join(nodes, "context", "left").withColumn("gram", F.concat("context", "next")), "contexts")

    def probability(c: str, below):
        n, kinds = F.col(f"{c}_n"), F.col(f"{c}_kinds")
        return F.when(n > 0, (F.col(c) + kinds * below) / (n + kinds)).otherwise(below)

    out = last = None
    for k in range(order + 1):
        rows = grams.where(F.length("gram") == k + 1)
        if last is None:
            below = [F.lit(BASE), F.lit(BASE)]
        else:
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(last.select(F.col("gram").alias("suffix"), F.col("a").alias("below_a"), F.col("r").alias("below_r")), "suffix")
            below = [F.col("below_a"), F.col("below_r")]
        last = rows.select("gram", "uses", probability("accepted", below[0]).alias("a"), probability("rejected", below[1]).alias("r"))
        last = written(last, "probabilities")
        out = last if out is None else out.unionByName(last)
    return out.select("gram", F.log(F.col("r") / F.col("a")).alias("ratio"), "uses")


def scored(urls: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """(uid, score): mean log ratio of each URL's characters, as Models.score; urls: uid (one for each row), seen.

    Ratios are added as decimals, so that equal URLs have equal scores in whatever order their rows come.  Grams with a
    share of all uses, of which there can't be more than FREQUENT_MOST, are broadcast; no other gram has many rows."""
    ratios = ratios.select("gram", F.col("ratio").cast("decimal(18,12)").alias("ratio"), "uses")
    total = ratios.agg(F.sum("uses")).first()[0] or 0
    frequent = F.col("uses") >= max(FREQUENT_LEAST, -(-total // FREQUENT_MOST))
    rows = urls.select("uid", F.explode(grams_of(F.col("seen"), order, False)).alias("gram"))
    near = F.broadcast(ratios.where(frequent).drop("uses"))
    sums = rows.join(near, "gram").unionByName(rows.join(near, "gram", "left_anti").join(ratios.where(~frequent).drop("uses"), "gram"))
    sums = sums.groupBy("uid").agg(F.sum("ratio").alias("total"), F.count("*").alias("n"))
    return sums.select("uid", (F.col("total").cast("double") / F.col("n")).alias("score"))


def calibrated(labelled: DataFrame) -> float:
    """The threshold with the fewest errors, those of either label counted by its share: (score, rejected) rows."""
    cuts = labelled.agg(F.percentile_approx("score", [i / (CANDIDATES + 1) for i in range(1, CANDIDATES + 1)], 10_000)).first()[0]
    if not cuts:
        return 0.0
    cuts = sorted({0.0, *cuts})
    wrong = [F.avg(F.when(~F.col("rejected"), (F.col("score") > c).cast("double"))).alias(f"a{i}") for i, c in enumerate(cuts)]
    missed = [F.avg(F.when(F.col("rejected"), (F.col("score") <= c).cast("double"))).alias(f"r{i}") for i, c in enumerate(cuts)]
    r = labelled.agg(*wrong, *missed).first()
    return min(zip(cuts, range(len(cuts))), key=lambda c: ((r[f"a{c[1]}"] or 0) + (r[f"r{c[1]}"] or 0), abs(c[0])))[0]


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (the longest that holds, else null), verdict, score.

    Where a rule holds, the verdict is the rule's.  The URLs with one are the labelled ones: three quarters of them (by
    a hash of the URL) are counted by the models, the last quarter calibrates the threshold, and the other URLs are
    blocked above it.  Models read host and path.  A URL that is null, empty or without :// has neither; it is scored
    as an empty one, like any other.  Without labelled URLs every score is 0 and the verdict allow.  Repeated rows give
    repeated results, an empty table an empty result; other columns are not kept.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(url)
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "host", "path", matched(F.col("host"), F.col("path"), rules).alias("rule"), F.concat("host", "path").alias("seen"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "urls")
    held = F.crc32(F.col("seen").cast("binary")) % 4 == 3
    counted = F.when(F.col("rule").isNotNull() & ~held, F.col("rule.verdict") == "block")
    ratios = gram_ratios(context_counts(rows.select("seen", counted.alias("rejected"))))
    judged = written(rows.join(scored(rows, ratios), "uid"), "scores")
    threshold = calibrated(judged.where("rule is not null").where(held).select("score", (F.col("rule.verdict") == "block").alias("rejected")))
    by_method = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("rule.name").alias("rule"), F.coalesce("rule.verdict", by_method).alias("verdict"), "score")
