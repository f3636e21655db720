"""Texts that hold very many matches, long URLs, and languages whose rows share an id or have none."""

import re
import time

from pyspark.sql import functions as F

from lorewell.llm import langid, pii, urlfilter


def test_languages_with_null_or_single_ids(spark):
    rows = [(i, f"alpha beta gamma delta {i % 97}", "aa", "x") for i in range(2000)]
    rows += [(None, f"uno dos tres cuatro {i % 89}", "bb", "x") for i in range(2000)]
    rows += [(7, f"eins zwei drei vier {i}", "cc", "x") for i in range(2000)]
    rows += [(i, "always one text", "dd", "x") for i in range(2000)] + [(8, "one row of many", "ee", "x")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h string")
    assert langid.fit(docs, most_per_label=20, steps=1).labels == ["aa", "bb", "cc", "dd", "ee"]
    assert langid.fit(docs, most_per_label=20, most_labels=2, steps=1).labels == ["aa", "bb"]


def test_positions_and_context_of_many_matches(spark):
    kind = pii.BASE_KINDS[0]
    text = "".join(f"{'mail ' if i % 5 == 0 else ''}é{'x' * (i % 90)} a{i}@b.cd " for i in range(1500))
    got = spark.createDataFrame([(text,)], "text string").select(pii.spans_of(F.col("text"), kind).alias("s")).first().s
    want = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text):
        around = text[max(0, m.start() - pii.REACH) : m.end() + pii.REACH].lower()
        near = re.search(rf"\b(?:{kind.context})", around, re.ASCII)
        want.append(("email", m.start(), m.end(), kind.score + (kind.near if near else 0.0)))
    assert [tuple(s) for s in got] == want and len({s.score for s in got}) == 2


def seconds(action):
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def grows_little(run, small):
    """Twice the length takes at most 2.5 times the time (what a run costs at any length included)."""
    run(small)
    assert min(seconds(lambda: run(2 * small)) for _ in range(2)) <= 2.5 * min(seconds(lambda: run(small)) for _ in range(2))


def test_time_grows_with_length(spark):
    def mails(n):
        spark.createDataFrame([("a@b.cd " * n,)], "text string").select(F.size(pii.spans_of(F.col("text"), pii.BASE_KINDS[0]))).collect()

    def url(n):
        df = spark.createDataFrame([(1, "http://a.b/" + "c/d" * (n // 3), None)], "uid long, seen string, rejected boolean")
        df.select(F.size(urlfilter.grams_of(F.col("seen"), 5, True))).collect()

    grows_little(mails, 20_000)
    grows_little(url, 40_000)
