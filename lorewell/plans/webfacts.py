"""Web facts (C11, T03, K17): labelled documents as facts; the checking SQL is written by hand, step by step.

A document stages a fact; its number says which evidence, source and validity it has, and when it is promoted, scoped,
looked at and asked for again.  The first of three facts makes a claim about its document's source, the others one about
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import linear, rank, web, webfacts
from lorewell.sources.tables import read
from lorewell.streaming.facts import transitions_of_files
from lorewell.streaming.ingest import shared_path

START, STEP = 1_700_000_000, 600
#: Hours after its staging at which something happens to a fact; the rest depends on when it is looked at.
FIXED = (("promote", 1), ("workspace", 2), ("global", 3))


def fact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = read(spark, sf_dir, "documents").join(labels, "doc_id")
    i = F.col("doc_id")
    ids = F.array(F.expr("cast(array() as array<string>)"), F.array(F.lit("a")), F.array(F.lit("a"), F.lit(" a ")), F.array(F.lit("a"), F.lit("b")))
    staged = {
        "evidence": F.element_at(ids, (i % 4 + 1).cast("int")),
        "confidence": 0.55 + (i % 8) * 0.05,
        "has_source": i % 5 != 0,
        "approved": F.coalesce(F.col("toxic") == 1, F.lit(False)),
        "ttl_hours": F.when(i % 3 == 1, 24.0).when(i % 3 == 2, F.lit(0.0)),
        "claim_key": F.when(i % 3 == 0, F.col("source")).otherwise(F.concat(F.lit("own "), i.cast("string"))),
        "claim_value": F.col("lang"),
    }
    look = i % 100 + 20
    hours = [("stage", F.lit(0)), *((op, F.lit(h)) for op, h in FIXED), ("evaluate", look), ("revalidate", look + 1), ("promote", look + 2), ("evaluate", look + 60)]
    steps = F.array(*(F.struct(F.lit(n).cast("long").alias("seq"), F.lit(op).alias("op"), h.cast("long").alias("hour")) for n, (op, h) in enumerate(hours)))
    rows = docs.select(i.alias("fact_id"), (F.lit(START) + i * STEP).alias("base"), *(v.alias(k) for k, v in staged.items()), F.explode(steps).alias("s"))
    rows = rows.where("not (s.op = 'revalidate' and fact_id % 4 = 1) and not (s.seq = 6 and fact_id % 2 = 1)")
    none = F.lit(None).cast("string")
    rows = rows.select("fact_id", (F.col("base") + F.col("s.hour") * 3600).alias("at"), "s.seq", "s.op", *staged, *(none.alias(c) for c in ("state", "tier", "lifecycle", "reason")))
    return webfacts.with_conflicts(rows)


def c11_promotion_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact at the end of its events."""
    found = webfacts.latest(webfacts.transitions(fact_events(spark, sf_dir)))
    return found.select("fact_id", "state", "tier", "approval_reason", F.col("n_moves").cast("long").alias("n_moves"), "last_move", F.col("approved_at").cast("string").alias("approved_at"))


def t03_ttl_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness after each look and each request."""
    found = webfacts.transitions(fact_events(spark, sf_dir)).where("op in ('evaluate', 'revalidate')")
    return found.select("fact_id", "seq", "op", "lifecycle", "freshness_reason", *(F.col(c).cast("string").alias(c) for c in ("validated_at", "asked_at")), "changed")


def t03_fact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream with timers; where time made a fact stale that nobody looked at."""
    path = shared_path(spark, "fact-events")
    fact_events(spark, sf_dir).repartitionByRange(4, "at").sortWithinPartitions("at").write.parquet(path)
    found = transitions_of_files(spark, path, f"{path}-out", f"{path}-state", files_at_once=1000)
    return found.where("op = 'expire'").select("fact_id", "at", "lifecycle", "freshness_reason", "validated_at")


def k17_promoted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the facts that make them and what contradicts them, by classes of equal claims."""
    claims = fact_events(spark, sf_dir).where("op = 'stage'")
    return webfacts.claim_classes(claims).select("claim_key", "claim_value", "n_facts", "first_fact", "since", "n_conflicting", F.col("conflict_from").cast("string").alias("conflict_from"))


def seconds(ts: str) -> Column:
    """A time as the nearest whole second since 1970, halves to the even one."""
    return F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).cast("long")


def web_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as requests, pages as evidence that was fetched, one an hour from the first event on."""
    e = read(spark, sf_dir, "events")
    start = e.agg(F.min(seconds("ts"))).first()[0] or 0
    query = F.concat(F.lit("q"), (F.col("user_id") % 50).cast("string"))
    sensitive = F.col("event_type") == "purchase"
    variants = F.when(sensitive, F.array(query, F.concat(query, F.lit(" latest")))).otherwise(F.array(query))
    requests = e.select(F.col("event_id").alias("request_id"), query.alias("query"), seconds("ts").alias("at"), sensitive.alias("sensitive"), variants.alias("variants"), "user_id")
    return requests, read(spark, sf_dir, "pages").select(F.concat(F.lit("q"), (F.col("page_id") % 60).cast("string")).alias("query"), F.col("page_id").alias("evidence_id"), (F.lit(start) + F.col("page_id") * 3600).alias("fetched_at"))


def t06_cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = web.cached_at(*web_requests(spark, sf_dir))
    return found.select("request_id", "cached", web.enough().alias("from_cache"))


def k18_fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is appended by a stream, batch by batch."""
    requests, evidence = web_requests(spark, sf_dir)
    failed = F.when(F.col("user_id") % 7 == 0, "timeout")
    outcomes = requests.select("request_id", F.explode("variants").alias("query_variant"), (F.col("user_id") % 4).alias("n_results"), failed.alias("error")).where("n_results <> 3 or error is not null")
    path = shared_path(spark, "fetch-log")
    web.fetch_log(requests, evidence, outcomes).write.parquet(f"{path}-in")
    stream = spark.readStream.schema(web.LOG).option("maxFilesPerTrigger", 4).parquet(f"{path}-in")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-state").foreachBatch(lambda batch, n: web.appended(batch, n, path)).start().awaitTermination()
    return spark.read.schema(web.LOG).parquet(path).select("request_id", "query_variant", "status", F.col("http_status").cast("string").alias("http_status"), "error", "result_count")


def l07_web_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts and pages with the most words of each query, as the web lane orders them."""
    events = fact_events(spark, sf_dir)
    path = shared_path(spark, "web-facts")
    events.write.parquet(path)
    events = spark.read.parquet(path)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id"), "text")
    told = events.groupBy("fact_id").agg(F.max("conflict").alias("contradicted"), F.max("confidence").alias("confidence"))
    known = webfacts.latest(webfacts.transitions(events)).select("fact_id", "state", "tier", "lifecycle").join(told, "fact_id")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), rank.words(F.col("text")).alias("features"))
    rows = docs.join(told.select("fact_id"), "fact_id").select(F.col("fact_id").alias("row_id"), F.col("fact_id").alias("tie"), rank.words(F.col("text")).alias("features"))
    facts = linear.linear_top_k(rows, asked, 3).select("query_id", F.col("row_id").alias("fact_id")).join(known, "fact_id")
    pages = read(spark, sf_dir, "pages")
    texts = pages.select(F.col("page_id").alias("row_id"), F.col("page_id").alias("tie"), rank.words(F.regexp_replace("html", "<[^>]*>", " ")).alias("features"))
    trust = F.when(F.startswith("url", F.lit("https://")), 0.7).otherwise(0.6)
    source = F.regexp_extract("url", "://([^/?#]*)", 1)
    found = linear.linear_top_k(texts, asked, 4).select("query_id", F.col("row_id").alias("evidence_id"))
    evidence = found.join(pages.select(F.col("page_id").alias("evidence_id"), trust.alias("trust"), source.alias("source_id")), "evidence_id")
    scores = [F.round(c, 6).alias(c) for c in ("semantic_score", "trust_score", "contradiction_risk")]
    return web.web_hits(facts, evidence, 6).select("query_id", "id", "place", *scores, "cluster_id")


QUERIES = {f.__name__: f for f in (t06_cache_reuse, k18_fetch_log, l07_web_memory, c11_promotion_state, t03_ttl_revalidation, t03_fact_stream, k17_promoted_facts)}

_FACTS = """
WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id AS fact_id, 1700000000 + d.doc_id * 600 AS base, d.doc_id % 4 AS e, 0.55 + (d.doc_id % 8) * 0.05::DOUBLE AS conf, d.doc_id % 5 <> 0 AS src, coalesce(toxic = 1, false) AS approved,
 CASE WHEN d.doc_id % 3 = 1 THEN 24 ELSE 72 END AS ttl, d.doc_id % 100 + 20 AS look, CASE WHEN d.doc_id % 3 = 0 THEN source ELSE 'own ' || d.doc_id END AS k, lang AS v FROM documents d JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT a.fact_id, min(greatest(a.base, b.base)) AS since FROM f a JOIN f b ON a.k = b.k AND a.v <> b.v GROUP BY a.fact_id),
p AS (SELECT f.*, coalesce(since, 9000000000000) AS since, approved OR (e = 3 AND conf >= 0.7 AND src) AS good, CASE e WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n FROM f LEFT JOIN c ON c.fact_id = f.fact_id),
w AS (SELECT *, conf >= 0.6 AND n >= 1 AND src AND base + 7200 < since AS work FROM p),
g AS (SELECT *, work AND good AND conf >= 0.8 AND n >= 2 AND base + 10800 < since AS wide FROM w),
e1 AS (SELECT *, CASE WHEN NOT good THEN 'stale' WHEN look - 1 <= ttl THEN 'fresh' ELSE 'stale' END AS life1, CASE WHEN NOT good THEN 'insufficient_evidence_or_confidence' WHEN look - 1 <= ttl THEN 'within_ttl_window' ELSE 'ttl_expired' END AS why1,
 CASE WHEN good THEN base + 3600 END AS valid1, CASE WHEN good THEN NULL ELSE base END AS asked1 FROM g),
r1 AS (SELECT *, fact_id % 4 <> 1 AS asks, CASE WHEN fact_id % 4 <> 1 AND asked1 IS NULL THEN 'revalidation_pending' ELSE life1 END AS life2, CASE WHEN fact_id % 4 <> 1 AND asked1 IS NULL THEN 'stale_requires_revalidation' ELSE why1 END AS why2,
 CASE WHEN fact_id % 4 <> 1 AND asked1 IS NULL THEN base + (look + 1) * 3600 ELSE asked1 END AS asked2 FROM e1),
p2 AS (SELECT *, CASE WHEN fact_id % 2 = 0 AND good THEN base + (look + 2) * 3600 ELSE valid1 END AS valid3, CASE WHEN fact_id % 2 = 0 AND good THEN NULL ELSE asked2 END AS asked3,
 CASE WHEN fact_id % 2 = 1 THEN life2 WHEN good THEN 'fresh' ELSE 'stale' END AS life3, CASE WHEN fact_id % 2 = 1 THEN why2 WHEN good THEN 'approved_and_validated' ELSE 'insufficient_evidence_or_confidence' END AS why3 FROM r1),
e2 AS (SELECT *, CASE WHEN NOT good THEN life3 WHEN base + (look + 60) * 3600 - valid3 <= ttl * 3600 THEN 'fresh' ELSE 'stale' END AS life4, CASE WHEN NOT good THEN why3 WHEN base + (look + 60) * 3600 - valid3 <= ttl * 3600 THEN 'within_ttl_window' ELSE 'ttl_expired' END AS why4 FROM p2)"""

_WORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '[ \t\n\r\f\x0B]+'), lambda t: t <> ''))"

_REQUESTS = """s AS (SELECT min(epoch(ts))::BIGINT AS start FROM events), r AS (SELECT event_id, user_id, 'q' || user_id % 50 AS q, epoch(ts)::BIGINT AS at, event_type = 'purchase' AS fresh FROM events),
p AS (SELECT 'q' || page_id % 60 AS q, start + page_id * 3600 AS at, row_number() OVER (PARTITION BY page_id % 60 ORDER BY page_id) AS nth FROM pages, s),
c AS (SELECT event_id, user_id, q, fresh, (SELECT count(*) FROM p WHERE p.q = r.q AND p.at <= r.at AND nth <= 5) AS cached FROM r),
d AS (SELECT *, cached > 0 AND (NOT fresh OR cached >= 2) AS enough FROM c)"""

ORACLE_SQL = {
    "t06_cache_reuse": f"""WITH {_REQUESTS} SELECT event_id AS request_id, cached, enough AS from_cache FROM d""",
    "k18_fetch_log": f"""
WITH {_REQUESTS}, v AS (SELECT *, unnest(CASE WHEN fresh THEN [q, q || ' latest'] ELSE [q] END) AS variant FROM d WHERE NOT enough)
SELECT event_id AS request_id, q AS query_variant, 'cache_hit' AS status, NULL::VARCHAR AS http_status, NULL AS error, cached AS result_count FROM d WHERE enough
UNION ALL SELECT event_id, variant, CASE WHEN user_id % 7 = 0 THEN 'error' ELSE 'ok' END, CASE WHEN user_id % 7 = 0 THEN NULL ELSE '200' END, CASE WHEN user_id % 7 = 0 THEN 'timeout' END,
 CASE WHEN user_id % 7 = 0 OR user_id % 4 = 3 THEN 0 ELSE user_id % 4 END FROM v""",
    "l07_web_memory": f"""{_FACTS}, q AS (SELECT item_id AS query_id, {_WORDS.format('text')} AS qw FROM benchmark),
fw AS (SELECT f.fact_id, {_WORDS.format('d.text')} AS w FROM f JOIN documents d ON d.doc_id = f.fact_id), pw AS (SELECT page_id, url, {_WORDS.format("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS w FROM pages),
fs AS (SELECT query_id, fact_id, len(list_intersect(qw, w)) AS n FROM q, fw WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, fact_id) <= 3),
ps AS (SELECT query_id, page_id, url, len(list_intersect(qw, w)) AS n FROM q, pw WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, page_id) <= 4),
k AS (SELECT fs.query_id, 'webpromoted:' || fs.fact_id AS id, CASE WHEN good THEN 'trusted' ELSE 'staged' END AS state, CASE WHEN wide THEN 'global' WHEN work THEN 'workspace' ELSE 'local' END AS tier, life4 AS life, base + (look + 60) * 3600 >= since AS con, conf FROM fs JOIN e2 ON e2.fact_id = fs.fact_id),
a AS (SELECT *, CASE WHEN state = 'trusted' THEN CASE life WHEN 'fresh' THEN 0.08 WHEN 'revalidation_pending' THEN -0.1 ELSE -0.08 END ELSE -0.05 END + CASE tier WHEN 'global' THEN 0.06 WHEN 'workspace' THEN 0.03 ELSE 0 END - CASE WHEN con THEN 0.12 ELSE 0 END AS ta,
 CASE WHEN state = 'trusted' THEN CASE life WHEN 'fresh' THEN 0.05 WHEN 'revalidation_pending' THEN -0.03 ELSE -0.02 END ELSE 0 END + CASE tier WHEN 'global' THEN 0.03 WHEN 'workspace' THEN 0.015 ELSE 0 END - CASE WHEN con THEN 0.04 ELSE 0 END AS sa FROM k),
u AS (SELECT query_id, id, round((0.55 + sa)::DOUBLE, 6) AS semantic_score, greatest(0.0, least(1.0, (conf + ta)::DOUBLE)) AS t, CASE WHEN con THEN 0.65 ELSE 0.1 END::DOUBLE AS contradiction_risk, 'web_promoted:' || tier || ':' || state || ':' || life AS cluster_id,
  [0, CASE tier WHEN 'global' THEN 0 WHEN 'workspace' THEN 1 ELSE 2 END, CASE state WHEN 'trusted' THEN 0 ELSE 1 END, CASE life WHEN 'fresh' THEN 0 WHEN 'revalidation_pending' THEN 1 ELSE 2 END, con::INT] AS o FROM a
 UNION ALL SELECT query_id, 'webevidence:' || page_id, 0.5, CASE WHEN starts_with(url, 'https://') THEN 0.7 ELSE 0.6 END, 0.15, regexp_extract(url, '://([^/?#]*)', 1), [1, 0, 0, 0, 0] FROM ps)
SELECT query_id, id, semantic_score, round(t, 6) AS trust_score, contradiction_risk, cluster_id, row_number() OVER (PARTITION BY query_id ORDER BY o, round(t, 9) DESC, id) AS place FROM u QUALIFY place <= 6""",
    "c11_promotion_state": f"""{_FACTS}
SELECT fact_id, CASE WHEN good THEN 'trusted' ELSE 'staged' END AS state, CASE WHEN wide THEN 'global' WHEN work THEN 'workspace' ELSE 'local' END AS tier,
 CASE WHEN approved THEN 'explicit_backend_approval' WHEN good THEN 'evidence_count_confidence_source_threshold' ELSE 'insufficient_evidence_or_confidence' END AS approval_reason,
 CAST(work AS BIGINT) + CAST(wide AS BIGINT) AS n_moves, CASE WHEN wide THEN 'workspace>global' WHEN work THEN 'local>workspace' END AS last_move,
 CASE WHEN good AND fact_id % 2 = 0 THEN base + (look + 2) * 3600 WHEN good THEN base + 3600 END::VARCHAR AS approved_at FROM e2""",
    "t03_ttl_revalidation": f"""{_FACTS}
SELECT fact_id, CAST(4 AS BIGINT) AS seq, 'evaluate' AS op, life1 AS lifecycle, why1 AS freshness_reason, valid1::VARCHAR AS validated_at, asked1::VARCHAR AS asked_at, good AS changed FROM e2
UNION ALL SELECT fact_id, 5, 'revalidate', life2, why2, valid1::VARCHAR, asked2::VARCHAR, asked1 IS NULL FROM e2 WHERE asks
UNION ALL SELECT fact_id, 7, 'evaluate', life4, why4, valid3::VARCHAR, asked3::VARCHAR, good AND (life4 <> life3 OR why4 <> why3) FROM e2""",
    "t03_fact_stream": f"""{_FACTS}, x AS (SELECT max(base + (look + 60) * 3600) - 1 AS until FROM f),
due AS (SELECT *, base + 3600 + ttl * 3600 + 1 AS due1, CASE WHEN fact_id % 2 = 0 THEN base + (look + 2) * 3600 ELSE base + 3600 END + ttl * 3600 + 1 AS due2, asks AND asked1 IS NULL AS pends FROM e2 WHERE good)
SELECT fact_id, due1 AS at, 'stale' AS lifecycle, 'ttl_expired' AS freshness_reason, base + 3600 AS validated_at FROM due, x
 WHERE due1 <= until AND (due1 <= base + (look + 1) * 3600 OR NOT pends AND due1 <= base + (look + CASE WHEN fact_id % 2 = 0 THEN 2 ELSE 60 END) * 3600)
UNION ALL SELECT fact_id, due2, 'stale', 'ttl_expired', due2 - ttl * 3600 - 1 FROM due, x
 WHERE due2 <= until AND (fact_id % 2 = 0 OR (due2 > base + (look + 60) * 3600))""",
    "k17_promoted_facts": f"""{_FACTS}, q AS (SELECT k, v, count(*) AS n_facts, min(fact_id) AS first_fact, min(base) AS since FROM f WHERE k <> '' AND v <> '' GROUP BY k, v)
SELECT lower(a.k) AS claim_key, lower(a.v) AS claim_value, a.n_facts, a.first_fact, a.since, CAST(coalesce(sum(b.n_facts), 0) AS BIGINT) AS n_conflicting, CASE WHEN min(b.since) IS NOT NULL THEN greatest(a.since, min(b.since)) END::VARCHAR AS conflict_from
FROM q a LEFT JOIN q b ON a.k = b.k AND a.v <> b.v GROUP BY a.k, a.v, a.n_facts, a.first_fact, a.since""",
}
