"""Artifacts and cases by weighted features, and lists of hits as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.streaming.ingest import shared_path

from .linear import linear_top_k
from .rank import top_k
from .skew import join_by_share
from .vectors import nearest_vectors  # noqa: F401


def token_set(text: Column) -> Column:
    """Distinct runs of letters, digits and underscores, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != ""))


#: What each type of skill artifact counts, and what a match of each kind adds.
TYPE_PRIORITY = {"principle": 70, "template": 60, "execution_lesson": 57, "evaluation_lesson": 56, "example": 50, "rubric": 40, "anti_pattern": 30, "workflow": 20, "style_note": 15, "style_gist": 15, "raw_chunk": 1}
ARTIFACT_MATCH = {"agent_type": 6.0, "task_type": 6.0, "channel_type": 3.0, "language": 3.0, "style_profile": 4.0}
CONFIDENCE_WEIGHT, QUERY_WEIGHT, RAW_PENALTY = 10.0, 16.0, 8.0
CASE_MATCH = {"agent_type": 6.0, "task_type": 6.0, "channel_type": 4.0, "language": 3.0}
CASE_TEXT, CASE_ARTIFACTS, CASE_SUCCESS = 12.0, 10.0, 1.5


def rank_artifacts(artifacts: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """(request_id, artifact_id, score): the k best artifacts of each request, ties by artifact_id.

    artifacts: artifact_id, artifact_type, confidence, blob (lower-cased text), and adjustment (added to the score) where
    there is one; requests: request_id, query and the keys of ARTIFACT_MATCH, null where a request doesn't say.  A match is the request's value, underscores as spaces, within
    the blob; a language is taken as it is.  Every artifact has a place, also one of a score of 0 or less."""
    priority = F.coalesce(F.create_map(*(F.lit(x) for p in TYPE_PRIORITY.items() for x in p))[F.col("artifact_type")], F.lit(0))
    base = priority + F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)) * CONFIDENCE_WEIGHT
    base = base - F.when(F.col("artifact_type") == "raw_chunk", RAW_PENALTY).otherwise(0.0)
    if "adjustment" in artifacts.columns:
        base = base + F.col("adjustment")
    rows = artifacts.select(F.col("artifact_id").alias("row_id"), F.col("artifact_id").alias("tie"), token_set(F.col("blob")).alias("features"), base.alias("base"), F.col("blob").alias("text"))
    says = [F.when(F.length(n) > 0, F.struct((F.lower(F.col(n)) if n == "language" else F.regexp_replace(n, "_", " ")).alias("value"), F.lit(w).alias("weight"))) for n, w in ARTIFACT_MATCH.items()]
    asked = requests.select(F.col("request_id").alias("query_id"), token_set(F.col("query")).alias("features"), F.array_compact(F.array(*says)).alias("says"))
    asked = asked.select("query_id", "features", F.transform("features", lambda f: F.lit(QUERY_WEIGHT) / F.size("features")).alias("weights"), F.col("says.value").alias("phrases"), F.col("says.weight").alias("phrase_weights"))
    found = linear_top_k(rows, asked, k, above=-1e9, digits=6)
    return found.select(F.col("query_id").alias("request_id"), F.col("row_id").alias("artifact_id"), "score")


#: Stands for a condition that has to hold: more than any score.
_HAS_TO = 1e6


def similar_cases(cases: DataFrame, requests: DataFrame, k: int, same: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, case_id, score): the k most similar execution cases of each request, those above 0, ties by case_id.

    cases: case_id, blob, the keys of CASE_MATCH, artifact_ids, success; requests: request_id (the case it repeats, which
    is no answer, else null ids of none), query, the keys of CASE_MATCH, artifact_ids.  Only cases that agree with a
    request in each of `same` on which it says something are candidates; () takes all."""

    def value(name: str) -> Column:
        return F.when(F.length(name) > 0, F.concat(F.lit(f"{name}="), F.col(name)))

    used = F.coalesce("artifact_ids", F.expr("cast(array() as array<string>)"))
    tokens, own = F.transform(token_set(F.col("blob")), lambda t: F.concat(F.lit("word "), t)), F.transform(F.array_distinct(used), lambda a: F.concat(F.lit("artifact "), a))
    rows = cases.select(F.col("case_id").alias("row_id"), F.concat(tokens, own, F.array_compact(F.array(*map(value, CASE_MATCH)))).alias("features"), F.when(F.col("success"), CASE_SUCCESS).otherwise(0.0).alias("base"))
    words, wanted = token_set(F.col("query")), F.array_distinct(used)

    def each(names: Column, lead: str, weight: float) -> Column:
        return F.transform(names, lambda n: F.struct(F.concat(F.lit(lead), n).alias("feature"), (F.lit(weight) / F.size(names)).alias("weight")))

    says = [F.when(F.length(n) > 0, F.struct(value(n).alias("feature"), F.lit(w + (_HAS_TO if n in same else 0.0)).alias("weight"))) for n, w in CASE_MATCH.items()]
    asked = requests.select("request_id", F.concat(each(words, "word ", CASE_TEXT), each(wanted, "artifact ", CASE_ARTIFACTS), F.array_compact(F.array(*says))).alias("f"), F.size(F.array_compact(F.array(*(F.when(F.length(n) > 0, 1) for n in same)))).alias("n_same") if same else F.lit(0).alias("n_same"))
    # Cases that say the same have one score: of each class the first ids decide, whichever request is asked.  A request's
    # own case has `most` - k rows at most, so that `most` rows leave k others, and so many classes hold those.
    most = k + (cases.join(requests.select(F.col("request_id").alias("case_id")), "case_id", "left_semi").groupBy("case_id").count().agg(F.max("count")).first()[0] or 0)
    firsts = top_k(rows.select("row_id", F.array_sort("features").alias("features"), F.coalesce("base", F.lit(0.0)).alias("base")), ["features", "base"], [F.col("row_id")], most)
    classes = _written(firsts.groupBy("features", "base").agg(F.array_sort(F.collect_list("row_id")).alias("ids")).withColumn("class_id", F.monotonically_increasing_id()), "case-classes")
    asked = asked.withColumn("f", F.array_sort("f"))
    kinds = _written(asked.groupBy("f", "n_same").agg(F.count("*").alias("n")).withColumn("kind_id", F.monotonically_increasing_id()), "request-classes")
    rows = classes.select(F.col("class_id").alias("row_id"), F.element_at("ids", 1).alias("tie"), "features", "base")
    out = None
    for n in range(len(same) + 1):  # requests that state equally many conditions have one bound
        some = kinds.where(F.col("n_same") == n).select(F.col("kind_id").alias("query_id"), F.col("f.feature").alias("features"), F.col("f.weight").alias("weights"))
        found = linear_top_k(rows, some, most, above=n * _HAS_TO, digits=6).withColumn("score", F.round(F.col("score") - n * _HAS_TO, 6))
        out = found if out is None else out.unionByName(found)
    hits = out.join(classes.select(F.col("class_id").alias("row_id"), F.explode("ids").alias("case_id")), "row_id").select(F.col("query_id").alias("kind_id"), "case_id", "score")
    best = top_k(hits, ["kind_id"], [F.col("score").desc(), F.col("case_id")], most).groupBy("kind_id").agg(F.collect_list(F.struct("case_id", "score")).alias("best"))
    told = _written(kinds.join(best, "kind_id").select("f", "n_same", "n", "best"), "request-answers")
    answers = join_by_share(asked, told, ["f", "n_same"], "n").select("request_id", F.explode("best").alias("b")).select("request_id", "b.case_id", "b.score")
    return top_k(answers.where("case_id is null or request_id is null or case_id <> request_id"), ["request_id"], [F.col("score").desc(), F.col("case_id")], k)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hybrid(lexical: DataFrame, vectors: DataFrame, k: int, most_web: int = 2, enough: float = 3.0) -> DataFrame:
    """(query_id, doc_id, score, place, augment): lexical and vector hits as one list for each query.

    Hits: query_id, doc_id, web, score.  Of a document found twice the higher score stays; then the k best, ties by doc_id,
    without the web hits after the first most_web; augment where no hit reaches `enough`."""
    once = lexical.unionByName(vectors).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.max("web").alias("web"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    best = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumn("place", F.col("place").cast("long"))
    best = best.withColumn("nth_web", F.sum(F.col("web").cast("long")).over(order)).withColumn("augment", F.max("score").over(Window.partitionBy("query_id")) < enough)
    return best.where(~F.col("web") | (F.col("nth_web") <= most_web)).select("query_id", "doc_id", "score", "place", "augment")
