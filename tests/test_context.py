"""Lanes of the compound queries."""

from pyspark.sql import functions as F

from lorewell.functions import lexicons as lx
from lorewell.plans import context


def tables(spark, path):
    files = [(i, w + " alpha " * 1000, "en", "src", 6000) for i, w in enumerate(["zebra", "yak", "xerus", "wolf", "vole", "urial", "tapir", "okapi"])]
    docs = files + [(20, "okapi facts are promoted", "en", "src", 24)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(20, 1, 0)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, "okapi facts"), (2, "what do you remember of facts")], "item_id long, text string"),
        ("conversations", [(1, 0, "user", "okapi facts"), (1, 1, "assistant", "remember facts"), (2, 0, "user", "nothing alike")], "conv_id long, turn long, role string, text string"),
        ("pages", [(1, "u", "h")], "page_id long, url string, html string"),
        ("embeddings", [(1, [1.0], 1)], "vec_id long, embedding array<float>, label int"),
        ("events", [(1, 1, "view", 1.0)], "event_id long, user_id long, event_type string, value double"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_hits_of_all_routed_lanes(spark, tmp_path):
    sf = tables(spark, tmp_path)
    hits = context.lane_hits(spark, sf).collect()
    by = {q: {r["lane"].replace("fresh_tail", "episodic") for r in hits if r["query_id"] == q} for q in (1, 2)}
    assert by[1] == set(lx.LANES["investigative"])
    assert by[2] == set(lx.LANES["memory_summary"])
    files = {r["id"]: r for r in hits if r["lane"] == "large_file"}
    assert len(files) == context.LARGE_FILES and files["large_file:7"]["lexical_score"] == 0.5
    assert {r["id"] for r in hits if r["lane"] == "promoted"} == {"promoted:20"}
    chosen = context.c02_assemble_context(spark, sf)
    assert {r["query_id"] for r in chosen.select("query_id").distinct().collect()} == {1, 2}
    assert chosen.where(F.col("lane") == "large_file").count() and chosen.where(F.col("lane") == "promoted").count()
