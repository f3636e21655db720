"""Discovery plans (C05), tuning (A11, C17, K14), lessons (L17, L19) and topics (C16); the checking SQL is written by hand.

The tables hold no cases, evaluations or metrics: events stand for them, their type for the agent's, their value for the
score; benchmark items ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import lexicons as lx
from lorewell.operators import controller, lessons, topics, tuning
from lorewell.operators.discovery import ROLES
from lorewell.sources.tables import read

#: Topics of the documents.
K = 8
#: Openings of the items by their number, as their invented prose has no intent.
OPENINGS = ("What did we say: ", "Investigate ", "architecture of ", "What do you remember of ", "synopsis of the latest ", "next steps, verify ", "roadmap, current: ", "financial audit ")


def c05_discovery_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some items hint at an intent, real or not, and some have few lanes; evidence is counted by the item's number."""
    hint = F.when(F.col("query_id") % 10 == 0, "planning").when(F.col("query_id") % 10 == 1, "guesswork")
    lanes = F.when(F.col("query_id") % 4 == 0, F.array(F.lit("semantic"), F.lit("web")))
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("item_id") % len(OPENINGS) + 1).cast("int"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(opening, "text").alias("query"))
    asked = asked.select("query_id", "query", hint.alias("hinted_intent"), (F.col("query_id") % 3).alias("local_evidence_count"), lanes.alias("available_lanes"))
    found = controller.discovery_plans(asked)
    probes = F.array_join(F.transform("probes", lambda p: F.concat_ws(":", p["kind"], p["priority"].cast("string"), p["role"])), "|")
    prompts = F.sha1(F.array_join(F.transform("probes", lambda p: p["prompt"]), "\n"))
    joined = [F.array_join(c, "|").alias(c) for c in ("expected_lanes", "query_variants", "adjacent_topics", "notes")]
    return found.select("query_id", "intent_family", "web_sensitive", "risk_mode", "discovery_mode", *joined, probes.alias("probes"), prompts.alias("prompts"))


def c17_tuning_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user: the greatest value of each type of event among the even events; the odd ones are what a change
    brought.  Where the sum of all differences is negative the proposal is rejected; users without even events have no run."""
    e = read(spark, sf_dir, "events").where("user_id is not null and event_type is not null and value is not null")
    top = lambda parity: e.where(f"event_id % 2 = {parity}").groupBy("user_id", "event_type").agg(F.max(F.round("value", 2)).alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    before, after = top(0), top(1)
    runs = tuning.evaluation_runs(before.select("user_id", F.array(F.lit("s2"), F.lit("s1")).alias("scenario_ids"), F.array(F.col("user_id").cast("string")).alias("artifact_refs"), F.col("m").alias("metrics_before"), F.lit(" even events ").alias("summary")), ("user_id",))
    asked = after.join(runs.select("user_id", "run_id"), "user_id", "left").select(F.coalesce("run_id", F.concat(F.lit("evalrun:user"), F.col("user_id").cast("string"))).alias("run_id"), F.create_map(F.lit("retrieval_ranking"), F.size("m").cast("string")).alias("candidate_patch"), F.col("m").alias("metrics_after"), F.lit("odd events").alias("rationale"))
    made = tuning.proposals(asked, runs)
    worse = F.aggregate(F.map_values("delta"), F.lit(0.0), lambda a, x: a + x) < 0
    turned = tuning.rejected(made, made.where(worse).select("proposal_id", F.lit(1).alias("at"), F.lit("worse").alias("reason")))
    return turned.select("proposal_id", "run_id", "status", "authoritative", "reason", "error", F.explode_outer("delta").alias("metric", "delta")).withColumn("delta", F.round("delta", 6))


def _about() -> dict[str, Column]:
    return {"agent_type": F.col("event_type"), "task_type": F.concat(F.lit("t"), (F.floor("value") % 4).cast("string")), "channel_type": F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))}


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = _about()
    ids = F.when(F.col("event_id") % 5 > 0, F.array("event_type", about["task_type"], about["channel_type"]))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), *(v.alias(k) for k, v in about.items()), (F.col("event_type") != "error").alias("success"), ids.alias("artifact_ids"), F.concat(F.lit(" run "), F.col("event_id").cast("string")).alias("request_text"), F.lit("  done ").alias("output_text"), F.col("ts").alias("created_at"))


def _evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events evaluate one execution; the value's whole part modulo 100 is the score in hundredths."""
    overall = (F.floor("value") % 100) / 100
    lists = {"strengths": F.array("event_type"), "weaknesses": F.when(F.col("user_id") % 2 == 0, F.array(F.lit("with"), F.lit("the"))), "improvements": F.array(F.concat(F.lit("n"), (F.col("user_id") % 7).cast("string"))), "anti_patterns": F.slice(F.array(*map(F.lit, ("on", "and", "of", "it", "with"))), 1, (F.col("user_id") % 5).cast("int"))}
    language = F.when(F.col("user_id") % 2 == 0, "en").otherwise("fr")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("evaluation_id"), F.expr("event_id div 5").alias("execution_id"), *(v.alias(k) for k, v in _about().items()), language.alias("language"), overall.alias("overall"), (overall >= 0.2).alias("passed"), *(v.alias(k) for k, v in lists.items()), F.lit("as the rest").alias("edits"), F.col("ts").alias("created_at"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item asks about an agent; some about all, some about a task, a channel or a language too."""
    i = F.col("item_id")
    agent = F.when(i % 8 > 0, F.element_at(F.array(*map(F.lit, ("click", "view", "purchase", "error"))), (i % 4 + 1).cast("int")))
    numbered = lambda at, letter, n: F.when(i % at == 0, F.concat(F.lit(letter), (i % n).cast("string")))
    return read(spark, sf_dir, "benchmark").select(i.alias("request_id"), agent.alias("agent_type"), numbered(2, "t", 4).alias("task_type"), numbered(3, "c", 3).alias("channel_type"), F.when(i % 5 == 0, "en").otherwise("").alias("language"), i.alias("execution_id"), F.col("text").alias("query"))


def l17_derived_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _requests(spark, sf_dir)
    made = lessons.execution_lessons(_cases(spark, sf_dir), asked).unionByName(lessons.evaluation_lessons(_evaluations(spark, sf_dir), asked))
    return made.select("request_id", "case_id", "artifact_type", "namespace", "confidence", "text", "artifact_id")


def l19_ranked_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best, the weak, and those of the execution that has the item's number."""
    rows, asked = _evaluations(spark, sf_dir), _requests(spark, sf_dir)
    lists = {"best": lessons.ranked_evaluations(rows, asked), "weak": lessons.ranked_evaluations(rows, asked, weak=True), "execution": lessons.evaluations_of_executions(rows, asked)}
    out = None
    for name, found in lists.items():
        part = found.select(F.lit(name).alias("list"), "request_id", "evaluation_id", "score", F.array_join("reasons", ",").alias("reasons"))
        out = part if out is None else out.unionByName(part)
    return out


def c16_topic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of documents and their topics with the topics' labels.  A fit has no SQL; tests compare it with known mixtures."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = topics.fit_topics(docs, K)
    _, edges = topics.topic_graph(docs, topics.place_documents(docs, found), found)
    # The fit knows its labels: reading them from the nodes would place every document once more.
    labels = F.element_at(F.array(*map(F.lit, found.labels or [""])), F.substring_index("topic_node", "_", -1).cast("int") + 1)
    return edges.withColumn("label", labels).select("doc_node", "topic_node", "label", F.round("weight", 3).alias("weight"))


QUERIES = {f.__name__: f for f in (c05_discovery_plans, c16_topic_graph, c17_tuning_proposals, l17_derived_lessons, l19_ranked_evaluations)}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]::VARCHAR[]"


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(low, {_q(w)})" for w in words) + ")"


def _cases_of(values) -> str:
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in values.items()) + " END"


_KINDS = f"({_list(OPENINGS)})[CAST(item_id % 8 AS INT) + 1]"
_FIXED = " UNION ALL ".join(
    f"SELECT query_id, {i}, {_q(kind)}, {priority}, {_q(role)}, {_q(purpose)} FROM l WHERE " + (f"intent IN ({', '.join(map(_q, intents))})" if intents else "true") + (" AND web" if web else "")
    for i, (kind, role, priority, purpose, intents, web) in enumerate(lx.PLAN_PROBES, 10)
)
_EVALUATIONS = """v AS (SELECT event_id AS id, event_id // 5 AS execution_id, event_type AS agent, 't' || CAST(floor(value) AS BIGINT) % 4 AS task, 'c' || user_id % 3 AS channel, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'fr' END AS lang,
 (CAST(floor(value) AS BIGINT) % 100) / 100.0::DOUBLE AS overall, (CAST(floor(value) AS BIGINT) % 100) >= 20 AS passed, user_id % 2 = 0 AS weakness, 'n' || user_id % 7 AS note, user_id % 5 AS hits, ts, event_type FROM events)"""
_REQUESTS = """q AS (SELECT item_id AS request_id, text, CASE WHEN item_id % 8 > 0 THEN ['click', 'view', 'purchase', 'error'][CAST(item_id % 4 AS INT) + 1] END AS agent, CASE WHEN item_id % 2 = 0 THEN 't' || item_id % 4 END AS task, CASE WHEN item_id % 3 = 0 THEN 'c' || item_id % 3 END AS channel, CASE WHEN item_id % 5 = 0 THEN 'en' END AS lang FROM benchmark)"""
_AGREE = "(q.agent IS NULL OR q.agent = {0}.agent) AND (q.task IS NULL OR q.task = {0}.task) AND (q.channel IS NULL OR q.channel = {0}.channel)"
_AGREE_V = _AGREE.format("v") + " AND (q.lang IS NULL OR q.lang = v.lang)"
_HITS = "list_slice(['on', 'and', 'of', 'it', 'with'], 1, CAST(hits AS INT))"
_BAD, _GOOD = "(1 - overall) * 10 + CASE WHEN passed THEN 0 ELSE 5 END + least(3, hits)", "overall * 10 + CASE WHEN passed THEN 3 ELSE 0 END"
_TOKENS = "list_distinct(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> ''))"
_SAID = f"concat_ws(' ', event_type, CASE WHEN weakness THEN 'with the' ELSE '' END, note, 'as the rest', array_to_string({_HITS}, ' '))"


def _lesson(kind: str) -> str:
    return f"'skill:{kind}:' || substr(sha1('{kind}|craft_{kind}s|' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 16) AS artifact_id"


ORACLE_SQL = {
    "c05_discovery_plans": rf"""WITH a AS (SELECT item_id AS query_id, trim(regexp_replace({_KINDS} || text, '\s+', ' ', 'g')) AS query FROM benchmark),
b AS (SELECT *, lower(query) AS low FROM a),
t AS (SELECT *, CASE WHEN query_id % 10 = 0 THEN 'planning' {" ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in lx.INTENTS)} ELSE 'investigative' END AS intent, {_has(lx.PLAN_WEB_WORDS)} AS web FROM b),
m AS (SELECT *, {_cases_of(lx.PLAN_LANES)} || CASE WHEN web THEN ['web'] ELSE []::VARCHAR[] END AS lanes, trim(regexp_replace(regexp_replace(low, '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS compact FROM t),
n AS (SELECT *, list_filter(lanes, lambda x: x IN ('semantic', 'web')) AS allowed, string_split(compact, ' and ') AS parts FROM m),
l AS (SELECT *, CASE WHEN query_id % 4 = 0 AND len(allowed) > 0 THEN allowed ELSE lanes END AS expected FROM n),
r AS (SELECT query_id, unnest({_cases_of(ROLES)}) AS role, generate_subscripts({_cases_of(ROLES)}, 1) AS i FROM l),
p AS (SELECT query_id, i AS o, 'role' AS kind, i AS priority, role, {_q(lx.ROLE_PURPOSE)} AS purpose FROM r WHERE i <= 4 UNION ALL {_FIXED}),
s AS (SELECT p.query_id, string_agg(kind || ':' || priority || ':' || role, '|' ORDER BY o) AS probes, sha1(string_agg('[' || role || '] ' || purpose || ' Query: ' || query || '. Target lanes: ' || array_to_string(expected, ', ') || '.', chr(10) ORDER BY o)) AS prompts FROM p JOIN l ON l.query_id = p.query_id GROUP BY p.query_id),
w AS (SELECT query_id, v, min(i) AS i FROM (SELECT query_id, compact AS v, 1 AS i FROM l UNION ALL SELECT query_id, trim(unnest(parts)), 1 + generate_subscripts(parts, 1) FROM l WHERE len(parts) > 1) x WHERE v <> '' AND (i = 1 OR length(v) >= 8) GROUP BY query_id, v),
y AS (SELECT w.query_id, list(v ORDER BY i) AS vs FROM w JOIN l ON l.query_id = w.query_id WHERE v <> low GROUP BY w.query_id),
k AS (SELECT query_id, tok, min(i) AS i FROM (SELECT query_id, unnest(string_split_regex(low, '[^a-z0-9]+')) AS tok, generate_subscripts(string_split_regex(low, '[^a-z0-9]+'), 1) AS i FROM l) WHERE length(tok) >= 4 AND tok NOT IN ({", ".join(map(_q, lx.PLAN_STOPWORDS))}) GROUP BY query_id, tok),
g AS (SELECT query_id, list(tok ORDER BY i) AS toks FROM k GROUP BY query_id)
SELECT l.query_id, intent AS intent_family, web AS web_sensitive, CASE {" ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in lx.RISKS)} ELSE 'normal' END AS risk_mode,
 CASE WHEN intent IN ('exact_recall', 'architecture_explanation', 'planning') THEN 'off' WHEN (intent = 'investigative' AND l.query_id % 3 <= 0) OR (web AND l.query_id % 3 < 2) THEN 'active' ELSE 'passive' END AS discovery_mode,
 array_to_string(expected, '|') AS expected_lanes, array_to_string(([query] || coalesce(vs, []))[1:4], '|') AS query_variants, array_to_string(coalesce(toks, [])[1:6], '|') AS adjacent_topics,
 array_to_string({_list(lx.PLAN_NOTES)} || CASE WHEN web THEN [{_q(lx.WEB_NOTE)}] ELSE []::VARCHAR[] END || CASE WHEN l.query_id % 10 < 2 THEN ['intent hint considered'] ELSE []::VARCHAR[] END, '|') AS notes, probes, prompts
FROM l JOIN s ON s.query_id = l.query_id LEFT JOIN y ON y.query_id = l.query_id LEFT JOIN g ON g.query_id = l.query_id""",
    "c17_tuning_proposals": """WITH e AS (SELECT user_id, event_type AS k, event_id % 2 AS odd, max(round(value, 2)) AS v FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
j AS (SELECT user_id, odd, count(*) AS n, '{' || string_agg('"' || k || '":' || v, ',' ORDER BY k) || '}' AS json FROM e GROUP BY user_id, odd),
r AS (SELECT user_id, 'evalrun:' || substr(sha1('{"artifact_refs":["' || user_id || '"],"metrics_before":' || json || ',"scenario_ids":["s1","s2"],"summary":"even events"}'), 1, 20) AS run_id FROM j WHERE odd = 0),
c AS (SELECT j.user_id, coalesce(r.run_id, 'evalrun:user' || j.user_id) AS run_id, r.run_id IS NOT NULL AS known, n, json FROM j LEFT JOIN r ON r.user_id = j.user_id WHERE odd = 1),
p AS (SELECT user_id, run_id, known, CASE WHEN known THEN 'tuneprop:' || substr(sha1('{"candidate_patch":{"retrieval_ranking":"' || n || '"},"metrics_after":' || json || ',"rationale":"odd events","run_id":"' || run_id || '"}'), 1, 20) END AS proposal_id FROM c),
d AS (SELECT user_id, k, sum(CASE WHEN odd = 1 THEN v ELSE -v END) AS delta FROM e GROUP BY user_id, k), t AS (SELECT user_id, sum(delta) < 0 AS worse FROM d GROUP BY user_id)
SELECT proposal_id, run_id, CASE WHEN worse THEN 'rejected' ELSE 'draft' END AS status, false AS authoritative, CASE WHEN worse THEN 'worse' ELSE 'proposal_not_applied' END AS reason, NULL AS error, k AS metric, round(delta, 6) AS delta FROM p JOIN d ON d.user_id = p.user_id JOIN t ON t.user_id = p.user_id WHERE known
UNION ALL SELECT NULL, run_id, NULL, NULL, NULL, 'unknown evaluation run_id: ' || run_id, NULL, NULL FROM p WHERE NOT known""",
    "l17_derived_lessons": rf"""WITH c AS (SELECT event_id AS id, event_type AS agent, 't' || CAST(floor(value) AS BIGINT) % 4 AS task, 'c' || user_id % 3 AS channel, event_type <> 'error' AS won, ts FROM events),
{_EVALUATIONS}, {_REQUESTS},
x AS (SELECT request_id, c.* FROM q JOIN c ON {_AGREE.format("c")} QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, id) <= 20),
y AS (SELECT request_id, v.* FROM q JOIN v ON {_AGREE_V} QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY overall DESC, ts DESC, id) <= 20),
o AS (SELECT request_id, id AS case_id, CASE WHEN won THEN 0.85 ELSE 0.65 END::DOUBLE AS confidence, 'Execution lesson: For ' || task || ', a ' || CASE WHEN won THEN '' ELSE 'un' END || 'successful run used artifacts ' || CASE WHEN id % 5 > 0 THEN agent || ', ' || task || ', ' || channel ELSE 'none' END || '; request=''run ' || id || '''; output=''done''.' AS text FROM x),
u AS (SELECT request_id, id AS case_id, 0.88::DOUBLE AS confidence, 'Evaluation lesson: score=' || printf('%.2f', overall) || ', pass=' || CASE WHEN passed THEN 'True' ELSE 'False' END || '; weaknesses=' || CASE WHEN weakness THEN 'with, the' ELSE 'none' END || '; improvements=' || note || '; anti_patterns=' || CASE WHEN hits = 0 THEN 'none' ELSE array_to_string({_HITS}[1:3], ', ') END || '.' AS text FROM y)
SELECT request_id, case_id, 'execution_lesson' AS artifact_type, 'craft_execution_lessons' AS namespace, confidence, text, {_lesson("execution_lesson")} FROM o
UNION ALL SELECT request_id, case_id, 'evaluation_lesson', 'craft_evaluation_lessons', confidence, text, {_lesson("evaluation_lesson")} FROM u""",
    "l19_ranked_evaluations": rf"""WITH {_EVALUATIONS}, {_REQUESTS},
b AS (SELECT request_id, v.* FROM q JOIN v ON {_AGREE_V} AND passed QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY overall DESC, ts DESC, id) <= 20),
w AS (SELECT request_id, v.* FROM q JOIN v ON {_AGREE_V} AND NOT passed QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY overall DESC, ts DESC, id) <= 20),
x AS (SELECT request_id, v.*, {_TOKENS.format("coalesce(text, '')")} AS asked, {_TOKENS.format(_SAID)} AS says FROM q JOIN v ON v.execution_id = q.request_id),
z AS (SELECT *, len(list_intersect(asked, says)) / greatest(1, len(asked))::DOUBLE AS share FROM x),
a AS (SELECT 'best' AS list, request_id, id, round({_GOOD}, 6) AS score, 'passed_case' AS reasons FROM b
 UNION ALL SELECT 'weak', request_id, id, round({_BAD}, 6), 'failed_case' || CASE WHEN hits > 0 THEN ',anti_pattern_hits' ELSE '' END FROM w
 UNION ALL SELECT 'execution', request_id, id, round(CASE WHEN passed THEN {_GOOD} ELSE {_BAD} END + 6 * share, 6), CASE WHEN passed THEN 'passed_case' WHEN hits > 0 THEN 'failed_case,anti_pattern_hits' ELSE 'failed_case' END || CASE WHEN share > 0 THEN ',text_match' ELSE '' END FROM z)
SELECT list, request_id, id AS evaluation_id, score, reasons FROM a QUALIFY row_number() OVER (PARTITION BY list, request_id ORDER BY score DESC, id) <= 5""",
}
