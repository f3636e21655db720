"""Further plans: record builders, stores, promoted and web lanes, skills.  Same form as the relational plans."""

from __future__ import annotations

from lorewell.functions import lexicons as lx
from lorewell.functions.dialect import any_of, normalised, token_estimate, tokens

from .relational import ASKED, CASES, EDGES, FACTS, MESSAGES, lane_list, queries_cte, routed

PLANS = {}


def plan(f):
    PLANS[f.__name__] = f
    return f


D = "CAST({} AS DOUBLE)".format


@plan
def s05_parts_with_fallback(d):
    return "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, " + f"concat('meta:', CAST({d.json_int('props', 'k')} AS STRING)), 'text') AS part_type FROM events"


@plan
def s07_recent_large_files(d):
    return "WITH r AS (SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS BIGINT) AS age FROM documents WHERE n_chars > 2000) SELECT source, doc_id, n_chars FROM r WHERE age <= 10"


@plan
def s08_patterns_over_schemas(d):
    return "SELECT doc_id AS pattern_id, source AS subtype, CAST(0.5 AS DOUBLE) AS confidence FROM documents WHERE lang = 'en' UNION ALL SELECT d.doc_id, 'labelled', CASE WHEN l.quality = 1 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


@plan
def s10_namespace_scan(d):
    return "SELECT doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS BIGINT) AS place FROM documents WHERE lang = 'de'"


@plan
def s12_promoted_scan(d):
    return f"WITH {FACTS} SELECT fact_id, CASE WHEN quality = 1 THEN 'trusted' ELSE 'staged' END AS state, coalesce(claim_value, 'unknown') AS claim_value FROM facts WHERE toxic = 0"


@plan
def s13_fetch_log_recent(d):
    return "WITH r AS (SELECT event_type, event_id, ts, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS BIGINT) AS age FROM events) SELECT event_type, event_id, age FROM r WHERE age <= 50"


@plan
def s14_web_evidence(d):
    """Evidence from stored pages: title and text without markup."""
    title = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
    body = d.replace_all(d.replace_all("html", "<script>[^<]*</script>|<style>[^<]*</style>", " "), "<[^>]*>", " ")
    return f"SELECT page_id, {title} AS title, {d.length(normalised(d, body))} AS n_text FROM pages"


@plan
def k03_part_normalisation(d):
    return "WITH r AS (SELECT user_id, event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), 'text') AS part_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS BIGINT) AS rn FROM events) SELECT user_id, event_id, part_type FROM r WHERE rn = 1"


@plan
def k06_edge_upsert(d):
    return f"WITH e AS (SELECT user_id AS src, CAST(floor(value) AS BIGINT) % 40 AS dst, event_type AS relation, event_id FROM events) SELECT src, dst, relation, min(event_id) AS created, max(event_id) AS updated FROM e GROUP BY src, dst, relation"


@plan
def k08_lexical_store_delete(d):
    return "SELECT doc_id, source FROM documents x WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id AND l.toxic = 1)"


@plan
def k09_vector_metadata(d):
    return "SELECT vec_id, label, concat('{\"label\":', CAST(label AS STRING), ',\"vec_id\":', CAST(vec_id AS STRING), '}') AS metadata FROM embeddings"


@plan
def k11_evaluation_upsert(d):
    return f"WITH {CASES}, e AS (SELECT case_id, artifact, value, CASE WHEN case_id % 11 = 0 THEN '' ELSE CAST(case_id AS STRING) END AS execution_id FROM cases), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY artifact, CAST(floor(value) AS BIGINT) ORDER BY case_id DESC) AS BIGINT) AS rn FROM e WHERE trim(execution_id) <> '') SELECT artifact, case_id, execution_id FROM r WHERE rn = 1"


@plan
def k12_profile_upsert(d):
    return f"SELECT user_id, {d.max_by('event_type', 'event_id')} AS value, max(event_id) AS seq FROM events GROUP BY user_id"


@plan
def k13_federation_import(d):
    return "SELECT concat('pkt:', substr(sha1(concat_ws('|', url, CAST(page_id AS STRING))), 1, 20)) AS packet_id, 'untrusted' AS trust, 'unreviewed' AS review, 'quarantined' AS state, 0 AS authoritative FROM pages"


@plan
def k14_tuning_upsert(d):
    return "WITH r AS (SELECT event_type AS run_id, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS BIGINT) AS rn FROM events) SELECT run_id, event_id, round(value, 6) AS metric FROM r WHERE rn = 1"


@plan
def f18_unit_predicates(d):
    x = "lower(text)"
    return f"SELECT item_id, {any_of(d, x, ('today', 'right now', 'currently'))} AS ephemeral, {any_of(d, x, ('->', 'then ', 'first'))} AS procedural, {any_of(d, x, (' is ', ' the '))} AS proposition FROM benchmark"


@plan
def f27_query_variants(d):
    return f"WITH {ASKED} SELECT query_id, {normalised(d, 'query')} AS variant FROM asked UNION SELECT query_id, concat({normalised(d, 'query')}, ' background') FROM asked"


@plan
def f35_metadata_defaults(d):
    return "SELECT p.page_id, coalesce(nullif(p.url, ''), 'unknown') AS source_id, coalesce(d.source, 'web') AS source_type FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 5"


@plan
def f36_curiosity_terms(d):
    n = d.size(tokens(d, "text"))
    hedges = d.size(d.filter(tokens(d, "text"), "t", "t IN ('maybe', 'unclear', 'the', 'con')"))
    return f"SELECT item_id, round(least({D('1')}, CAST({hedges} AS DOUBLE) / greatest(1, {d.idiv(n, '4')})), 6) AS uncertainty, {n} AS terms FROM benchmark"


@plan
def f40_evaluation_builder(d):
    return f"WITH {CASES}, o AS (SELECT case_id, least({D('1')}, value / 100.0) AS overall FROM cases) SELECT case_id, round(overall, 6) AS overall, overall >= 0.7 AS passed FROM o"


@plan
def f41_chunk_defaults(d):
    return "SELECT doc_id, lang = 'en' AS exact, NOT (lang = 'en') AS summarizable, coalesce(nullif(source, ''), 'provenance:unknown') AS provenance FROM documents"


@plan
def f43_query_with_summaries(d):
    return f"WITH {MESSAGES}, s AS (SELECT session_id, {d.join(d.collect('text', 'seq'), ' ')} AS summaries FROM messages GROUP BY session_id) SELECT b.item_id, concat(s.summaries, ' ', b.text) AS query FROM benchmark b JOIN s ON s.session_id = b.item_id"


@plan
def f44_source_key(d):
    return "SELECT p.page_id, coalesce(nullif(p.url, ''), CASE WHEN p.page_id % 2 = 0 THEN 'even' END, CAST(p.page_id AS STRING)) AS source_key FROM pages p"


@plan
def f45_flat_records(d):
    return "SELECT vec_id, concat('[', CAST(label AS STRING), ']') AS labels_json, " + f"{d.size('embedding')} AS dims FROM embeddings"


@plan
def p03_corpus_predicate(d):
    return f"SELECT doc_id FROM documents WHERE {d.contains('lang', repr('e'))} OR source = 'src1'"


@plan
def p05_contradiction_prefilter(d):
    return f"WITH {FACTS} SELECT fact_id, CASE WHEN toxic = 1 THEN 'contradiction_risk' ELSE 'kept' END AS verdict FROM facts"


@plan
def p06_vector_source_filter(d):
    return "SELECT vec_id FROM embeddings WHERE label IN (1, 3)"


@plan
def j14_case_artifacts(d):
    return f"WITH {CASES}, v AS (SELECT event_id AS evaluation_id, event_id - 1 AS case_id FROM events WHERE event_type = 'purchase') SELECT v.evaluation_id, c.artifact AS target FROM v JOIN cases c ON v.case_id = c.case_id"


@plan
def a09_branch_scores(d):
    return "SELECT user_id % 7 AS branch, round(avg(value), 6) AS score FROM events GROUP BY user_id % 7"


@plan
def a12_bm25_statistics(d):
    w = d.filter(d.split(normalised(d, "text"), " "), "t", "t <> ''")
    return f"WITH e AS (SELECT doc_id, {d.explode(w)} AS tok FROM documents) SELECT tok, count(DISTINCT doc_id) AS df, count(*) AS cf FROM e GROUP BY tok"


@plan
def w11_episodic_composition(d):
    return f"WITH {MESSAGES}, r AS (SELECT session_id, message_id, CASE WHEN sender = 'user' AND seq = 0 THEN 0 WHEN sender = 'assistant' THEN 1 ELSE 2 END AS cls, seq FROM messages), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY cls, seq DESC) AS BIGINT) AS place FROM r) SELECT session_id, message_id, place FROM o WHERE place <= 4"


@plan
def u02_bag_union(d):
    return "SELECT 'documents' AS lane, doc_id AS id FROM documents WHERE lang = 'en' UNION ALL SELECT 'pages', page_id FROM pages UNION ALL SELECT 'benchmark', item_id FROM benchmark"


@plan
def u06_category_edges(d):
    rows = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS topic FROM documents WHERE {any_of(d, 'lower(text)', words)}" for name, words in sorted(lx.TOPICS.items()))
    return f"SELECT concat('doc:', CAST(doc_id AS STRING)) AS source_node, 'HAS_TOPIC' AS relation, topic FROM ({rows}) t"


@plan
def u09_architecture_injection(d):
    return f"WITH {ASKED}, {routed(d)} SELECT query_id, concat('arch:', CAST(n AS STRING)) AS candidate FROM routed CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) x WHERE intent = 'architecture_explanation'"


@plan
def u12_hit_to_candidate(d):
    return f"SELECT doc_id, concat('corpus:', CAST(doc_id AS STRING)) AS id, {token_estimate(d, 'text')} AS tokens, TRUE AS compressible FROM documents"


@plan
def u13_service_route(d):
    return f"WITH {ASKED} SELECT query_id, {any_of(d, 'lower(query)', ('latest', 'today', 'news', 'current'))} AS use_web FROM asked"


@plan
def l07_web_lane(d):
    return f"WITH {queries_cte(d)}, qt AS (SELECT query_id, {d.explode(tokens(d, 'query'))} AS tok FROM queries), pt AS (SELECT page_id, {d.explode(d.distinct(d.filter(d.split('lower(html)', '[^a-z0-9]+'), 't', 'length(t) >= 3')))} AS tok FROM pages), h AS (SELECT query_id, page_id, count(*) AS shared FROM qt JOIN pt ON qt.tok = pt.tok GROUP BY query_id, page_id), s AS (SELECT h.query_id, h.page_id, round(0.1 * shared + CASE WHEN substr(p.url, 1, 8) = 'https://' THEN {D('0.7')} ELSE {D('0.6')} END, 6) AS score FROM h JOIN pages p ON h.page_id = p.page_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS BIGINT) AS rn FROM s) SELECT query_id, page_id, score FROM r WHERE rn <= 5"


@plan
def l08_fast_lanes(d):
    return f"WITH {FACTS}, t AS (SELECT claim_key, fact_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'global' WHEN quality = 1 THEN 'workspace' ELSE 'installation' END AS tier, confidence FROM facts), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY claim_key, tier ORDER BY confidence DESC, fact_id) AS BIGINT) AS rn FROM t), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY claim_key ORDER BY CASE tier WHEN 'installation' THEN 0 WHEN 'workspace' THEN 1 ELSE 2 END, rn) AS BIGINT) AS place FROM r WHERE rn <= 3) SELECT claim_key, tier, fact_id, place FROM k"


@plan
def l13_promoted_by_subtype(d):
    hits = d.size(d.filter(d.list("'the'", "'and'", "'de'"), "t", d.contains("lower(text)", "t")))
    return f"SELECT doc_id, {hits} AS score FROM documents WHERE lang IN ('en', 'fr')"


@plan
def l17_lessons(d):
    return f"WITH {CASES} SELECT case_id, concat(CASE WHEN success = 1 THEN 'Repeat: ' ELSE 'Avoid: ' END, artifact, ' (user ', CAST(user_id AS STRING), ')') AS lesson FROM cases"


@plan
def c05_controller_plan(d):
    return f"WITH {ASKED}, {routed(d)}, l AS (SELECT query_id, intent, {lane_list(d)} AS lanes FROM routed) SELECT query_id, intent, lanes, CASE WHEN intent IN ('exact_recall', 'architecture_explanation', 'planning') THEN 'off' WHEN intent = 'investigative' THEN 'active' ELSE 'passive' END AS discovery FROM l"


@plan
def c08_expand_items(d):
    return f"WITH {MESSAGES} SELECT m.session_id, m.message_id, {d.length('m.text')} AS chars, coalesce(n.message_id, -1) AS next_id FROM messages m LEFT JOIN messages n ON n.session_id = m.session_id AND n.seq = m.seq + 1"


@plan
def c13_pack_graph_adjustment(d):
    """A pack's bonus from its relations: reinforcement, use and support against criticism, within bounds."""
    counts = f"{EDGES}, n AS (SELECT dst, CAST(sum(CASE WHEN relation = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS u, CAST(sum(CASE WHEN relation = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS r, CAST(sum(CASE WHEN relation = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN relation = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS s FROM edges GROUP BY dst)"
    return f"WITH {counts} SELECT dst AS artifact, round(CAST(CASE WHEN u + r + c < 2 THEN 0 ELSE greatest(-4.5, least(5, least(5, 1.6 * r + 0.4 * u + least(1, 0.2 * s)) - least(4.5, 1.5 * c))) END AS DOUBLE), 6) AS adjustment FROM n"


@plan
def c16_document_topics(d):
    return f"WITH e AS (SELECT doc_id, lang, {d.explode(tokens(d, 'text'))} AS tok FROM documents), t AS (SELECT lang AS topic, tok, count(*) AS n FROM e GROUP BY lang, tok), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY n DESC, tok) AS BIGINT) AS rn FROM t) SELECT topic, tok, n, rn FROM r WHERE rn <= 10"
