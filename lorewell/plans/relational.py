"""Plans of the relational operators: one SQL text each, rendered by a dialect.

Every plan is a function of a dialect that returns a query over the input tables.  PLANS maps names to plans.
"""

from __future__ import annotations

from lorewell.functions import lexicons as lx
from lorewell.functions.dialect import alnum_tokens, any_of, in_list, normalised, token_estimate, tokens, word_tokens

#: The model's tables over the driver's: session messages, queries, corpus, evidence, facts, executions.
MESSAGES = "messages AS (SELECT conv_id AS session_id, turn AS message_id, turn AS seq, role AS sender, text FROM conversations)"
FACTS = "facts AS (SELECT d.doc_id AS fact_id, d.source AS claim_key, d.lang AS claim_value, d.text, l.quality, l.toxic, CASE WHEN l.quality = 1 THEN 0.85 ELSE 0.55 END AS confidence FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
CASES = "cases AS (SELECT event_id AS case_id, user_id, event_type AS artifact, ts, value, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS success FROM events)"
#: Lexicons that occur in the invented prose, in place of the English defaults.
POSITIVE, NEGATIVE = ("with", "this"), ("from", "that")
TOPICS = {"t_that": ("that", "than"), "t_with": ("with", "this"), "t_from": ("from", "ther", "thon")}
#: Patterns that both engines read alike.
NEWLINE, BLANKS, SENTENCE_ENDS, UNUSUAL = r"\n", r"[ \t\n]+", r"[.\n]+", r"[^a-z0-9\s\-\>:/]"

PLANS = {}


def plan(f):
    PLANS[f.__name__] = f
    return f


def queries_cte(d):
    return f"queries AS (SELECT item_id AS query_id, {normalised(d, 'text')} AS query FROM benchmark)"


def overlap(shared, query_size):
    return f"CAST({shared} AS DOUBLE) / greatest(1, {query_size})"


# ---- scans -----------------------------------------------------------------------------------------------------------


@plan
def s01_document_ids(d):
    return "SELECT doc_id, concat('doc_', substr(sha2_256(text), 1, 16)) AS document_id FROM documents".replace("sha2_256(text)", "sha2(text, 256)" if d.name == "spark" else "sha256(text)")


@plan
def s03_session_log(d):
    return f"WITH {MESSAGES} SELECT session_id, message_id, sender, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq, message_id) AS BIGINT) - 1 AS idx FROM messages"


@plan
def s06_recent_items(d):
    return f"WITH {MESSAGES}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS BIGINT) AS age FROM messages) SELECT session_id, message_id, age FROM r WHERE age <= 3"


@plan
def s09_filtered_cases(d):
    return f"WITH {CASES} SELECT case_id, user_id, artifact FROM cases WHERE artifact = 'purchase' AND success = 1 AND value > 10"


@plan
def s11_edge_scan_both_directions(d):
    return "WITH edges AS (SELECT DISTINCT user_id AS src, CAST(floor(value) AS BIGINT) % 50 AS dst, event_type AS relation FROM events) SELECT src, dst, relation, CASE WHEN src = 7 THEN 'out' ELSE 'in' END AS direction FROM edges WHERE src = 7 OR dst = 7"


@plan
def s15_point_lookups(d):
    return f"WITH {MESSAGES}, wanted AS (SELECT DISTINCT item_id AS session_id FROM benchmark) SELECT m.session_id, m.message_id, {d.length('m.text')} AS n FROM messages m WHERE EXISTS (SELECT 1 FROM wanted w WHERE w.session_id = m.session_id)"


# ---- merges ----------------------------------------------------------------------------------------------------------


@plan
def k01_keep_latest(d):
    return "WITH r AS (SELECT user_id, event_type, event_id, value, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS BIGINT) AS rn FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1"


@plan
def k05_immutable_first_value(d):
    return f"SELECT user_id, event_type, {d.min_by('event_id', 'event_id')} AS created_by, {d.max_by('value', 'event_id')} AS value, count(*) AS versions FROM events GROUP BY user_id, event_type"


@plan
def k07_replace_chunks(d):
    new = "SELECT d.doc_id, 0 AS chunk_index, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
    old = "SELECT doc_id, 0 AS chunk_index, substr(text, 1, 1000) AS text FROM documents UNION ALL SELECT doc_id, 1, substr(text, 1001) FROM documents WHERE length(text) > 1000"
    return f"WITH fresh AS ({new}), old AS ({old}) SELECT doc_id, chunk_index, text FROM fresh UNION ALL SELECT o.doc_id, o.chunk_index, o.text FROM old o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.doc_id = o.doc_id)"


@plan
def k10_evidence_upsert(d):
    sha = "sha2(html, 256)" if d.name == "spark" else "sha256(html)"
    return f"WITH e AS (SELECT page_id, concat_ws('::', url, {sha}) AS evidence_id FROM pages), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY evidence_id ORDER BY page_id DESC) AS BIGINT) AS rn FROM e) SELECT evidence_id, page_id FROM r WHERE rn = 1"


@plan
def k15_session_export(d):
    return f"WITH {MESSAGES}, parts AS (SELECT session_id, message_id, count(*) AS n_parts FROM (SELECT session_id, message_id, {d.explode(d.split('text', NEWLINE))} AS part FROM messages) p GROUP BY session_id, message_id) SELECT m.session_id, count(*) AS messages, CAST(sum(p.n_parts) AS BIGINT) AS parts, {d.join(d.collect('m.sender', 'm.seq'), ',')} AS senders FROM messages m LEFT JOIN parts p ON m.session_id = p.session_id AND m.message_id = p.message_id GROUP BY m.session_id"


@plan
def k17_contradiction_upsert(d):
    return f"WITH {FACTS}, pairs AS (SELECT least(a.fact_id, b.fact_id) AS x, greatest(a.fact_id, b.fact_id) AS y FROM facts a JOIN facts b ON a.claim_key = b.claim_key AND a.claim_value <> b.claim_value AND a.fact_id <> b.fact_id) SELECT concat('wpc:', substr(sha1(concat_ws('|', CAST(x AS STRING), CAST(y AS STRING), 'conflicts_with')), 1, 20)) AS pair_id, x AS a_id, y AS b_id FROM pairs GROUP BY x, y"


# ---- scalar expressions ----------------------------------------------------------------------------------------------


@plan
def f01_token_estimate(d):
    return f"SELECT doc_id, {token_estimate(d, 'text')} AS tokens FROM documents"


@plan
def f02_f03_normalised_tokens(d):
    return f"SELECT doc_id, sha1({normalised(d, 'text')}) AS normalised, {d.size(tokens(d, 'text'))} AS tokens FROM documents"


@plan
def f04_word_tokens(d):
    return f"SELECT doc_id, {d.join(d.sort(word_tokens(d, 'text')), ' ')} AS words FROM documents"


@plan
def f05_alnum_tokens(d):
    return f"SELECT doc_id, {d.join(d.sort(alnum_tokens(d, 'text')), ' ')} AS words FROM documents"


@plan
def f06_graph_tokens(d):
    x = "replace(replace(lower(concat(event_type, ':', CAST(user_id AS STRING), '-', CAST(event_id AS STRING))), ':', ' '), '-', ' ')"
    toks = d.filter(d.split(x, "[ ]+"), "t", "t <> ''")
    return f"SELECT event_id, {d.join(toks, '|')} AS toks FROM events"


def cluster_terms(d, x):
    words = d.filter(d.matches(f"lower({x})", "[a-z0-9_]+"), "t", f"t NOT IN {in_list(lx.CLUSTER_STOPWORDS)}")
    return d.first(d.sort(d.distinct(words)), 4)


@plan
def f07_cluster_terms(d):
    t = cluster_terms(d, "text")
    return f"SELECT doc_id, CASE WHEN {d.size(t)} = 0 THEN 'uncategorized' ELSE {d.join(t, '|')} END AS terms FROM documents"


@plan
def f08_query_signature(d):
    terms = d.first(d.sort(d.filter(word_tokens(d, normalised(d, "text")), "t", f"t NOT IN {in_list(lx.SIGNATURE_STOPWORDS)}")), 12)
    return f"SELECT item_id, {d.join(terms, ' ')} AS signature FROM benchmark"


@plan
def f09_f10_overlap_and_jaccard(d):
    a, b = tokens(d, "a.text"), tokens(d, "b.text")
    shared = d.size(d.both("x", "y"))
    return f"WITH p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, {a} AS x, {b} AS y FROM benchmark a JOIN benchmark b ON a.item_id + 1 = b.item_id) SELECT a_id, b_id, round({overlap(shared, d.size('x'))}, 6) AS overlap, round(CAST({shared} AS DOUBLE) / {d.size(d.union('x', 'y'))}, 6) AS jaccard FROM p"


@plan
def f11_f12_hits_and_occurrences(d):
    hits = d.size(d.filter(d.list("'the'", "'with'", "'que'", "'und'"), "t", d.contains("lower(text)", "t")))
    without = "replace(text, 'the', '')"
    occurrences = d.idiv(f"({d.length('text')} - {d.length(without)})", "3")
    return f"SELECT doc_id, {hits} AS hits, {occurrences} AS occurrences FROM documents"


def hint_rows(d, x, lexicon):
    """array of names whose words a text holds, with their scores as name=score."""
    parts = []
    for name, words in sorted(lexicon.items()):
        n = " + ".join(f"CASE WHEN {d.contains(x, repr(w))} THEN 1 ELSE 0 END" for w in words)
        parts.append(f"CASE WHEN {n} > 0 THEN concat('{name}=', CAST(CAST(least(100, 30 + 20 * ({n})) AS BIGINT) AS STRING)) ELSE '' END")
    return d.filter(d.list(*parts), "t", "t <> ''")


@plan
def f13_lexicon_hints(d):
    return f"SELECT doc_id, {d.join(hint_rows(d, 'lower(text)', TOPICS), ',')} AS topics, {d.join(hint_rows(d, 'lower(text)', lx.CATEGORIES), ',')} AS categories FROM documents"


def polarity(d, toks, positive, negative, strong=()):
    neg, pos = (" OR ".join(d.has(toks, f"'{w}'") for w in words if len(w) >= 3 and "'" not in w) or "FALSE" for words in (negative, positive))
    hard = " OR ".join(d.has(toks, f"'{w}'") for w in strong if len(w) >= 3 and "'" not in w) or "FALSE"
    return f"CASE WHEN {hard} THEN 'negative' WHEN ({neg}) AND NOT ({pos}) THEN 'negative' WHEN ({pos}) AND NOT ({neg}) THEN 'positive' ELSE 'mixed' END"


@plan
def f14_polarity(d):
    return f"WITH t AS (SELECT doc_id, {alnum_tokens(d, 'text')} AS toks FROM documents) SELECT doc_id, {polarity(d, 'toks', POSITIVE, NEGATIVE)} AS data_polarity, {polarity(d, 'toks', lx.POSITIVE, lx.NEGATIVE, lx.STRONG_NEGATIVE)} AS default_polarity FROM t"


def without_speech_act(d, x):
    for p in lx.SPEECH_ACTS:
        x = d.replace_all(x, "(?i)" + p, "")
    x = d.replace_all(x, r"^\s*[:\-]\s*", "")
    return f"trim({d.replace_all(x, BLANKS, ' ')})"


SPOKEN = "spoken AS (SELECT item_id, concat(CASE item_id % 5 WHEN 0 THEN 'The user said that ' WHEN 1 THEN 'Note that  ' WHEN 2 THEN 'I remember: ' WHEN 3 THEN ' - we concluded ' ELSE '' END, text) AS text FROM benchmark)"


@plan
def f15_speech_act(d):
    return f"WITH {SPOKEN} SELECT item_id, {without_speech_act(d, 'text')} AS text FROM spoken"


@plan
def f16_sentences(d):
    parts = d.filter(d.split("text", r"[.\n]+"), "t", "trim(t) <> ''")
    return f"SELECT doc_id, {d.size(parts)} AS sentences, trim({d.at(parts, 1)}) AS first_sentence FROM documents"


def canonical(d, x):
    x = f"lower({without_speech_act(d, x)})"
    x = d.replace_all(d.replace_all(f"replace({x}, '→', '->')", r"\b(the user|user)\s+said\s+", "user "), r"\bpreferences?\b", "prefers")
    return f"trim({d.replace_all(d.replace_all(x, UNUSUAL, ' '), BLANKS, ' ')})"


@plan
def f17_canonical_units(d):
    return f"WITH {SPOKEN} SELECT item_id, {canonical(d, 'text')} AS canonical FROM spoken"


@plan
def f21_namespaces(d):
    return "SELECT event_id, CASE event_type WHEN 'click' THEN 'skills/principle' WHEN 'purchase' THEN 'skills/workflow' WHEN 'error' THEN 'skills/anti_pattern' ELSE concat('skills/', event_type) END AS namespace FROM events"


@plan
def f22_stable_ids(d):
    return "SELECT doc_id, concat('node:', substr(sha1(concat_ws('|', 'document', source, CAST(doc_id AS STRING))), 1, 16)) AS node_id, concat('edge:', substr(sha1(concat_ws('|', source, 'DERIVED_FROM', lang)), 1, 18)) AS edge_id FROM documents"


@plan
def f23_fingerprints(d):
    near = d.join(d.first(d.sort(tokens(d, "text")), 24), " ")
    return f"SELECT doc_id, sha1({normalised(d, 'text')}) AS exact_fp, sha1({near}) AS near_fp FROM documents"


def intent(d, q):
    return "CASE " + " ".join(f"WHEN {any_of(d, q, words)} THEN '{name}'" for name, words in lx.INTENTS) + f" ELSE '{lx.OTHER_INTENT}' END"


ASKED = "asked AS (SELECT item_id AS query_id, concat(CASE item_id % 8 WHEN 0 THEN 'What did we say: ' WHEN 1 THEN 'Investigate ' WHEN 2 THEN 'architecture of ' WHEN 3 THEN 'What do you remember of ' WHEN 4 THEN 'synopsis of the latest ' WHEN 5 THEN 'next steps, verify ' WHEN 6 THEN 'roadmap, current: ' ELSE 'financial audit ' END, text) AS query FROM benchmark)"


@plan
def f25_f26_intent_and_risk(d):
    risk = "CASE " + " ".join(f"WHEN {any_of(d, 'lower(query)', words)} THEN '{name}'" for name, words in lx.RISKS) + " ELSE 'normal' END"
    return f"WITH {ASKED} SELECT query_id, {intent(d, 'lower(query)')} AS intent, {any_of(d, 'lower(query)', lx.WEB_WORDS)} AS web_sensitive, {risk} AS risk FROM asked"


def lane_list(d):
    """Lanes of an intent, comma-joined, with the web lane for web-sensitive queries."""
    base = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in lx.LANES.items()) + " END"
    return f"concat(CASE WHEN intent = 'memory_summary' AND {d.contains('q', repr('about me'))} THEN 'promoted,' ELSE '' END, {base}, CASE WHEN intent IN {in_list(lx.WEB_INTENTS)} AND {any_of(d, 'q', lx.WEB_WORDS)} THEN ',web' ELSE '' END)"


@plan
def f28_web_query_plan(d):
    return f"WITH {ASKED} SELECT query_id, CASE WHEN {any_of(d, 'lower(query)', lx.WEB_WORDS)} THEN 5 ELSE 3 END AS max_results, concat({normalised(d, 'query')}, ' official documentation') AS variant FROM asked"


@plan
def f29_url_trust(d):
    return f"SELECT page_id, CASE WHEN {any_of(d, 'lower(url)', ('wikipedia', 'docs.', 'developer.'))} THEN CAST(0.8 AS DOUBLE) WHEN substr(url, 1, 8) = 'https://' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS trust, coalesce(nullif(url, ''), concat('title:', CAST(page_id AS STRING))) AS source_id FROM pages"


@plan
def f30_age_buckets(d):
    age = d.seconds("ts", "(SELECT max(ts) FROM events)")
    return f"SELECT event_id, CASE WHEN ts IS NULL THEN 'unknown' WHEN {age} <= 3 * 86400 THEN 'hot' WHEN {age} <= 30 * 86400 THEN 'warm' ELSE 'stale' END AS bucket FROM events"


@plan
def f31_ttl_freshness(d):
    age = d.seconds("ts", "(SELECT max(ts) FROM events)")
    return f"SELECT event_id, CASE WHEN {age} <= 3600 * coalesce({d.json_int('props', 'k')}, 72) THEN 'fresh' ELSE 'stale' END AS freshness FROM events"


@plan
def f32_lifecycle(d):
    return f"WITH {FACTS} SELECT fact_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'quarantined' WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'needs_revalidation' WHEN confidence < 0.8 THEN 'stale' WHEN quality = 1 THEN 'trusted' ELSE 'unreviewed' END AS lifecycle FROM facts"


@plan
def f33_weighted_rubric(d):
    items = d.list("value", "value * 0.5", "CAST(user_id % 10 AS DOUBLE)")
    return f"SELECT event_id, round(greatest(0.0, least(1.0, {d.total(items, 'x', 'least(10.0, x) / 30.0')})), 6) AS score FROM events"


@plan
def f34_success_confidence(d):
    return f"WITH {CASES}, c AS (SELECT user_id, CAST(sum(success) AS BIGINT) AS s, CAST(sum(1 - success) AS BIGINT) AS f FROM cases GROUP BY user_id) SELECT user_id, s, f, round(CAST(greatest(0.0, least(1.0, 0.5 + least(0.3, 0.07 * s) - least(0.2, 0.06 * f))) AS DOUBLE), 6) AS confidence FROM c"


@plan
def f37_word_windows(d):
    words = d.filter(d.split("trim(text)", r"[ \t\n]+"), "t", "t <> ''")
    n = d.size("w")
    slice_ = "array_join(slice(w, s + 1, 50), ' ')" if d.name == "spark" else "array_to_string(list_slice(w, s + 1, s + 50), ' ')"
    steps = d.range("CAST(0 AS BIGINT)", f"greatest({n} - 1, 0)", "CAST(40 AS BIGINT)")
    return f"WITH t AS (SELECT doc_id, {words} AS w FROM documents), e AS (SELECT doc_id, w, {d.explode(steps)} AS s FROM t) SELECT doc_id, s AS word_start, sha1({slice_}) AS chunk FROM e"


@plan
def f38_routing_decision(d):
    score = lambda words: " + ".join(f"CASE WHEN {d.contains('q', repr(w))} THEN 1 ELSE 0 END" for w in words)
    best = "greatest(" + ", ".join(f"({score(w)})" for w in TOPICS.values()) + ")"
    return f"WITH t AS (SELECT item_id, lower(text) AS q FROM benchmark) SELECT item_id, CASE WHEN {best} = 0 THEN 'no_hints' WHEN 30 + 20 * {best} >= 70 THEN 'strong' ELSE 'weak' END AS decision FROM t"


@plan
def f42_id_defaults(d):
    return "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE CAST(page_id AS STRING) END, ''), concat('evt:', substr(sha1(url), 1, 16))) AS event_id FROM pages"


# ---- filters ---------------------------------------------------------------------------------------------------------


@plan
def p01_substring_search(d):
    return "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%example.org%' OR lower(html) LIKE '%stlyand%'"


@plan
def p02_tokens_in_any_column(d):
    return f"SELECT doc_id FROM documents WHERE {' AND '.join('(' + ' OR '.join(d.contains(c, repr(t)) for c in ('lower(text)', 'source', 'lang')) + ')' for t in ('en', 'src1', 'the'))}"


@plan
def p04_low_value_messages(d):
    return f"WITH {MESSAGES} SELECT session_id, message_id FROM messages WHERE length(trim(text)) < 30 OR {normalised(d, 'text')} IN ('ok', 'thanks', 'yes', 'no')"


@plan
def p07_source_policy(d):
    return "WITH policy AS (SELECT 'documents_only' AS mode, 'en' AS lang UNION ALL SELECT 'full_memory', 'en' UNION ALL SELECT 'full_memory', 'de' UNION ALL SELECT 'task_memory', 'fr') SELECT p.mode, d.doc_id FROM documents d JOIN policy p ON d.lang = p.lang"


@plan
def p08_session_recall(d):
    return f"WITH {MESSAGES}, hits AS (SELECT session_id, 1 AS source_rank, seq AS ord, concat('message:', CAST(message_id AS STRING)) AS ref FROM messages WHERE {d.contains('lower(text)', repr('the'))} UNION ALL SELECT session_id, 2, seq, concat('part:', CAST(message_id AS STRING)) FROM messages WHERE {d.contains('lower(text)', repr('que'))}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY source_rank, ord) AS BIGINT) AS rn FROM hits) SELECT session_id, ref, rn FROM r WHERE rn <= 4"


# ---- joins -----------------------------------------------------------------------------------------------------------


@plan
def j01_evaluations_of_executions(d):
    return f"WITH {CASES}, evals AS (SELECT event_id AS evaluation_id, event_id - event_id % 3 AS case_id, value AS score FROM events WHERE event_type = 'purchase') SELECT e.evaluation_id, c.case_id, c.artifact, e.score FROM evals e JOIN cases c ON e.case_id = c.case_id"


@plan
def j02_messages_with_labels(d):
    return "SELECT d.doc_id, count(l.quality) AS n, CAST(coalesce(max(l.quality), -1) AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id"


@plan
def j03_lineage_recovery(d):
    lineage = "lineage AS (SELECT session_id, CASE WHEN message_id % 3 = 0 THEN -1 ELSE message_id END AS want_id, CASE WHEN message_id % 3 = 1 THEN -1 ELSE seq END AS want_idx, message_id AS snapshot_id FROM messages)"
    return f"WITH {MESSAGES}, {lineage} SELECT l.session_id, l.snapshot_id, CASE WHEN a.message_id IS NOT NULL THEN 'id' WHEN b.message_id IS NOT NULL THEN 'index' ELSE 'snapshot' END AS recovered_from FROM lineage l LEFT JOIN messages a ON l.session_id = a.session_id AND l.want_id = a.message_id LEFT JOIN messages b ON l.session_id = b.session_id AND l.want_idx = b.seq"


@plan
def j04_not_yet_compacted(d):
    return f"WITH {MESSAGES}, done AS (SELECT session_id, message_id FROM messages WHERE sender = 'assistant') SELECT m.session_id, m.message_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.session_id = m.session_id AND x.message_id = m.message_id)"


EDGES = "edges AS (SELECT DISTINCT user_id AS src, CAST(floor(value) AS BIGINT) % 40 AS dst, event_type AS relation FROM events)"


@plan
def j05_graph_neighbours(d):
    return f"WITH {EDGES}, both_ways AS (SELECT src AS node, dst AS neighbour FROM edges UNION SELECT dst, src FROM edges) SELECT node, count(*) AS degree, min(neighbour) AS first_neighbour FROM both_ways WHERE node <> neighbour GROUP BY node"


@plan
def j06_support_links(d):
    return f"WITH {EDGES} SELECT e.src, {d.join(d.collect_set('e.relation'), ',')} AS relations, count(*) AS links FROM edges e WHERE e.relation IN ('purchase', 'click') GROUP BY e.src"


@plan
def j07_token_overlap_join(d):
    q = f"q AS (SELECT item_id, {d.explode(tokens(d, 'text'))} AS tok FROM benchmark)"
    e = f"e AS (SELECT conv_id, turn, {d.explode(tokens(d, 'text'))} AS tok FROM conversations)"
    return f"WITH {q}, {e}, n AS (SELECT item_id, conv_id, turn, count(*) AS shared FROM q JOIN e ON q.tok = e.tok GROUP BY item_id, conv_id, turn), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, conv_id, turn) AS BIGINT) AS rn FROM n) SELECT item_id, conv_id, turn, shared, rn FROM r WHERE rn <= 5"


@plan
def j08_claim_conflicts(d):
    return f"WITH {FACTS} SELECT a.fact_id AS a_id, b.fact_id AS b_id, a.claim_key, a.claim_value AS a_value, b.claim_value AS b_value FROM facts a JOIN facts b ON a.claim_key = b.claim_key AND a.fact_id < b.fact_id AND a.claim_value <> b.claim_value"


@plan
def j09_polarity_contradictions(d):
    t = f"t AS (SELECT item_id, {alnum_tokens(d, 'text')} AS toks FROM benchmark)"
    p = f"p AS (SELECT item_id, toks, {polarity(d, 'toks', ('with', 'this', 'was'), ('from', 'that', 'for'))} AS pol FROM t)"
    e = f"e AS (SELECT item_id, pol, {d.explode('toks')} AS tok FROM p WHERE pol <> 'mixed')"
    return f"WITH {t}, {p}, {e}, n AS (SELECT a.item_id AS a_id, b.item_id AS b_id, count(*) AS shared FROM e a JOIN e b ON a.tok = b.tok AND a.item_id < b.item_id AND a.pol <> b.pol GROUP BY a.item_id, b.item_id) SELECT a_id, b_id, shared, round(CAST(least(1.0, 0.3 + 0.1 * shared) AS DOUBLE), 6) AS strength FROM n WHERE shared >= 2"


@plan
def j11_pattern_success(d):
    return f"WITH {CASES}, patterns AS (SELECT DISTINCT artifact FROM cases), good AS (SELECT artifact, user_id FROM cases WHERE success = 1 AND value > 20), bad AS (SELECT artifact, user_id FROM cases WHERE value <= 5) SELECT p.artifact, (SELECT count(DISTINCT g.user_id) FROM good g WHERE g.artifact = p.artifact) AS successes, (SELECT count(DISTINCT b.user_id) FROM bad b WHERE b.artifact = p.artifact) AS failures FROM patterns p"


@plan
def j12_relation_counts(d):
    return f"WITH {EDGES}, nodes AS (SELECT DISTINCT user_id AS node FROM events) SELECT n.node, CAST(sum(CASE WHEN e.relation = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS used, CAST(sum(CASE WHEN e.relation = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS reinforced, CAST(sum(CASE WHEN e.relation = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS criticised FROM nodes n LEFT JOIN edges e ON e.dst = n.node GROUP BY n.node"


@plan
def j13_artifact_to_chunk(d):
    return "SELECT a.doc_id AS artifact_id, b.doc_id AS chunk_doc FROM documents a JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 10 AND a.doc_id % 10 <> 0"


@plan
def j15_related_parts(d):
    parts = "parts AS (SELECT conv_id AS s, turn AS id, turn % 3 AS call, CASE WHEN turn > 1 THEN turn - 2 END AS retry_of FROM conversations)"
    return f"WITH {parts} SELECT a.s, a.id, b.id AS other FROM parts a JOIN parts b ON a.s = b.s AND a.call = b.call AND a.id <> b.id UNION SELECT a.s, a.id, b.id FROM parts a JOIN parts b ON a.s = b.s AND a.retry_of = b.id UNION SELECT a.s, a.id, b.id FROM parts a JOIN parts b ON a.s = b.s AND b.retry_of = a.id"


# ---- aggregations ----------------------------------------------------------------------------------------------------


@plan
def a01_lane_counts(d):
    return f"SELECT lang AS lane, count(*) AS n, CAST(sum({token_estimate(d, 'text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang"


@plan
def a02_cluster_coverage(d):
    return f"SELECT lang AS lane, {d.join(d.collect_set('source'), ',')} AS clusters FROM documents GROUP BY lang"


@plan
def a03_compaction_stats(d):
    return f"WITH {MESSAGES} SELECT session_id, count(*) AS messages, CAST(sum(CASE WHEN length(trim(text)) < 30 THEN 1 ELSE 0 END) AS BIGINT) AS quarantined FROM messages GROUP BY session_id"


@plan
def a04_contradiction_summary(d):
    return f"WITH {FACTS}, c AS (SELECT a.fact_id AS x, b.claim_value AS v FROM facts a JOIN facts b ON a.claim_key = b.claim_key AND a.fact_id <> b.fact_id AND a.claim_value <> b.claim_value) SELECT x AS fact_id, count(*) AS open_conflicts, {d.join(d.collect_set('v'), ',')} AS classes FROM c GROUP BY x"


@plan
def a05_a06_outcomes(d):
    return f"WITH {CASES} SELECT artifact, count(DISTINCT user_id) AS sources, count(DISTINCT CASE WHEN success = 1 THEN case_id END) AS successes, count(DISTINCT CASE WHEN success = 0 THEN case_id END) AS failures, round(max(value), 6) AS best FROM cases GROUP BY artifact"


@plan
def a07_durable_unit_merge(d):
    key = normalised(d, "text")
    return f"WITH u AS (SELECT doc_id, concat('proposition:', sha1({key})) AS unit_key, CAST(70 + length(text) % 7 AS BIGINT) AS confidence, source FROM documents), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY unit_key ORDER BY confidence DESC, doc_id) AS BIGINT) AS rn, count(*) OVER (PARTITION BY unit_key) AS dedup_count FROM u) SELECT unit_key, doc_id AS winner, dedup_count FROM r WHERE rn = 1"


@plan
def a08_artifact_merge(d):
    return f"WITH u AS (SELECT doc_id, sha1({normalised(d, 'text')}) AS k, n_chars % 5 AS confidence FROM documents), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY confidence DESC, doc_id DESC) AS BIGINT) AS rn FROM u) SELECT k, doc_id AS winner FROM r WHERE rn = 1"


@plan
def a10_latency_report(d):
    return "SELECT event_type, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(median(value), 6) AS p50 FROM events GROUP BY event_type"


@plan
def a11_metric_delta(d):
    return "WITH b AS (SELECT event_type AS k, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY event_type), a AS (SELECT event_type AS k, avg(value) AS v FROM events WHERE user_id % 2 = 1 GROUP BY event_type) SELECT coalesce(b.k, a.k) AS metric, round(coalesce(a.v, 0.0) - coalesce(b.v, 0.0), 6) AS delta FROM b FULL OUTER JOIN a ON a.k = b.k"


# ---- ranking ---------------------------------------------------------------------------------------------------------


@plan
def w02_recency_ramp(d):
    return f"WITH {MESSAGES}, r AS (SELECT session_id, message_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM messages) SELECT session_id, message_id, round(greatest(0.05, 1.0 - (n - i) / CAST(n + 1 AS DOUBLE)), 6) AS older, round(1.0 - (n - i - 1) / CAST(n AS DOUBLE), 6) AS fresh FROM r"


@plan
def w03_w04_tail_and_chunks(d):
    return f"WITH {MESSAGES}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS up, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS BIGINT) AS down FROM messages) SELECT session_id, message_id, CASE WHEN down <= 2 THEN 'fresh_tail' ELSE 'older' END AS part, CAST(floor((up - 1) / 3.0) AS BIGINT) AS chunk FROM r"


@plan
def w05_neighbour_overlap(d):
    spans = "spans AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS stop, length(text) AS n FROM conversations), e AS (SELECT conv_id, turn, stop - n - 20 AS start, stop FROM spans)"
    return f"WITH {spans} SELECT conv_id, turn, CAST(greatest(0, coalesce(lag(stop) OVER (PARTITION BY conv_id ORDER BY turn) - start, 0)) AS BIGINT) AS before, CAST(greatest(0, coalesce(stop - lead(start) OVER (PARTITION BY conv_id ORDER BY turn), 0)) AS BIGINT) AS after FROM e"


@plan
def w06_best_per_key(d):
    return "WITH r AS (SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS rn FROM events) SELECT user_id, event_id, round(value, 6) AS score FROM r WHERE rn = 1"


@plan
def w07_first_place_last_value(d):
    return f"SELECT sha1(text) AS k, min(doc_id) AS place, {d.max_by('source', 'doc_id')} AS value FROM documents GROUP BY sha1(text)"


@plan
def w08_lane_priority(d):
    return "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 999 END, doc_id) AS BIGINT) AS place FROM documents"


@plan
def w09_promoted_order(d):
    return f"WITH {FACTS} SELECT claim_key, fact_id, CAST(row_number() OVER (PARTITION BY claim_key ORDER BY CASE WHEN quality = 1 THEN 0 ELSE 1 END, toxic, -confidence, fact_id) AS BIGINT) AS place FROM facts"


@plan
def w10_tier_caps(d):
    return f"WITH {FACTS}, t AS (SELECT fact_id, claim_key, CASE WHEN confidence > 0.8 THEN 'global' ELSE 'workspace' END AS tier FROM facts), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY claim_key, tier ORDER BY fact_id) AS BIGINT) AS rn FROM t) SELECT claim_key, tier, fact_id FROM r WHERE rn <= 3"


@plan
def w12_anchor_reorder(d):
    return "WITH r AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS best, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS BIGINT) AS newest FROM events) SELECT user_id, event_id, CASE WHEN best <= 2 THEN 'front' WHEN newest <= 2 THEN 'back' ELSE 'middle' END AS place FROM r"


@plan
def w13_web_cap(d):
    return "WITH r AS (SELECT source, doc_id, lang, sum(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS web FROM documents) SELECT source, doc_id FROM r WHERE lang <> 'fr' OR web <= 2"


@plan
def w14_type_quota(d):
    return "WITH r AS (SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS BIGINT) AS rn FROM events), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type, rn) AS BIGINT) AS place FROM r WHERE rn <= CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) SELECT user_id, event_id, event_type, place FROM q WHERE place <= 6"


@plan
def w15_branch_order(d):
    return "WITH b AS (SELECT user_id, event_type, round(avg(value), 6) AS score, count(*) AS n FROM events GROUP BY user_id, event_type), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, n DESC, event_type) AS BIGINT) AS rn FROM b) SELECT user_id, event_type, score, CASE WHEN rn <= 2 THEN 'kept' ELSE 'rejected_rank' END AS verdict FROM r"


@plan
def w16_positional_scores(d):
    return "WITH r AS (SELECT source, doc_id, lang, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS i FROM documents) SELECT source, doc_id, round(CAST(1.0 AS DOUBLE) / i + CASE lang WHEN 'en' THEN 0.2 WHEN 'de' THEN 0.1 ELSE 0.0 END, 6) AS score FROM r"


@plan
def w17_keep_last_history(d):
    return "WITH r AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS BIGINT) AS age FROM events) SELECT user_id, event_id FROM r WHERE age <= 20"


# ---- routing and composition -----------------------------------------------------------------------------------------


def routed(d):
    return f"routed AS (SELECT query_id, lower(query) AS q, {intent(d, 'lower(query)')} AS intent FROM asked)"


@plan
def u01_lane_routing(d):
    return f"WITH {ASKED}, {routed(d)}, l AS (SELECT query_id, intent, {lane_list(d)} AS lanes FROM routed) SELECT query_id, intent, {d.explode(d.split('lanes', ','))} AS lane FROM l"


@plan
def u03_ordered_union(d):
    return "WITH u AS (SELECT source, 1 AS rank, doc_id AS id FROM documents WHERE lang = 'en' UNION ALL SELECT source, 2, doc_id FROM documents WHERE lang = 'fr'), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY rank, id) AS BIGINT) AS rn FROM u) SELECT source, rank, id FROM r WHERE rn <= 8"


@plan
def u04_distinct_merge(d):
    return f"SELECT a.item_id, {d.size(d.union(tokens(d, 'a.text'), tokens(d, 'b.text')))} AS merged FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id + 1"


@plan
def u05_category_pruning(d):
    return f"WITH t AS (SELECT source, doc_id, CASE WHEN {any_of(d, 'lower(text)', TOPICS['t_with'])} THEN 1 ELSE 0 END AS fits FROM documents), r AS (SELECT *, max(fits) OVER (PARTITION BY source) AS any_fit FROM t), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS rn FROM r WHERE any_fit = 0 OR fits = 1) SELECT source, doc_id FROM k WHERE rn <= 4"


@plan
def u07_clusters(d):
    t = cluster_terms(d, "text")
    seed = f"concat_ws('|', 'corpus', 'chunk', CASE WHEN {d.size(t)} = 0 THEN 'uncategorized' ELSE {d.join(t, '|')} END)"
    return f"SELECT doc_id, concat('cl:', substr(sha1({seed}), 1, 10)) AS cluster_id FROM documents"


@plan
def u11_context_partition(d):
    return f"SELECT source, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS exact_items, {d.join(d.collect('CAST(doc_id AS STRING)', 'doc_id'), ',')} AS ids FROM documents GROUP BY source"


# ---- lanes -----------------------------------------------------------------------------------------------------------


def scored(d):
    """Query and message token counts through an inverted index: hits(query_id, session_id, message_id, shared, nq)."""
    q = f"{queries_cte(d)}, qt AS (SELECT query_id, {tokens(d, 'query')} AS toks FROM queries), qe AS (SELECT query_id, {d.size('toks')} AS nq, {d.explode('toks')} AS tok FROM qt)"
    m = f"{MESSAGES}, me AS (SELECT session_id, message_id, {d.explode(tokens(d, 'text'))} AS tok FROM messages)"
    return f"{q}, {m}, hits AS (SELECT query_id, session_id, message_id, count(*) AS shared, max(nq) AS nq FROM qe JOIN me ON qe.tok = me.tok GROUP BY query_id, session_id, message_id)"


@plan
def l01_lexical_lane(d):
    s = overlap("shared", "nq")
    return f"WITH {scored(d)}, s AS (SELECT query_id, session_id, message_id, round({s}, 6) AS lexical_score FROM hits), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, session_id, message_id) AS BIGINT) AS rn FROM s) SELECT query_id, session_id, message_id, lexical_score, round(greatest(0.0, lexical_score - 0.1), 6) AS semantic_score, CAST(0.65 AS DOUBLE) AS trust_score FROM r WHERE rn <= 8"


@plan
def l02_semantic_lane(d):
    sizes = f"sizes AS (SELECT session_id, message_id, {d.size(tokens(d, 'text'))} AS nm FROM messages)"
    return f"WITH {scored(d)}, {sizes}, s AS (SELECT h.query_id, h.session_id, h.message_id, round(CAST(h.shared AS DOUBLE) / (h.nq + z.nm - h.shared), 6) AS semantic_score FROM hits h JOIN sizes z ON h.session_id = z.session_id AND h.message_id = z.message_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, session_id, message_id) AS BIGINT) AS rn FROM s) SELECT query_id, session_id, message_id, semantic_score, round(greatest(0.0, semantic_score - 0.05), 6) AS lexical_score FROM r WHERE rn <= 8"


@plan
def l04_promoted_lane(d):
    """Query tokens found among a fact's tokens, through an inverted index; confidence counts as trust."""
    q = f"{queries_cte(d)}, qe AS (SELECT query_id, {d.explode(tokens(d, 'query'))} AS tok FROM queries), fe AS (SELECT fact_id, confidence, {d.explode(tokens(d, 'text'))} AS tok FROM facts WHERE quality = 1)"
    return f"WITH {FACTS}, {q}, s AS (SELECT query_id, fact_id, max(confidence) AS confidence, count(*) AS hits FROM qe JOIN fe ON qe.tok = fe.tok GROUP BY query_id, fact_id), r AS (SELECT query_id, fact_id, round(CAST(0.2 + least(0.6, 0.08 * hits) AS DOUBLE), 6) AS lexical_score, round(CAST(least(1.0, confidence) AS DOUBLE), 6) AS trust_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, fact_id) AS BIGINT) AS rn FROM s) SELECT query_id, fact_id, lexical_score, trust_score FROM r WHERE rn <= 8"


@plan
def l09_bm25(d):
    """Okapi BM25 with k1 1.5, b 0.75; a negative idf counts as a quarter of the mean idf."""
    words = lambda x: d.filter(d.split(normalised(d, x), " "), "t", "t <> ''")
    return f"""WITH {queries_cte(d)}, q AS (SELECT query_id, {d.explode(tokens(d, 'query'))} AS tok FROM queries),
dw AS (SELECT doc_id, {words('text')} AS w FROM documents), dl AS (SELECT doc_id, {d.size('w')} AS n FROM dw),
st AS (SELECT count(*) AS docs, avg(n) AS mean FROM dl),
tf AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, {d.explode('w')} AS tok FROM dw) x GROUP BY doc_id, tok),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
raw AS (SELECT tok, ln(docs - df + 0.5) - ln(df + 0.5) AS idf FROM df CROSS JOIN st),
m AS (SELECT avg(idf) AS mean_idf FROM raw),
idf AS (SELECT tok, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM raw CROSS JOIN m),
s AS (SELECT q.query_id, tf.doc_id, round(sum(idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl.n / st.mean))), 4) AS score
 FROM q JOIN tf ON q.tok = tf.tok JOIN idf ON idf.tok = tf.tok JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY q.query_id, tf.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS BIGINT) AS rn FROM s WHERE score > 0)
SELECT query_id, doc_id, score FROM r WHERE rn <= 5"""


@plan
def l11_lexical_store(d):
    return f"WITH {scored(d)}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, session_id, message_id) AS BIGINT) AS rn FROM hits) SELECT query_id, session_id, message_id, shared AS score FROM r WHERE rn <= 5"


@plan
def l12_fallback_to_latest(d):
    return f"WITH {MESSAGES}, latest AS (SELECT session_id, max(message_id) AS message_id FROM messages GROUP BY session_id), hit AS (SELECT session_id, min(message_id) AS message_id FROM messages WHERE {d.contains('lower(text)', repr('onenst'))} GROUP BY session_id) SELECT l.session_id, coalesce(h.message_id, l.message_id) AS message_id, h.message_id IS NULL AS fallback FROM latest l LEFT JOIN hit h ON l.session_id = h.session_id"


@plan
def l14_episodic_like(d):
    return f"WITH {MESSAGES} SELECT session_id, message_id, CAST(1.0 AS DOUBLE) AS score FROM messages WHERE lower(text) LIKE '%with the%'"


@plan
def l19_best_and_weak(d):
    return f"WITH {CASES}, r AS (SELECT user_id, case_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, case_id) AS BIGINT) AS best, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, case_id) AS BIGINT) AS weak FROM cases) SELECT user_id, case_id, best <= 2 AS is_best, weak <= 2 AS is_weak FROM r WHERE best <= 2 OR weak <= 2"


# ---- sessions, promotion, skills -------------------------------------------------------------------------------------


@plan
def c07_compaction(d):
    chunk = f"WITH {MESSAGES}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS up, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS BIGINT) AS down FROM messages WHERE length(trim(text)) >= 30), e AS (SELECT *, CAST(floor((up - 1) / 3.0) AS BIGINT) AS chunk FROM n WHERE down > 2)"
    return f"{chunk} SELECT session_id, chunk, substr({d.join(d.collect('text', 'seq'), ' ')}, 1, 200) AS summary, {d.join(d.collect('CAST(message_id AS STRING)', 'seq'), ',')} AS lineage, sha1(concat_ws('|', CAST(session_id AS STRING), CAST(chunk AS STRING))) AS segment_id FROM e GROUP BY session_id, chunk"


@plan
def c10_exact_reasoning_fold(d):
    return f"WITH p AS (SELECT doc_id, sha1({normalised(d, 'text')}) AS fp, source FROM documents) SELECT fp, min(doc_id) AS pattern_id, count(*) AS reuse_count, {d.join(d.collect_set('source'), ',')} AS provenance FROM p GROUP BY fp"


@plan
def c14_graph_recorders(d):
    return "SELECT DISTINCT concat('document:', source) AS source_node, 'DERIVED_FROM' AS relation, concat('lang:', lang) AS target_node FROM documents UNION ALL SELECT DISTINCT concat('user:', CAST(user_id AS STRING)), 'RESOLVED_BY', concat('artifact:', event_type) FROM events WHERE event_type <> 'error'"


@plan
def c15_window_chunks(d):
    steps = d.range("CAST(0 AS BIGINT)", "greatest(n_chars - 1, 0)", "CAST(924 AS BIGINT)")
    return f"WITH e AS (SELECT doc_id, text, n_chars, {d.explode(steps)} AS s FROM documents) SELECT doc_id, s AS char_start, least(s + 1024, n_chars) AS char_end, sha1(substr(text, CAST(s AS INT) + 1, 1024)) AS chunk FROM e"


@plan
def c17_tuning_proposals(d):
    return "WITH m AS (SELECT event_type AS metric, avg(CASE WHEN user_id % 2 = 0 THEN value END) AS before, avg(CASE WHEN user_id % 2 = 1 THEN value END) AS after FROM events GROUP BY event_type) SELECT metric, CASE WHEN after - before > 0.5 THEN 'propose' ELSE 'keep_baseline' END AS proposal FROM m"
