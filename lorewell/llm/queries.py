"""The queries of the operators, with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_encode
from .common import table
from .dac import token_ids
from .decontam import find_leaks
from .langid import language_report
from .merkle import verified_rows
from .near_dedup import near_duplicates
from .pii import pii_report
from .piece_bpe import piece_encode
from .secrets import secret_report
from .trie import prefix_rollups
from .urlfilter import judge_urls
from .warc import archived
from .winnow import edited_likeness


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=0.85)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    return bpe_encode(table(spark, sf_dir, "documents"), tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN, output="digests")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    return token_ids(table(spark, sf_dir, "documents"), tok.path("byte_bpe_50k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    return piece_encode(table(spark, sf_dir, "documents"), tok.path("piece_bpe_32k.model"), output="digests")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_rollups(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_rows(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_winnowing": op4_winnowing,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_near_dedup": op7_near_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_ids": op9_token_ids,
    "op10_secret_scan": op10_secret_scan,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Near-duplicates by all shared shingles and reachability; the other operators' results SQL can't express.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda t: t <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.k >= 85 * (x.n + y.n - s.k)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id
), least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

#: A table of crc32's 256 steps, for the unsigned crc32 of a decimal number.
_CRC_TABLE = """crc_steps(i, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""


def _crc32(number: str) -> str:
    """SQL of the crc32 of a number's decimal digits, where crc_table is joined."""
    return f"xor(list_reduce([4294967295] || list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


#: Every level of both trees by grouping, proofs and folds by joining a leaf with its parents of all levels.
MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, leaves AS (
  SELECT doc_id, coalesce(':' || source, '-') AS tree, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    CASE WHEN {_crc32("doc_id")} % 5 = 0 AND text IS NOT NULL THEN sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")))}) END AS changed
  FROM documents, crc_table
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
up(tree, lvl, pos, pre, n) AS (
  SELECT tree, 1, pos // 16, string_agg(leaf, '' ORDER BY pos), count(*) FROM placed GROUP BY tree, pos // 16
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, string_agg(sha256(pre), '' ORDER BY pos), count(*) FROM up WHERE NOT (pos = 0 AND n = 1) GROUP BY tree, lvl, pos // 16
), subroots AS (SELECT tree, pre AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM up WHERE pos = 0 AND n = 1),
top(lvl, pos, pre, n) AS (
  SELECT 1, place // 16, string_agg(subroot, '' ORDER BY place), count(*) FROM subroots GROUP BY place // 16
  UNION ALL
  SELECT lvl + 1, pos // 16, string_agg(sha256(pre), '' ORDER BY pos), count(*) FROM top WHERE NOT (pos = 0 AND n = 1) GROUP BY lvl, pos // 16
), entries AS (
  SELECT p.tree, p.pos, u.lvl, u.pre, (p.pos // power(16, u.lvl - 1)::BIGINT % 16)::INT AS slot
  FROM placed p JOIN up u ON u.tree = p.tree AND u.pos = p.pos // power(16, u.lvl)::BIGINT AND NOT (u.pos = 0 AND u.n = 1)
  UNION ALL
  SELECT p.tree, p.pos, 1000 + t.lvl, t.pre, (s.place // power(16, t.lvl - 1)::BIGINT % 16)::INT
  FROM placed p JOIN subroots s ON s.tree = p.tree JOIN top t ON t.pos = s.place // power(16, t.lvl)::BIGINT AND NOT (t.pos = 0 AND t.n = 1)
), paths AS (
  SELECT tree, pos, string_agg(pre[1 : 64 * slot] || pre[64 * slot + 65 :], '' ORDER BY lvl) AS others, list(lpad(slot::VARCHAR, 2, '0') || pre ORDER BY lvl) AS steps
  FROM entries GROUP BY tree, pos
), proofs AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT pre FROM top WHERE pos = 0 AND n = 1) AS root, sha256(coalesce(h.others, '')) AS proof_sha256,
    list_reduce([coalesce(p.changed, p.leaf)] || coalesce(h.steps, []), lambda h, e: sha256(e[3 : 2 + 64 * e[1 : 2]::INT] || h || e[3 + 64 * e[1 : 2]::INT + 64 :])) AS folded_root
  FROM placed p JOIN subroots s ON s.tree = p.tree LEFT JOIN paths h ON h.tree = p.tree AND h.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM proofs
"""

#: Every prefix of every rebuilt conversation as an array of turns, grouped; subtrees by all prefixes of every node.
TRIE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT DISTINCT conv_id, ({_crc32("conv_id")} % 4)::INT AS h FROM turns, crc_table),
steps AS (
  SELECT c.conv_id, 0 AS own, t.pos, {{'role': t.role, 'text': t.text}} AS step FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, {{'role': t.role, 'text': t.text}} FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h
), paths AS (
  SELECT c.conv_id, coalesce(list(s.step ORDER BY s.own, s.pos) FILTER (s.step IS NOT NULL), []) AS path FROM convs c LEFT JOIN steps s ON s.conv_id = c.conv_id GROUP BY c.conv_id
), members AS (SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path FROM paths),
nodes AS (
  SELECT depth, path[1 : depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN len(path) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY depth, path[1 : depth]
), sized AS (
  SELECT *, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(prefix[depth].text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) END AS saves FROM nodes
), kids AS (SELECT depth - 1 AS depth, prefix[1 : depth - 1] AS prefix, count(*) AS n FROM sized WHERE depth > 0 GROUP BY ALL),
under AS (SELECT n.saves, coalesce(k.n, 0) = 0 AS leaf, unnest(list_transform(range(n.depth + 1), lambda d: n.prefix[1 : d])) AS prefix FROM sized n LEFT JOIN kids k USING (depth, prefix)),
totals AS (SELECT prefix, sum(saves)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM under GROUP BY prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM sized n JOIN totals t ON t.prefix = n.prefix LEFT JOIN kids k ON k.prefix = n.prefix LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : n.depth - 1]
"""

ORACLE_SQL: dict[str, str] = {"op7_near_dedup": NEAR_DEDUP_SQL, "op12_prefix_trie": TRIE_SQL, "op13_merkle_manifest": MERKLE_SQL}
