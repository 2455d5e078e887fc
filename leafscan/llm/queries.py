"""Registered queries of the subpackage: one for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from leafscan.llm import attention_lm, bpe_stream, collision_ann, common as c, conversations, line_quality, lsh_forest, merkle, orc_ids, packing, secrets, sharding, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@register
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


@register
def op2_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_ids.round_trip(c.table(spark, sf_dir, "documents"))


@register
def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.lm_scores(c.table(spark, sf_dir, "documents"))


@register
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(c.table(spark, sf_dir, "documents"))


@register
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(c.table(spark, sf_dir, "documents"))


@register
def op6_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = c.table(spark, sf_dir, "embeddings")
    return collision_ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@register
def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(c.table(spark, sf_dir, "documents"))


@register
def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(c.table(spark, sf_dir, "documents"))


@register
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(c.table(spark, sf_dir, "pages"))


@register
def op10_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_decode(c.table(spark, sf_dir, "documents"))


@register
def op11_conversation_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(c.table(spark, sf_dir, "conversations"))


@register
def op12_merkle_midstates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(c.table(spark, sf_dir, "documents"))


@register
def op13_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(c.table(spark, sf_dir, "documents"))


# The manifest of documents: unsigned CRC-32 of the decimal id, one round of parents after another, then siblings and folds along each path.
ORACLES["op12_merkle_midstates"] = """WITH RECURSIVE
coded AS (SELECT row_number() OVER () AS r, doc_id, lang, n_chars, coalesce('=' || lang, '-') AS tree,
  (SELECT coalesce(octet_length(encode(v)) || ':' || v, '-') FROM (SELECT doc_id::VARCHAR AS v)) AS f_id, coalesce(octet_length(encode(source)) || ':' || source, '-') AS f_source,
  coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS f_lang, coalesce(octet_length(encode(text)) || ':' || text, '-') AS f_text,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
    list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda k: k::BIGINT)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc
  FROM documents),
fields AS (SELECT *, (doc_id IS NOT NULL AND crc % 7 = 0)::INT AS more FROM coded),
leafs AS (SELECT r, doc_id, tree, sha256(f_id || f_source || f_lang || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || f_text) AS leaf,
  sha256(f_id || f_source || f_lang || coalesce(length((n_chars + more)::VARCHAR) || ':' || (n_chars + more), '-') || f_text) AS given FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leafs),
nodes(tree, lvl, i, n, node) AS (SELECT tree, 0, i, n, leaf FROM placed
  UNION ALL SELECT tree, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, i // 2, n),
subs AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, i, n, node) AS (SELECT 0, i, n, node FROM subs
  UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 2, n),
steps AS (
  SELECT p.r, x.lvl, y.node AS sibling, (p.i // (1 << x.lvl)) % 2 AS slot FROM placed p JOIN nodes x ON x.tree = p.tree AND x.n > 1 AND x.i = p.i // (1 << x.lvl)
    LEFT JOIN nodes y ON y.tree = x.tree AND y.lvl = x.lvl AND y.i = xor(x.i, 1)
  UNION ALL SELECT p.r, 1000 + x.lvl, y.node, (s.i // (1 << x.lvl)) % 2 FROM placed p JOIN subs s ON s.tree = p.tree JOIN tops x ON x.n > 1 AND x.i = s.i // (1 << x.lvl)
    LEFT JOIN tops y ON y.lvl = x.lvl AND y.i = xor(x.i, 1)),
lists AS (SELECT r, list({'sibling': coalesce(sibling, ''), 'slot': slot} ORDER BY lvl) AS path FROM steps GROUP BY r),
folds AS (SELECT p.*, coalesce(l.path, []) AS path, list_reduce(list_concat([{'sibling': p.given, 'slot': 0}], coalesce(l.path, [])), lambda a, b:
  {'sibling': sha256(CASE WHEN b.slot = 0 THEN a.sibling || b.sibling ELSE b.sibling || a.sibling END), 'slot': 0}).sibling AS folded_root FROM placed p LEFT JOIN lists l USING (r))
SELECT f.doc_id, f.leaf, s.node AS subroot, t.node AS root, sha256(array_to_string(list_transform(f.path, lambda x: x.sibling), '')) AS proof_sha256, f.folded_root,
  f.folded_root = t.node AS verified FROM folds f JOIN subs s USING (tree), (SELECT node FROM tops WHERE n = 1) t"""

# Roles and digests of the archives: base32 of SHA-1 by its bits, five at a time.
ORACLES["op9_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
d AS (SELECT *, octet_length(encode(h)) AS payload_bytes, array_to_string(list_transform(string_split(sha1(h), ''), lambda x:
  right(((strpos('0123456789abcdef', x) - 1)::INT::BIT)::VARCHAR, 4)), '') AS bits FROM p JOIN f USING (h)),
e AS (SELECT *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 +
  list_sum(list_transform(range(5), lambda j: substr(bits, (5 * k + j + 1)::INT, 1)::INT * (1 << (4 - j)::INT))))::INT, 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM e"""

# Line rules: words of each line, three-word windows of each whole text; the patterns and limits are those of the operator.
ORACLES["op7_line_quality"] = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
split AS (SELECT r, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM cut),
counted AS (SELECT r, line, len(ws) AS n, len(list_filter(ws, lambda w: regexp_matches(w, '[!?#*$%&~^=_+<>|@]{2}$'))) AS marks,
  len(list_filter(ws, lambda w: regexp_matches(w, '[.!?:;…。！？؟]["''”’»)\]]*$'))) AS ends, len(list_filter(ws, lambda w: regexp_matches(w, '^[|»›•>]$'))) AS bars,
  len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS same, regexp_matches(lower(line), '{notices}') AS notice FROM split),
judged AS (SELECT r, line, n, n > 0 AND (bars >= {min_bars} AND bars * 4 >= n - bars OR notice AND n <= {notice_words} OR n >= {min_words} AND (
  marks * 3 >= n OR ends = 0 AND n > {bare_words} OR same * 2 >= n)) AS fails FROM counted),
by_lines AS (SELECT r, sum(n) AS n_words, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
  coalesce(sum(n) FILTER (fails), 0) AS lost_words, count(*) FILTER (fails) AS lost_lines FROM judged GROUP BY r),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (
  SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM d)),
windows AS (SELECT r, k, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM words WINDOW s AS (PARTITION BY r ORDER BY k)),
twice AS (SELECT r, k, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS t FROM windows),
inside AS (SELECT r, t OR coalesce(lag(t) OVER s, false) OR coalesce(lag(t, 2) OVER s, false) AS i FROM twice WINDOW s AS (PARTITION BY r ORDER BY k)),
repeats AS (SELECT r, count(*) FILTER (i) AS n_repeat_words FROM inside GROUP BY r),
base AS (SELECT doc_id, n_words::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  lost_words::BIGINT AS lost_words, lost_lines FROM d JOIN by_lines USING (r) LEFT JOIN repeats USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= {max_loss} * n_words AS kept FROM base"""
for name, value in {**asdict(line_quality.Rules()), "notices": "|".join(line_quality.NOTICES)}.items():
    ORACLES["op7_line_quality"] = ORACLES["op7_line_quality"].replace(f"{{{name}}}", str(value))
