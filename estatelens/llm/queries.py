"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_slack, chat_parts, fm_index, host_rules, html_templates, icws, license_join, ngram_lm, prefix_trie, quality_knn, suffix_dedup, toxicity, whitening
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", *(f"rules.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), "kept")


ORACLES["op4_host_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, a, lead(a) OVER s AS b, lead(a, 2) OVER s AS c FROM p WINDOW s AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, c IS NOT NULL AND count(*) OVER (PARTITION BY r, a, b, c) > 1 AS twice FROM g),
k AS (SELECT r, twice OR coalesce(lag(twice) OVER s, false) OR coalesce(lag(twice, 2) OVER s, false) AS hit
      FROM h WINDOW s AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, count(*) FILTER (hit) AS n_repeat_words FROM k GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, d.source, len(w.w) AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, len(l.l) AS n_lines, coalesce(n.n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT source, count(*)::DOUBLE AS n,
        count(*) FILTER (base_failed OR n_symbols > 0.1::DOUBLE * word_chars OR n_dup_lines > 0.3::DOUBLE * n_lines)::DOUBLE AS f
      FROM b WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT sum(f) / sum(n) AS mu, count(*) / sum(n) AS per FROM f),
v AS (SELECT mu, sum(n * (f / n - mu) * (f / n - mu)) / sum(n) - least(avg(mu * (1 - mu) / n), mu * (1 - mu) * any_value(per)) AS v
      FROM f, t GROUP BY mu),
s AS (SELECT mu, CASE WHEN v <= 0 THEN 1000 ELSE least(1000, greatest(2, mu * (1 - mu) / v - 1)) END AS k FROM v),
bad AS (SELECT source FROM f, s WHERE (f + mu * k) / (n + k) > 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND source NOT IN (SELECT source FROM bad) IS NOT FALSE AS kept
FROM b
"""


@query
def op9_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


@query
def op5_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SETS = license_join.template_sets(license_join.TEMPLATES)
_TEMPLATE_ROWS = ", ".join(
    f"({n}, '{label}', {words!r}, {others!r}::INTEGER[])"
    for (n, others), (label, words) in zip(license_join.alike(_SETS), _SETS))
_HALF = license_join.half_block(license_join.TEMPLATES)
ORACLES["op5_license_join"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
low AS (SELECT r, doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM d),
w AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
p AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM w),
s AS (SELECT r, i, a, lead(a) OVER x AS b, lead(a, 2) OVER x AS c FROM p WINDOW x AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' THEN 'apache'
        WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label FROM s),
base AS (SELECT r, count(*) AS n, min(i) AS f, max(i) AS l, list(DISTINCT label) AS labels FROM h WHERE label IS NOT NULL GROUP BY r),
t(n, label, words, others) AS (VALUES """ + _TEMPLATE_ROWS + r"""),
b AS (SELECT r, w, unnest(range(0, len(w), """ + str(_HALF) + r""")) AS pos FROM w),
bt AS (SELECT r, pos, list_distinct(w[pos + 1:pos + """ + str(2 * _HALF) + r"""]) AS w FROM b),
o AS (SELECT r, pos, t.n AS k, label, others, len(words) AS size, len(list_intersect(bt.w, words)) AS n FROM bt, t),
k AS (SELECT *, n::DOUBLE / size AS share FROM o WHERE n >= ceil(0.9 * size - 1e-9)),
g AS (SELECT x.r, x.label, x.share FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.r = x.r AND y.pos = x.pos
        AND list_contains(x.others, y.k) AND (y.share > x.share OR (y.share = x.share AND (y.size > x.size OR (y.size = x.size AND y.k > x.k)))))),
m AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(list_aggregate(list_sort(base.labels), 'string_agg', ','), '') AS base_labels,
  coalesce(list_aggregate(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), 'string_agg', ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1 ELSE coalesce(m.share, 0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN m USING (r)
"""


@query
def op10_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract(table(spark, sf_dir, "pages"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), passages="count")


@query
def op6_icws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


CHAT_TEXT = r"\### Assistant: </turn> ok"  # what both turns of the added conversation say


@query
def op11_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", CHAT_TEXT), (-7, 1, "assistant", CHAT_TEXT)], turns.schema)
    return chat_parts.digests(chat_parts.format_chats(turns.unionByName(added)))


ORACLES["op11_chat_parts"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '""" + CHAT_TEXT + r"""' UNION ALL SELECT -7, 1, 'assistant', '""" + CHAT_TEXT + r"""'),
e AS (SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)(turn|/turn|image|audio|document)>', '<\\\1\2>', 'g') AS r,
  regexp_replace(text, '<(\\*)(turn|/turn|image|audio|document)>', '<\\\1\2>', 'g') AS c FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn>') + length(r) + 1 + length(c) + length('</turn>') + 1)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM e GROUP BY conv_id
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query
def op12_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLES["op13_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role,
  coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM t),
crc AS (SELECT conv_id, base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)),
      lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) % 4 AS h FROM ids),
r AS (SELECT t.* FROM t JOIN crc USING (conv_id) WHERE p > h
  UNION ALL SELECT crc.conv_id, t.p, t.role, t.text FROM crc JOIN t ON t.conv_id = crc.base WHERE t.p <= h),
k AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(role || chr(1) || text), '') OVER w AS key,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own FROM k GROUP BY 1, 2
  UNION ALL SELECT '', 0, min(conv_id), count(*), 0 FROM ids HAVING count(*) > 0),
c AS (SELECT left(key, length(key) - 32) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (key)),
s AS (SELECT left(key, 32 * d) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM a) GROUP BY 1),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (
  SELECT ids.conv_id, coalesce(arg_max(k.key, k.depth), '') AS key FROM ids LEFT JOIN k USING (conv_id) GROUP BY 1) GROUP BY 1)
SELECT a.conv_id, a.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM a JOIN s USING (key) LEFT JOIN n up ON a.depth > 0 AND up.key = left(a.key, length(a.key) - 32) LEFT JOIN e USING (key)
"""
