"""The registered queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, license_scan, line_crf, line_dedup, metric_join, ngram_join, packing, piece_codec, prefix_trie, quality_rules, secret_scan, segment_search, style_tree
from .common import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the module lies beside the interpreter of driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, vocabulary("byte_bpe_50k.json"), length=2048, end_id=1, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encode_documents(docs, vocabulary("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality_rules.apply_policy(quality_rules.apply_policy(entries, "v2"), "base", "base_passed")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_passed")).alias("base_failed"), "kept", "failed_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from the ledger's bits alone."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~line_crf.held_out())
    scored = line_crf.score(docs, line_crf.train(docs, labels, most=3000))
    return scored.select("doc_id", line_crf.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), threshold=0.93)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.col("places")
    base = F.transform(F.filter(places, lambda x: ~x["template"]), lambda x: x["first"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"), license_scan.labels_of(places, False).alias("base_labels"), license_scan.labels_of(places, True).alias("labels"), license_scan.confidence(places, F.col("n_words")).alias("score"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=75)


def op8_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    own = F.filter("secrets", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *[count(k) for k in base], F.sha2(secret_scan.span_list(own).cast("binary"), 256).alias("base_sha256"), secret_scan.span_list(F.col("secrets")).alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), label, F.col("vec_id") % 100 == 0, positives=5, negatives=5, percent=80, scale=256.0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_search.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), family=20, most=4)


QUERIES = {
    "op1_packing": op1_packing,
    "op5_piece_codec": op5_piece_codec,
    "op2_quality_rules": op2_quality_rules,
    "quality_ablations": quality_ablations,
    "op3_line_crf": op3_line_crf,
    "op4_metric_join": op4_metric_join,
    "op6_license_scan": op6_license_scan,
    "op7_ngram_join": op7_ngram_join,
    "op8_style_tree": op8_style_tree,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_segment_search": op12_segment_search,
    "op13_prefix_trie": op13_prefix_trie,
}

#: The characters that separate words, as SQL.
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_marks,
             length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
p AS (SELECT doc_id, unnest(words) AS w0, unnest(range(len(words))) AS i FROM w),
g AS (SELECT doc_id, i, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w0, w1, w2) >= 2 AS twice FROM g),
f AS (SELECT doc_id, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, count(*) FILTER (WHERE covered) AS n FROM f GROUP BY doc_id),
a AS (SELECT m.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
   + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
   + CASE WHEN 10 * n_marks > 2 * n_words THEN 16 ELSE 0 END + CASE WHEN n_words > 0 AND 100 * n_upper > 40 * word_chars THEN 32 ELSE 0 END
   + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits % 4 <> 0 AS base_failed, failed_bits & 119 = 0 AS kept, failed_bits FROM b
""",
    "op9_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, line, pos, s.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
}



def _ablation_sql() -> str:
    """Bits of each document by the SQL of op2, counted for each policy and rule."""
    parts = []
    for policy, names in quality_rules.POLICIES.items():
        for rule in names:
            m, b = quality_rules.mask(names), quality_rules.mask([rule])
            parts.append(f"SELECT '{policy}' AS policy, '{rule}' AS rule, count(*) FILTER (WHERE failed_bits & {m} & {b} <> 0) AS n_failed, count(*) FILTER (WHERE failed_bits & {m} = {b}) AS n_alone, count(*) FILTER (WHERE failed_bits & {m} = 0) AS n_kept FROM o")
    return f"WITH o AS ({ORACLE_SQL['op2_quality_rules']}) {' UNION ALL '.join(parts)}"


ORACLE_SQL["quality_ablations"] = _ablation_sql()

_UP_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL["op7_ngram_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_UP_LOW}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS n, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * o >= 75 * (n - o)),
two AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT two.b, r.c FROM r JOIN two ON r.doc_id = two.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s
"""

ORACLE_SQL["op4_metric_join"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m
"""


def _secret_sql() -> str:
    """Spans of each rule from its matches and the text between them, as the operator finds them."""
    parts = []
    for k, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        least = f"length(regexp_extract(m, '{pattern}', {r.group})) >= {r.least}"
        parts.append(f"""SELECT doc_id, {k} AS kind_at, '{r.kind}' AS kind, g_sum + m_sum - length(m) AS first, g_sum + m_sum AS last FROM (
  SELECT doc_id, m, sum(length(g)) OVER o AS g_sum, sum(length(m)) OVER o AS m_sum FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, string_split_regex(t, '{pattern}') AS gs FROM d))
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE {least}""")
    base = [r.kind for r in secret_scan.BASE_RULES]
    count = ", ".join(f"(count(*) FILTER (WHERE kind = '{b}'))::BIGINT AS n_{b}" for b in base)
    joined = "string_agg(kind || ':' || first::BIGINT || ':' || last::BIGINT, ',' ORDER BY first, kind_at)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {count}, sha256(coalesce({joined} FILTER (WHERE kind_at < {len(base)}), '')) AS base_sha256, coalesce({joined} FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


ORACLE_SQL["op10_secret_scan"] = _secret_sql()

#: The rows that take part, as vectors of whole numbers.
_GRID = """SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0"""
_SCORE = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT"

ORACLE_SQL["op11_hard_negatives"] = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM ({_GRID}) WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, {_SCORE} AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""

ORACLE_SQL["op12_segment_search"] = f"""
WITH v AS ({_GRID})
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SCORE} DESC, b.vec_id) AS rank, b.vec_id AS vec_id, {_SCORE} AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5
"""

_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda d: ascii(d)::BIGINT)), lambda c, b:
  list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

ORACLE_SQL["op13_prefix_trie"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(key ORDER BY turn NULLS FIRST, key) AS ks, list(len(regexp_extract_all(text, '[^ 	-]+')) ORDER BY turn NULLS FIRST, key) AS ws, any_value({_CRC32.format(s="conv_id::VARCHAR")}) % 4 AS h FROM t GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.ks, [])[1:o.h], o.ks[o.h + 1:]) AS ks, list_concat(coalesce(b.ws, [])[1:o.h], o.ws[o.h + 1:]) AS ws FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
m AS (SELECT conv_id, d, array_to_string(ks[1:d], ',') AS node, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], ',') END AS parent, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(ks) AS last FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM r)),
n AS (SELECT node, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM m GROUP BY node, d),
k AS (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (SELECT a AS d, CASE WHEN a = 0 THEN '' ELSE left(node, 33 * a - 1) END AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM v) GROUP BY 1, 2)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN u ON v.node = u.node AND v.d = u.d LEFT JOIN v p ON v.parent = p.node AND p.d = v.d - 1
"""
