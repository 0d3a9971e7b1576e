"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them.

The contract columns of each query are derived here; the operators keep their own general interfaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, byte_bpe, near_dup, packing, pii, quality_model, quality_rules, ranked, substring_dedup, topk, toxicity, warc, whitening
from paperloom.llm.batches import fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """Where the public tokenizers' byte-level BPE lies; a parameter of the operators, not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    """Where the public rank file for many languages lies; a parameter as well."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(kind) for kind in pii.BASE), F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), counts=True)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = quality_model.quality(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    rows = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "value"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.col("explained")[F.col("at")].alias("explained"), "identity_error")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality_rules": op2_quality_rules,
    "op3_bpe_chunks": op3_bpe_chunks,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_top_k": op7_top_k,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_ranked_search": op12_ranked_search,
    "op13_byte_bpe": op13_byte_bpe,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_GRIDS = ", ".join(f"('{r.name}', [{', '.join(map(str, r.grid))}])" for r in quality_rules.RULES)
_VALUES = " ".join(f"WHEN '{r.name}' THEN {r.value.replace(' DIV ', ' // ')}" for r in quality_rules.RULES)
_LIMITS = " OR ".join(f"coalesce(({r.value.replace(' DIV ', ' // ')}) > max(cutoff) FILTER (rule = '{r.name}'), false)" for r in quality_rules.RULES)

SQL: dict[str, str] = {
    "op2_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, {_WORDS} AS ws, coalesce(text, '') AS t,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
rules(rule, grid) AS (VALUES {_GRIDS}),
h AS (SELECT stratum, rule, grid, quality = 1 AS good, CASE rule {_VALUES} END AS v FROM b JOIN labels USING (doc_id), rules WHERE NOT base_failed AND quality IS NOT NULL),
c AS (SELECT stratum, rule, c, grid[c] AS cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND v > grid[c]) AS k, count(*) FILTER (NOT good AND v > grid[c]) AS gain
  FROM (SELECT *, unnest(range(1, len(grid) + 1)) AS c FROM h) GROUP BY ALL),
p AS (SELECT *, n > 0 AND k < n * 0.02 / 4 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995))))
  <= 0.05 / 4 / (SELECT count(DISTINCT stratum) FROM h) AS fine FROM c),
q AS (SELECT *, bool_and(fine) OVER (PARTITION BY stratum, rule ORDER BY c DESC) AS certified FROM p),
best AS (SELECT stratum, rule, cutoff FROM q WHERE certified AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, c DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_LIMITS}) AS kept
FROM b LEFT JOIN best USING (stratum) GROUP BY doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed""",
    "op4_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
t AS (SELECT array_to_string(ws, ' ') AS words, any_value(ws) AS ws, min(doc_id) AS node FROM w GROUP BY 1),
g AS (SELECT node, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM t WHERE len(ws) > 0),
c AS (SELECT node, s, count(*) AS n FROM g GROUP BY ALL),
z AS (SELECT node, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS both_have FROM c a JOIN c b ON a.s = b.s AND a.node < b.node GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON a = x.node JOIN z y ON b = y.node WHERE 5 * both_have >= 4 * (x.total + y.total - both_have)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, other) AS (SELECT node, node FROM t UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
k AS (SELECT node, class_id, count(*) OVER (PARTITION BY class_id) AS class_texts FROM (SELECT node, min(other) AS class_id FROM r GROUP BY node))
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_docs, class_texts FROM w JOIN t ON array_to_string(w.ws, ' ') = t.words JOIN k USING (node)""",
    "op5_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(ws[i:i + 19], ' ')) ORDER BY doc_id, i) AS nth FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM k WHERE nth > 1),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS words, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_top_k": """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * d.x[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + (('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::INTEGER // [32768, 1024, 32, 1][1 + i % 4]) % 32 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM k""",
    "op12_ranked_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS length FROM d WHERE len(ts) > 0),
i AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM i JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}
