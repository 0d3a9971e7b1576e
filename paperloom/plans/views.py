"""Papers, judgements and citation edges derived from general tables, the same in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.plans.schema import conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of papers beside title and abstract: (Spark expression, DuckDB expression) over documents.
_DERIVED = {
    "year": ("cast(2000 + doc_id % 26 as int)", "CAST(2000 + doc_id % 26 AS INTEGER)"),
    "venue": ("case when doc_id % 5 = 0 then 'arXiv' when doc_id % 5 = 1 then null else source end", "CASE WHEN doc_id % 5 = 0 THEN 'arXiv' WHEN doc_id % 5 = 1 THEN NULL ELSE source END"),
    "citation_count": ("case when doc_id % 17 <> 0 then n_chars % 200 end", "CASE WHEN doc_id % 17 <> 0 THEN n_chars % 200 END"),
    "language": ("case when doc_id % 23 <> 0 then lang end", "CASE WHEN doc_id % 23 <> 0 THEN lang END"),
    "type": ("case when doc_id % 20 = 0 then 'Editorial' when doc_id % 20 = 1 then 'Newsletter' when doc_id % 20 = 2 then null else 'article' end", "CASE WHEN doc_id % 20 = 0 THEN 'Editorial' WHEN doc_id % 20 = 1 THEN 'Newsletter' WHEN doc_id % 20 = 2 THEN NULL ELSE 'article' END"),
    "doi": ("case when doc_id % 3 = 0 then concat('10.5555/d', cast(doc_id div 6 as string)) end", "CASE WHEN doc_id % 3 = 0 THEN '10.5555/d' || (doc_id // 6) END"),
    "arxiv_id": ("case when doc_id % 4 = 1 then concat('2401.', lpad(cast(doc_id % 100000 as string), 5, '0')) end", "CASE WHEN doc_id % 4 = 1 THEN '2401.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') END"),
    "s2_id": ("case when doc_id % 7 = 2 then concat('s', cast(doc_id as string)) end", "CASE WHEN doc_id % 7 = 2 THEN 's' || doc_id END"),
    "round": ("cast(case when doc_id % 6 >= 4 then 1 else 0 end as int)", "CAST(CASE WHEN doc_id % 6 >= 4 THEN 1 ELSE 0 END AS INTEGER)"),
}
_FOUND_SPARK = (
    "case when doc_id % 50 = 7 then array('seed:known') when doc_id % 6 = 0 then array('seed:q1', 'search:openalex:q2') when doc_id % 6 = 1 then array('search:arxiv:q1', 'search:openalex:q1') "
    "when doc_id % 6 = 2 then array('search:semantic_scholar:q1') when doc_id % 6 = 3 then array('manual') "
    "else array(concat('backward:doi:10.5555/d', cast(doc_id % 40 as string)), concat('forward:doi:10.5555/d', cast(doc_id % 3 as string)), concat('backward:doi:10.5555/d', cast(doc_id % 3 as string))) end"
)
_FOUND_SQL = (
    "CASE WHEN doc_id % 50 = 7 THEN ['seed:known'] WHEN doc_id % 6 = 0 THEN ['seed:q1', 'search:openalex:q2'] WHEN doc_id % 6 = 1 THEN ['search:arxiv:q1', 'search:openalex:q1'] "
    "WHEN doc_id % 6 = 2 THEN ['search:semantic_scholar:q1'] WHEN doc_id % 6 = 3 THEN ['manual'] "
    "ELSE ['backward:doi:10.5555/d' || (doc_id % 40), 'forward:doi:10.5555/d' || (doc_id % 3), 'backward:doi:10.5555/d' || (doc_id % 3)] END"
)
SQUEEZE = r"trim(regexp_replace({}, '[\s\x0b\p{{Z}}\x1c-\x1f]+', ' ', 'g'))"


def _start(body: Column, n: int) -> Column:
    """The first n characters of a squeezed text; the rest of it is squeezed only where its start doesn't give them."""
    start = text.squeeze(F.substring(body, 1, 8 * n))
    return F.substring(F.when(F.length(start) > n, start).otherwise(text.squeeze(body)), 1, n)


def documents_as_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper for each document: its start is the title, its text the abstract; labels judge it."""
    d = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    rows = d.select("doc_id", _start(body, 80).alias("title"), body.alias("abstract"), *(F.expr(e).alias(n) for n, (e, _) in _DERIVED.items()), F.expr(_FOUND_SPARK).alias("found_via"))
    labels = table(spark, sf_dir, "labels")
    status = F.when(F.col("quality") == 0, "exclude").when(F.col("toxic") == 1, "skim").when(F.col("quality") == 1, "core")
    levels = F.when(F.col("_label").isNotNull() & (F.col("doc_id") % 9 != 0), F.concat(F.lit("area "), (F.col("doc_id") % 4).cast("string")))
    judged = rows.join(labels.select("doc_id", status.alias("status"), F.lit(True).alias("_label")), "doc_id", "left").withColumns({"first_level": levels, "second_level": F.when(levels.isNotNull() & (F.col("doc_id") % 2 == 0), F.concat(F.lit("topic "), (F.col("doc_id") % 6).cast("string")))})
    return conform(judged.drop("_label"), seq="doc_id")


PAPERS_SQL = f"""papers AS (SELECT d.doc_id AS seq, substr({SQUEEZE.format("coalesce(text, '')")}, 1, 80) AS title, coalesce(text, '') AS abstract,
  {", ".join(f"{s.replace('doc_id', 'd.doc_id')} AS {n}" for n, (_, s) in _DERIVED.items())}, {_FOUND_SQL.replace("doc_id", "d.doc_id")} AS found_via,
  CASE WHEN quality = 0 THEN 'exclude' WHEN toxic = 1 THEN 'skim' WHEN quality = 1 THEN 'core' END AS status,
  CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 9 <> 0 THEN 'area ' || (d.doc_id % 4) END AS first_level,
  CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 9 <> 0 AND d.doc_id % 2 = 0 THEN 'topic ' || (d.doc_id % 6) END AS second_level
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to the parts they hold: (parent_id, child_id, pos).

    Dealt out by order alone, as few of its lines are of one part: a step from the orders finds its edges where they are.
    """
    rows = table(spark, sf_dir, "lineitem")
    edge = [F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("child_id")]
    return rows.select(*edge, "l_linenumber").repartition("parent_id").groupBy("parent_id", "child_id").agg(F.min("l_linenumber").alias("pos"))


EDGES_SQL = "edges AS (SELECT 'o' || l_orderkey AS parent_id, 'p' || l_partkey AS child_id, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)"


def order_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and orders as records: (id, title, citation_count)."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("citation_count"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 11 != 0, F.floor("o_totalprice") % 1000).alias("citation_count"))
    return parts.union(orders)


CORPUS_SQL = "corpus AS (SELECT 'p' || p_partkey AS id, p_name AS title, CAST(p_size AS BIGINT) AS citation_count FROM part UNION ALL SELECT 'o' || o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 1000 END FROM orders)"


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))


def part_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
