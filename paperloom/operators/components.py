"""Connected components by label propagation over an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, one of its warehouse, which a cluster must share."""
    named, warehouse = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not named and not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or f"{warehouse}/_shared"


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder, not in use; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there; the files go when the driver ends, or by discard()."""
    spark = df.sparkSession
    path = scratch(spark, "stored")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what stored() wrote and nothing will read again."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def parts(df: DataFrame, each: int) -> int:
    """Parts to deal df out to: the session's number, or more where the optimizer's estimate of its bytes asks for more."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, min(size // each, 1_000_000) if size < 2**60 else n)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b); a component is named by its smallest node.

    Each round a node takes the smallest label among its neighbours' and then that label's own label, so that labels travel
    twice as far each time; it ends when none changes, and fails if that takes more than `rounds`. The first round needs no
    join, as nodes are their own labels; labels of a round are removed once those of the next one are written.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = stored(edges.where("a <> b").select(ends.alias("e")).select("e.a", "e.b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.col("node").alias("old"), F.least("node", "m").alias("component")))
    for _ in range(rounds):
        if labels.where("old <> component").isEmpty():
            discard(both)
            return labels.select("node", "component")
        now = labels.select("node", "component")
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = now.withColumnRenamed("component", "old").join(near, "node").select("node", "old", F.least("old", "m").alias("label"))
        above = now.select(F.col("node").alias("label"), F.col("component").alias("top"))
        new = stored(step.join(above, "label").select("node", "old", F.least("label", "top").alias("component")))
        discard(labels)
        labels = new
    raise RuntimeError(f"labels still change after {rounds} rounds")
