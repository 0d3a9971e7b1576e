"""A persisted index of papers and their groups: new records touch the buckets of their keys and groups alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import identity
from paperloom.operators.components import connected_components, discard, stored
from paperloom.operators.near import few_missing, SIMILAR
from paperloom.plans.schema import PAPER
from paperloom.sources.commits import Commits

#: Buckets of a new index; records and keys are dealt to them by hash.
BUCKETS = 64
RECORD = T.StructType([*PAPER.fields, T.StructField("gid", T.LongType())])
#: A key's first holder, or (with name) a title of a block of near ones.
KEY = "key string, seq long, year int, name string, gid long"


def _block(name: Column) -> Column:
    """Where near-identical titles meet: their start and their numbers; null for titles too short to be compared."""
    numbers = F.array_join(identity.numbering(name), " ")
    return F.when(F.length(name) >= identity.FUZZY, F.concat(F.lit("near:"), F.substring(name, 1, identity.PREFIX), F.lit("|"), numbers))


def _key_rows(rows: DataFrame) -> DataFrame:
    """(key, seq, year) of keyed() rows: identifiers and titles that are long enough."""
    title = F.when(F.length("name") >= identity.TITLE_KEY, F.concat(F.lit("title:"), "name"))
    return rows.select(F.explode(F.array_compact(F.concat("keys", F.array(title)))).alias("key"), "seq", "year")


def _entries(rows: DataFrame) -> DataFrame:
    """The index's rows of keyed() rows with gid: each key's first holder, and each block's distinct titles, years and groups."""
    first = _key_rows(rows).join(rows.select("seq", "gid"), "seq").groupBy("key").agg(F.min(F.struct("seq", "year", "gid")).alias("f")).select("key", "f.seq", "f.year", F.lit(None).cast("string").alias("name"), "f.gid")
    near = rows.withColumn("key", _block(F.col("name"))).where("key is not null").groupBy("key", "name", "year", "gid").agg(F.min("seq").alias("seq"))
    return first.unionByName(near.select("key", "seq", "year", "name", "gid"))


class EntityIndex:
    """Records with their group (gid: the seq of its first record), and the keys by which later records find it.

    Two tables, each in buckets that are written whole: records by group, keys by key. A version names where each bucket's
    files are. upsert() reads the key buckets of the new records, the record buckets of the groups that these join, and the
    key buckets of groups that become one; it writes the same buckets anew and commits. All others stay as they are.
    What is found is what dedup() of all records would give, as new records come after those that are there.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.commits = spark, Commits(spark, folder)
        self.version, self.document = self.commits.latest()

    @property
    def buckets(self) -> int:
        return self.document["buckets"]

    def _bucket(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _paths(self, table: str, which=None) -> list[str]:
        held = self.document[table]
        return [f"{self.commits.folder}/{table}/{held[b]}/bucket={b}" for b in (sorted(held) if which is None else (str(b) for b in which)) if b in held]

    def _read(self, table: str, which=None) -> DataFrame:
        paths, kind = self._paths(table, which), RECORD if table == "records" else KEY
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def _write(self, table: str, df: DataFrame, by: str, version: str) -> set[str]:
        """Writes df's buckets as files of their own; returns which there are."""
        where = f"{self.commits.folder}/{table}/{version}"
        dealt = df.withColumn("bucket", self._bucket(F.col(by)))
        dealt.repartition("bucket").sortWithinPartitions("bucket", by).write.partitionBy("bucket").parquet(where)
        made = self.spark.read.parquet(where).select("bucket").distinct().collect() if self._any(where) else []
        return {str(r.bucket) for r in made}

    def _any(self, where: str) -> bool:
        return any(s.isDirectory() for s in self.commits.fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(where)))

    def _commit(self, changes: dict[str, tuple[set[str], set[str]]], name: str, end: int) -> None:
        """changes: for each table the buckets that were read to be replaced and those that were written."""
        document = {**(self.document or {}), "end": end}
        for table, (replaced, written) in changes.items():
            held = {b: at for b, at in document.get(table, {}).items() if b not in replaced}
            document[table] = held | dict.fromkeys(written, name)
        self.commits.commit(self.version + 1, document)
        self.version, self.document = self.version + 1, document

    def _version_name(self) -> str:
        return f"v{self.version + 1:08d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()[:8]}"

    def build(self, papers: DataFrame, buckets: int = BUCKETS) -> EntityIndex:
        """Indexes papers in place of whatever the folder holds."""
        self.document = {"buckets": buckets}
        grouped = stored(identity.groups(papers).select(*PAPER.names, "gid"))
        end = grouped.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        name = self._version_name()
        rows = identity.keyed(grouped)
        changes = {"records": (set(), self._write("records", grouped, "gid", name)), "keys": (set(), self._write("keys", _entries(rows.join(grouped.select("seq", "gid"), "seq")), "key", name))}
        self._commit(changes, name, end)
        discard(grouped, rows)
        return self

    def records(self) -> DataFrame:
        """All records with gid."""
        return self._read("records")

    def merged(self) -> DataFrame:
        """One record for each group, as dedup() gives."""
        return identity.merge_groups(self.records())

    def _touched(self, df: DataFrame, column: str) -> list[int]:
        return sorted(r[0] for r in df.select(self._bucket(F.col(column))).distinct().collect())  # at most as many as there are buckets

    def _edges(self, rows: DataFrame) -> DataFrame:
        """Edges (a, b) of new keyed() rows to each other and to the groups that are there."""
        keys = stored(_key_rows(rows))
        known = self._read("keys", self._touched(keys, "key")).where("name is null").select("key", F.struct(F.col("gid").alias("a"), "year").alias("old"))
        own = keys.groupBy("key").agg(F.min(F.struct(F.col("seq").alias("a"), "year")).alias("new"))
        first = stored(own.join(known, "key", "left").select("key", F.coalesce("old", "new").alias("f")).select("key", "f.a", F.col("f.year").alias("first_year")))
        fits = ~F.startswith("key", F.lit("title:")) | F.coalesce(F.abs(F.col("year") - F.col("first_year")) <= 1, F.lit(True))
        by_key = keys.join(first, "key").where((F.col("seq") != F.col("a")) & fits).select("a", F.col("seq").alias("b"))
        titles = stored(rows.withColumn("key", _block(F.col("name"))).where("key is not null").groupBy("key", "name", "year").agg(F.min("seq").alias("low"), F.max("seq").alias("high")))
        there = self._read("keys", self._touched(titles, "key")).where("name is not null").select("key", F.col("name").alias("old"), F.col("year").alias("old_year"), "gid", F.col("seq").alias("old_seq"))
        groups = there.groupBy("key", "old", "old_year").agg(F.min_by("gid", "old_seq").alias("low_gid"))
        met = groups.join(titles, "key").where((F.col("old") != F.col("name")) & identity.near_lengths(F.col("old"), F.col("name")) & few_missing(F.col("old"), F.col("name")))
        met = met.where(F.coalesce(F.abs(F.col("old_year") - F.col("year")) <= 1, F.lit(True))).where(identity.sequence_ratio(F.col("old"), F.col("name")) >= SIMILAR)
        met = stored(met.select("key", "old", "old_year", "low_gid", "name", "year", "high"))
        same = lambda one, other: F.col(one).eqNullSafe(F.col(other))
        after = rows.select("seq", F.col("name").alias("own"), F.col("year").alias("own_year")).join(met, same("own", "name") & same("own_year", "year")).select(F.col("low_gid").alias("a"), F.col("seq").alias("b"))
        theirs = there.select(F.col("key").alias("k"), F.col("old").alias("o"), F.col("old_year").alias("oy"), "gid")
        before = theirs.join(met, same("k", "key") & same("o", "old") & same("oy", "old_year")).select(F.col("gid").alias("a"), F.col("high").alias("b"))
        return stored(reduce(DataFrame.union, (by_key, after, before, identity.fuzzy_edges(rows))).distinct())

    def upsert(self, new: DataFrame) -> tuple[DataFrame, int]:
        """Adds records after those that are there: (merged records of all groups that changed, how many of these are new).

        Equal to merge_into() of all records, which it doesn't read. A writer that started from the same version and
        committed first makes this fail with Conflict; nothing is changed then.
        """
        if self.document is None:
            self.build(new.limit(0))
        start = self.document["end"]
        low = new.agg(F.coalesce(F.min("seq"), F.lit(0))).first()[0]
        added = stored(new.select(*PAPER.names).withColumn("seq", F.col("seq") - low + start))
        rows = identity.keyed(added)
        edges = self._edges(rows)
        found = connected_components(edges)
        own = added.join(found.withColumnRenamed("node", "seq"), "seq", "left").withColumn("gid", F.coalesce("component", "seq")).drop("component")
        moved = stored(found.where(F.col("node") < start).select(F.col("node").alias("gid"), F.col("component").alias("top")))
        # The groups that new records join, and the buckets that they and the new groups lie in.
        joined = self._touched(moved, "gid")
        theirs = self._read("records", joined)
        changed = stored(theirs.join(moved, "gid").drop("gid").withColumnRenamed("top", "gid").select(*PAPER.names, "gid").unionByName(own.select(*PAPER.names, "gid")))
        touched = sorted({*joined, *self._touched(changed, "gid")})
        kept = self._read("records", touched).join(moved.select("gid"), "gid", "left_anti")
        name = self._version_name()
        changes = {"records": ({str(b) for b in touched}, self._write("records", kept.select(*PAPER.names, "gid").unionByName(changed), "gid", name))}
        # Keys of the new records, and those of groups that got another name.
        renamed = stored(moved.where("gid <> top"))
        again = identity.keyed(theirs.join(renamed.select("gid"), "gid", "left_semi").select(*PAPER.names))
        fresh = stored(_entries(rows.join(own.select("seq", "gid"), "seq")))
        buckets = sorted({*self._touched(fresh, "key"), *self._touched(_key_rows(again), "key"), *self._touched(again.select(_block(F.col("name")).alias("key")).where("key is not null"), "key")})
        old = self._read("keys", buckets).join(renamed, "gid", "left").withColumn("gid", F.coalesce("top", "gid")).drop("top")
        both = old.select("key", "seq", "year", "name", "gid").unionByName(fresh.select("key", "seq", "year", "name", "gid"))
        holders = both.where("name is null").groupBy("key").agg(F.min(F.struct("seq", "year", "gid")).alias("f")).select("key", "f.seq", "f.year", F.lit(None).cast("string").alias("name"), "f.gid")
        titles = both.where("name is not null").groupBy("key", "name", "year", "gid").agg(F.min("seq").alias("seq")).select("key", "seq", "year", "name", "gid")
        changes["keys"] = ({str(b) for b in buckets}, self._write("keys", holders.unionByName(titles), "key", name))
        end = added.agg(F.coalesce(F.max("seq"), F.lit(start - 1))).first()[0] + 1
        self._commit(changes, name, end)
        merged = stored(identity.merge_groups(changed))
        discard(added, rows, edges, moved, changed, renamed, again, fresh)
        return merged, merged.where(F.col("seq") >= start).count()

    def vacuum(self) -> None:
        """Removes files of versions before the last one."""
        for table in ("records", "keys"):
            used = set(self.document[table].values())
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.commits.folder}/{table}")
            for status in self.commits.fs.listStatus(where) if self.commits.fs.exists(where) else []:
                if status.getPath().getName() not in used:
                    self.commits.remove(table, status.getPath().getName())
