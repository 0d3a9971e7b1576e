"""Vectorised helpers over batches of texts, shared by the operators that run in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a single longer text is a step of its own.
STEP_BYTES = 1_000_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values as doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column in UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` bytes each."""
    low = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield low, i
            low, held = i, 0
        held += len(t) + 1
    if low < len(texts):
        yield low, len(texts)


def text_steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """steps() over a column of texts, each with its texts; only those of one step are taken out of the column at a time."""
    low = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if held and held + n > most:
            yield low, i, as_bytes(column.slice(low, i - low))
            low, held = i, 0
        held += n + 1
    if low < len(column):
        yield low, len(column), as_bytes(column.slice(low))


def release() -> None:
    """Gives unused memory back to the system."""
    import contextlib
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A generator of a task that gives memory back when it ends: Python workers stay alive, idle, beside those of later stages."""

    def tidy(*args):
        try:
            yield from run(*args)
        finally:
            release()

    return tidy


def tidied_group(f):
    """The same for a function of one or two tables of a group, after large ones."""

    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        if table.nbytes > 1_000_000:
            release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        if left.nbytes + right.nbytes > 1_000_000:
            release()
        return out

    return one if f.__code__.co_argcount == 1 else two


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: where each starts and ends in `buf`, and where each text's words start."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join([*texts, b""])
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        blank = (self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))
        before = np.ones_like(blank)
        before[1:] = blank[:-1]
        self.blank = blank
        self.starts = np.flatnonzero(before & ~blank)
        self.ends = np.flatnonzero(blank & ~before)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.cumsum(lengths) - lengths
        self.first = np.searchsorted(self.starts, np.append(self.text_starts, len(self.buf)))
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a sum of the bytes, each times an odd number of its place that follows no rule."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        solid = self.buf[~self.blank]
        lengths = self.ends - self.starts
        at = np.cumsum(lengths) - lengths
        place = np.arange(len(solid), dtype=np.int64) - np.repeat(at, lengths)
        factors = mix(np.arange(int(lengths.max()), dtype=np.uint64)) | np.uint64(1)
        h = np.add.reduceat((solid.astype(np.uint64) + np.uint64(1)) * factors[place], at)
        return mix(h ^ (lengths.astype(np.uint64) * _M2))

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def places(self) -> np.ndarray:
        """The place of each word in its text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)


def windows(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of `size` consecutive values of h, for each start for which they exist."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, np.uint64(salt))
    factor = np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        out = (out ^ h[k : k + n]) * factor
        out ^= out >> np.uint64(32)
    return mix(out)


def xxhash64_long(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for long values (the published XXH64 for eight bytes, seed 42; its primes are fixed values)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = turn((turn(x.view(np.uint64) * p2, 31) * p1) ^ (np.uint64(42) + p5 + np.uint64(8)), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def partitions(df: DataFrame, each: int = 64_000_000) -> int:
    """Partitions for a shuffle of df: the session's number, or more where the optimizer's estimate of df asks for more."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, min(size // each, 1_000_000) if size < 2**60 else n)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, one of its warehouse, which a cluster must share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (warehouse.startswith(("file:", "/"))):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{warehouse}/_shared"


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read from there from now on; the table goes when the driver ends, if not before.

    checkpoint() keeps the constraints and statistics of all plans before it, which pile up over rounds of an iteration.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote and nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(t._cut_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def one_a_id(rows: DataFrame, *others: str) -> DataFrame:
    """(id, hash, text, others) of one row of each id: that whose text has the least hash; copies are dropped before the shuffle."""
    rows = rows.withColumn("hash", F.xxhash64("text"))
    return rows.groupBy("id").agg(F.min("hash").alias("hash"), F.min_by("text", F.struct("hash", F.length("text"))).alias("text"), *(F.first(c).alias(c) for c in others))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of an id's decimal text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
