"""Whitening of embeddings: TSQR of centred blocks, one-sided Jacobi rotations of R, and projections on the components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import tidied

#: Rows that are compressed to one R at a time.
BLOCK = 4096
#: R's of tasks are combined in so many groups before they are combined in one.
FAN = 64
#: Entries beyond this take no part, as sums and products of a long could not hold them; rows with any count as not finite.
LARGEST = 2.0**31
#: Components whose standard deviation is below so many times the largest hold rounding alone.
RANK = 1e-10


def jacobi_svd(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of r, largest first, by one-sided Jacobi rotations.

    Each rotation turns two columns of r, and of what becomes the vectors, so that they are orthogonal; a sweep meets each
    pair once, in rounds of disjoint pairs that turn together. Columns that are orthogonal to rounding end it; their
    lengths are the singular values, small ones as accurate as large ones.
    """
    n = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    g, v = np.array(r[:, order], np.float64), np.eye(n)[:, order]
    seats = np.arange(n + n % 2)  # an odd number leaves one column out of each round
    tiny, largest = np.finfo(np.float64).eps, float(np.linalg.norm(g, axis=0).max(initial=0))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            real = (p < n) & (q < n)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            size = np.sqrt(a * b)
            turn = np.abs(c) > np.maximum(tiny * size, (tiny * largest) ** 2)
            worst = max(worst, float((np.abs(c[turn]) / size[turn]).max(initial=0)))
            with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn & np.isfinite(t), t, 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            for m in (g, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = cos * x - sin * y, sin * x + cos * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 4 * tiny * max(1, n) ** 0.5:
            break
    sizes = np.linalg.norm(g, axis=0)
    order = np.argsort(-sizes, kind="stable")
    v = v[:, order]
    return sizes[order], v / np.linalg.norm(v, axis=0)


def compressed(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """The R of a QR decomposition of r (what came before) with the rows of block below it."""
    return np.linalg.qr(block if r is None else np.concatenate([r, block]), mode="r")


def whole(values: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale).astype(np.int64) + shift


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), width)


def _batches(rows: DataFrame, f, schema: str) -> DataFrame:
    """f(batches of (ids, matrix of entries)) of each task; rows has id, v, all v of one width."""
    return rows.mapInArrow(tidied(f), schema)


def squared_deviation(d: np.ndarray) -> list[int | None]:
    """The exact sums of squares of the rows of d; null where a long can't hold one."""
    if float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    exact = (d.astype(object) ** 2).sum(axis=1)
    return [int(x) if x < 2**63 else None for x in exact]


def whiten(vectors: DataFrame, components: int = 8, *, scale: int = 1024, shift: int = 100_000, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row for each usable vector: id, n, deviation, whitened (an array), and the fit's explained (an array) and identity_error.

    Entries c become whole numbers x = floor(scale * c) + shift. Vectors that are null or empty, or hold an entry that is
    null, not finite or so large that x is beyond LARGEST, take no part; nor do those of another width than the most
    common one (of equally common ones the smallest). All others are the fit list: n vectors with sums S.

    deviation is the sum of (n*x - S)^2 over the dimensions, exact, null where a long can't hold it. Components are unit
    eigenvectors of x's covariance (divisor n), by falling eigenvalue e; whitened is x - S/n projected on each, over sqrt(e),
    explained is e over the sum of all eigenvalues. There are fewer components where the vectors span fewer dimensions: a
    component without variance can't be scaled to one. identity_error is the largest absolute entry of whitened's
    covariance minus the identity, over all vectors. Repeated rows count as often as they occur; a null id stays null;
    other columns are not read; no usable vector gives an empty result.

    Three passes over the vectors, none of which shuffles them: sums; a triangular R a task, combined in two steps; the
    projections. What reaches the driver is the sums and one R, so width squared numbers, whatever the number of rows.
    """
    spark = vectors.sparkSession
    x = lambda c: c.cast("double") * float(scale)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(x(c)) < LARGEST - abs(shift))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).where(F.size("v") > 0).where(F.forall("v", fine))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    counted = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if counted is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    width, n = counted.width, counted.n
    rows = rows.where(F.size("v") == width)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            total += whole(_matrix(b.column(1), width), scale, shift).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["k", "s"])

    sums = np.zeros(width, np.int64)
    for r in _batches(rows, summed, "k int, s long").groupBy("k").agg(F.sum("s").alias("s")).collect():  # as many rows as dimensions
        sums[r.k] = r.s

    def deviations(column: pa.Array) -> np.ndarray:
        """n*x - S, exact."""
        return n * whole(_matrix(column, width), scale, shift) - sums

    def as_row(r: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([] if r is None else [r.tobytes()], pa.binary())], ["r"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for low in range(0, b.num_rows, BLOCK):
                r = compressed(r, deviations(b.column(1).slice(low, BLOCK)) / n)
        yield as_row(r)

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for cell in b.column(0).to_pylist():
                r = compressed(r, np.frombuffer(cell, np.float64).reshape(-1, width))
        yield as_row(r)

    triangles = _batches(rows, blocks, "r binary")
    triangles = triangles.select("r", (F.spark_partition_id() % FAN).alias("group")).repartition("group").select("r").mapInArrow(combined, "r binary")  # R's come one by one
    last = triangles.repartition(1).mapInArrow(combined, "r binary").first()
    deviation, directions = jacobi_svd(np.frombuffer(last.r, np.float64).reshape(-1, width))
    e = deviation**2 / n
    used = min(components, int((deviation > RANK * deviation[0]).sum()))
    axes = directions[:, :used] / np.sqrt(e[:used])
    explained = (e[:used] / e.sum()).tolist() if used else []

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, BLOCK):
                d = deviations(b.column(1).slice(low, BLOCK))
                w = (d / n) @ axes
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * used), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, BLOCK), pa.array(squared_deviation(d), pa.int64()), lists], ["id", "deviation", "whitened"])

    out = _batches(rows, projected, f"id {kind}, deviation long, whitened array<double>")
    pairs = [(i, j) for i in range(used) for j in range(i, used)]
    error = 0.0
    if pairs:
        w = lambda i: F.col("whitened")[i]
        found = out.agg(*(F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    numbers: Column = F.array(*map(F.lit, explained)).cast("array<double>")
    out = out.select("id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", numbers.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
    return out.withColumnRenamed("id", id_column)
