"""Exact top-k search by integer inner product: dual-tree search over cover trees of query and data blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import partitions, tidied

#: Vectors of a data block and of a query block: one cover tree each, and the unit that tasks work on.
DATA_BLOCK, QUERY_BLOCK = 4096, 1024
#: A node of so many points or fewer is a leaf.
LEAF = 4
#: Candidates that a group of queries is multiplied with at once, those of the highest bounds first.
CHUNK = 512
#: Scores beyond a long count as the last numbers of its range.
LARGEST = 2**63 - 2


class CoverTree:
    """A cover tree over the rows of x, built level by level.

    A node has a centre that is one of its points, a covering radius, and children whose centres are a net of the node's
    points: more than half the radius apart (separation), each point within half the radius of its child's centre
    (covering), the node's own centre among them (nesting). Nodes of LEAF points or of radius 0 are leaves.

    Nodes are numbered level by level, so that a node's children are consecutive; a node's points are consecutive in
    `order`. The columns of `nodes` are all that a tree is besides its vectors; they travel with a block.
    """

    COLUMNS = np.dtype([("low", "<i4"), ("high", "<i4"), ("centre", "<i4"), ("first", "<i4"), ("last", "<i4"), ("radius", "<f8"), ("norm", "<f8")])

    def __init__(self, x: np.ndarray, built: tuple[bytes, bytes] | None = None):
        self.x = x
        if built:
            self.order, self.nodes = np.frombuffer(built[0], np.int32), np.frombuffer(built[1], self.COLUMNS)
        else:
            with np.errstate(over="ignore", invalid="ignore"):  # distances beyond doubles make leaves whose bounds tell nothing
                self._build()
        self.centres = x[self.nodes["centre"]]

    def packed(self) -> tuple[bytes, bytes]:
        return self.order.tobytes(), self.nodes.tobytes()

    def _build(self) -> None:
        x, n = self.x, len(self.x)
        squares = (x * x).sum(axis=1)
        slack = float(np.sqrt((x.shape[1] + 4) * 2.0**-50 * squares.max(initial=0)))  # what rounding may take from a distance
        self.order, nodes = np.arange(n, dtype=np.int32), [(0, n, 0)]
        made = []
        for low, high, centre in nodes:  # grows while it is walked
            points = self.order[low:high]
            own, size = x[points], squares[points]
            away = lambda c, own=own, size=size: np.sqrt(np.maximum(size + squares[c] - 2 * (own @ x[c]), 0))
            best = away(centre) if high - low > 1 else np.zeros(1)
            radius = float(best.max())
            first = last = len(nodes)
            if high - low > LEAF and radius > slack:
                nearest, net = np.zeros(len(points), np.int32), [centre]
                while best.max() > radius / 2:
                    c = int(points[int(best.argmax())])
                    d = away(c)
                    closer = d < best
                    closer[points == c] = True
                    nearest[closer], best = len(net), np.where(closer, d, best)
                    best[points == c] = 0
                    net.append(c)
                self.order[low:high] = points[np.argsort(nearest, kind="stable")]
                edges = low + np.concatenate([[0], np.cumsum(np.bincount(nearest, minlength=len(net)))])
                nodes += list(zip(edges[:-1].tolist(), edges[1:].tolist(), net))
                last = len(nodes)
            made.append((low, high, centre, first, last, radius + slack if high - low > 1 else 0.0, float(np.sqrt(squares[centre])) + slack))
        self.nodes = np.array(made, self.COLUMNS)

    def points(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some nodes, and which of the nodes each belongs to."""
        low, count = self.nodes["low"][nodes], self.nodes["high"][nodes] - self.nodes["low"][nodes]
        of = np.repeat(np.arange(len(nodes)), count)
        return self.order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(of))], of

    def leaf(self, nodes: np.ndarray) -> np.ndarray:
        return self.nodes["first"][nodes] == self.nodes["last"][nodes]

    def children(self, nodes: np.ndarray) -> np.ndarray:
        first, count = self.nodes["first"][nodes], self.nodes["last"][nodes] - self.nodes["first"][nodes]
        return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Best:
    """The k highest scores of each of some queries so far, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.have = np.zeros(len(ids), np.int64)

    def worst(self, rows: np.ndarray) -> float:
        """The worst kth score of a group of queries; nothing is known while one has fewer than k."""
        return float(self.scores[rows, -1].min()) if (self.have[rows] >= self.k).all() else -np.inf

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates ids with a row of scores for each of the queries; a query's own id is none."""
        own = ids[None, :] == self.ids[rows][:, None]
        all_scores = np.concatenate([self.scores[rows], np.where(own, np.iinfo(np.int64).min, scores)], axis=1)
        all_ids = np.concatenate([self.found[rows], np.where(own, np.iinfo(np.int64).max, ids[None, :])], axis=1)
        order = np.lexsort((all_ids, -(all_scores + 1)), axis=1)[:, : self.k]
        self.scores[rows], self.found[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
        self.have[rows] = np.minimum(self.k, self.have[rows] + (~own).sum(axis=1))

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for i, n in enumerate(self.have.tolist()):
            for j in range(n):
                yield int(self.ids[i]), int(self.found[i, j]), int(self.scores[i, j])


def dual_tree(queries: CoverTree, data: CoverTree, ids: np.ndarray, products, best: Best) -> tuple[int, int]:
    """Adds to best what the data (rows with ids) have to offer to the queries; returns how many bounds and how many products it took.

    products(i, j) is the exact matrix of scores of query rows i and data rows j. A pair of nodes can't hold a score above
    <q, d> + |q| r_d + |d| r_q + r_q r_d for centres q, d and radii r; it is left out if that is below the worst kth
    score among the node's queries. Both trees are opened together, the wider side first; of what is left for a leaf of
    queries the highest bounds are multiplied first, so that kth scores rise early, and best carries them on to the next
    block of data.
    """
    taken = [0, 0]

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        of, d = queries.nodes[q], data.nodes
        taken[0] += len(nodes)
        radius, norm = d["radius"][nodes], d["norm"][nodes]
        with np.errstate(over="ignore", invalid="ignore"):
            b = data.centres[nodes] @ queries.centres[q] + of["norm"] * radius + norm * of["radius"] + of["radius"] * radius
            b = b + 1e-9 * (np.abs(b) + of["norm"] * norm) + 1  # rounding never prunes a tie
        return np.where(np.isfinite(b), b, np.inf)

    def visit(q: int, nodes: np.ndarray) -> None:
        rows = queries.order[queries.nodes["low"][q] : queries.nodes["high"][q]]
        open_ = bool(queries.nodes["first"][q] < queries.nodes["last"][q])
        most = bounds(q, nodes)
        while True:
            near = most >= best.worst(rows)
            nodes, most = nodes[near], most[near]
            # The wider side is opened; a leaf of queries opens all data nodes.
            wide = ~data.leaf(nodes) & (not open_ or data.nodes["radius"][nodes] > queries.nodes["radius"][q])
            if not wide.any():
                break
            new = data.children(nodes[wide])
            nodes, most = np.concatenate([nodes[~wide], new]), np.concatenate([most[~wide], bounds(q, new)])
        if not len(nodes):
            return
        nodes = nodes[np.argsort(-most, kind="stable")]
        if open_:
            for child in range(queries.nodes["first"][q], queries.nodes["last"][q]):
                visit(child, nodes)
            return
        found, of = data.points(nodes)
        most = np.sort(most)[::-1][of]
        for low in range(0, len(found), CHUNK):
            if most[low] < best.worst(rows):
                return
            some = found[low : low + CHUNK]
            taken[1] += len(rows) * len(some)
            best.add(rows, ids[some], products(rows, some))

    visit(0, np.zeros(1, np.int64))
    return taken[0], taken[1]


def exact_products(q: np.ndarray, d: np.ndarray):
    """A function of query and data rows that gives exact integer products of two matrices of whole numbers, LARGEST in size at most."""
    a, b = float(np.abs(q).max(initial=0)), float(np.abs(d).max(initial=0))
    most = a * b * max(1, q.shape[1])
    if most < 2**53:
        return lambda i, j: np.rint(q[i] @ d[j].T).astype(np.int64)
    if most < 2**62:
        p, r = q.astype(np.int64), d.astype(np.int64)
        return lambda i, j: p[i] @ r[j].T
    p, r = (np.frompyfunc(int, 1, 1)(x) for x in (q, d))
    return lambda i, j: np.clip((p[i] @ r[j].T).astype(object), -LARGEST, LARGEST).astype(np.int64)


def scaled(column: str, scale: int) -> Column:
    """floor(scale * x) of each component x, as double; what is too large to have a fraction stays as it is, and finite."""

    def one(x: Column) -> Column:
        y = x * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(1.7e308)), F.lit(-1.7e308)))

    return F.transform(F.col(column).cast("array<double>"), one)


def _packed_blocks(df: DataFrame, most: int) -> DataFrame:
    """(width, ids, x, points, nodes) of blocks of about `most` vectors of one width, each with its cover tree; df has id, width, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def send(width: int) -> pa.RecordBatch:
            rows = held.pop(width)
            ids, x = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), width)
            cells = [ids.tobytes(), x.tobytes(), *CoverTree(x).packed()]
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["width", "ids", "x", "points", "nodes"])

        for b in batches:
            for i, width, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                held.setdefault(width, []).append((i, v))
                if len(held[width]) >= most:
                    yield send(width)
        for width in list(held):
            yield send(width)

    return df.mapInArrow(tidied(run), "width int, ids binary, x binary, points binary, nodes binary")


def _searched(pairs: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """(query_id, id, score): the k best of each query among the data of a task; pairs are sorted by query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = best = tree = None

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None and (rows := list(best.rows())):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query_id", "id", "score"])

        def opened(ids: bytes, x: bytes, points: bytes, nodes: bytes, width: int) -> tuple[np.ndarray, CoverTree]:
            own = np.frombuffer(ids, np.int64)
            return own, CoverTree(np.frombuffer(x, np.float64).reshape(len(own), width), (points, nodes))

        for b in batches:
            for i in range(b.num_rows):
                block, width, *cells = (b.column(c)[i].as_py() for c in range(len(columns)))
                if block != at:
                    yield from done()
                    own, tree = opened(*cells[:4], width)
                    at, best = block, Best(own, k)
                ids, data = opened(*cells[4:], width)
                dual_tree(tree, data, ids, exact_products(tree.x, data.x), best)
        yield from done()

    return pairs.select(*columns).mapInArrow(tidied(run), "query_id long, id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products with vectors of other ids: query_id, rank, id, score; all if fewer.

    Components become floor(scale * x). Vectors that are null, or hold null or non-finite components, or have no id, take
    no part; vectors of unlike length have no product and are not compared. Ties go to the smaller id; a repeated row (same
    id and vector) counts as often as it occurs, and no row of the query's own id is its candidate. Products are exact
    whatever their size; scores that a long can't hold count as its largest or smallest. Columns besides the two are not
    read; an empty table gives an empty result.

    Both tables are packed into blocks, each with a cover tree that is built once, and each data block meets each query
    block once (the stated query set against all rows): data blocks are dealt to tasks, query blocks go to each of them, by
    a shuffle: the optimizer only knows their size before they are repeated for each task, and would broadcast that. A task searches the trees of its blocks together, carries each query's kth score from block to block, and returns k
    candidates a query; these are merged in two steps, so that none sees the candidates of all tasks. No task holds more
    than one block of either side at a time.
    """
    usable = lambda df: (
        df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .select("id", F.size("v").alias("width"), scaled("v", scale).alias("v"))
    )
    cells = ("ids", "x", "points", "nodes")
    renamed = lambda side: [F.col(c).alias(f"{side}_{c}") for c in cells]
    # Queries are packed from a few large partitions, so that their blocks are full.
    asked = _packed_blocks(usable(queries).repartition(1 + _estimate(queries) // 50_000_000), QUERY_BLOCK).withColumn("query_block", F.monotonically_increasing_id())
    size = _estimate(vectors)
    tasks = min(partitions(vectors, 16_000_000), 1 + size // 500_000) if size else partitions(vectors, 16_000_000)  # no more than find blocks
    asked = asked.select("query_block", "width", *renamed("q"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))
    data = _packed_blocks(usable(vectors), DATA_BLOCK).select("width", *renamed("d"), F.expr(f"cast(pmod(xxhash64(ids), {tasks}) as int)").alias("task"))
    columns = ["query_block", "width", *(f"{side}_{c}" for side in "qd" for c in cells)]
    found = _searched(data.join(asked.hint("merge"), ["width", "task"]).sortWithinPartitions("query_block"), k, columns)
    first = lambda df, *keys: df.groupBy("query_id", *keys).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))
    some = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks) + 1)))
    merged = first(first(some, "part").select("query_id", F.inline("best")).select("query_id", (-F.col("s")).alias("score"), "id"))
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias(id_column), (-F.col("b.s")).alias("score"))


def _estimate(df: DataFrame) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 2**50 else 0
