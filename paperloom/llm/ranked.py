"""Ranked lexical search: windowed bucket scoring over postings, with a heap of the best documents of each item."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from paperloom.llm.batches import cut, discard, partitions, text_steps, tidied

#: A window is so many consecutive ids; a score array of as many longs, the unit that is scored at once, is half a MB.
WINDOW = 1 << 16
#: Pairs of item and term that are searched for at once, in one pass over the texts; more items take more passes.
PAIRS = 500_000
#: Postings from which on a list's bits are kept for the window; there are few such lists, as a window's postings are bounded.
COMMON = WINDOW // 16
#: Bytes of text whose terms are counted at once.
PART = 1_000_000

#: Term bytes: digits, letters, and all of characters beyond ASCII; A-Z become a-z, what separates terms becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    plain = text.translate(_TABLE)
    low = 0
    while low < len(plain):
        high = plain.find(b" ", low + PART)
        high = len(plain) if high < 0 else high
        yield plain[low:high].split()
        low = high


@dataclass
class Items:
    """Items of a search: their ids, the terms of all of them, and which terms each holds (starts, of)."""

    ids: list
    names: list[bytes]
    starts: np.ndarray
    of: np.ndarray


def gathered(rows: list[Row]) -> Items:
    """rows of (id, terms), each an item of its own."""
    numbers: dict[bytes, int] = {}
    of = [[numbers.setdefault(t.encode(), len(numbers)) for t in r.terms] for r in rows]
    return Items([r.id for r in rows], list(numbers), np.cumsum([0, *map(len, of)]), np.array([k for x in of for k in x], np.int64))


def postings(docs: DataFrame, items: Items) -> DataFrame:
    """(id, row, n, terms, counts) of each row of (id, text) that holds a term: how many, and which of the items' terms how often."""
    numbers = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(items.names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value.get
        for b in batches:
            for low, high, texts in text_steps(b.column(1)):
                n, found, counts = [], [], []
                for text in texts:
                    held, parts = 0, []
                    for some in terms(text):
                        held += len(some)
                        parts.append(np.unique([k for k in map(known, some) if k is not None], return_counts=True))
                    n.append(held)
                    if len(parts) > 1:
                        which, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                        parts = [(which, np.bincount(at, np.concatenate([c for _, c in parts]), len(which)))]
                    found.append(np.asarray(parts[0][0] if parts else [], np.int32))
                    counts.append(np.asarray(parts[0][1] if parts else [], np.int32))
                edges = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x))) for x in (found, counts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(tidied(run), f"id {kind}, n long, terms array<int>, counts array<int>").where("n > 0").withColumn("row", F.monotonically_increasing_id())


class Best:
    """The k highest scores so far, ties to smaller ids."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def harvest(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:  # what is below the kth of these alone can't stay
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[keep], ids[keep]
        for s, i in sorted(zip(scores.tolist(), (-ids).tolist()), reverse=True)[: self.k]:
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (s, i))
            elif (s, i) > self.heap[0]:
                heapq.heapreplace(self.heap, (s, i))
            else:
                break


def score_window(items: Items, weights: np.ndarray, ids: np.ndarray, m: np.ndarray, slot: np.ndarray, term: np.ndarray, tf: np.ndarray, best: list[Best]) -> None:
    """Adds the documents of a window to the best of each item; slot, term and tf are its postings, in any order.

    An item's postings are traversed term by term and added up in an array with a slot for each document, while a bitset
    takes down which slots are occupied; the occupied ones are harvested into the item's heap, and only they are cleared.
    """
    order = np.argsort(term, kind="stable")
    slot, term = slot[order], term[order]
    tf = tf[order].astype(np.int64)
    share = (1_000_000_000 * tf) // (1000 * tf + 8 * m[slot])
    held, low = np.unique(term, return_index=True)
    high = np.append(low[1:], len(term))
    where = np.full(len(weights), -1, np.int64)
    where[held] = np.arange(len(held))
    scores, occupied = np.zeros(len(ids), np.int64), np.zeros(-(-len(ids) // 8), np.uint8)
    bit = (1 << (slot & 7)).astype(np.uint8)
    common: dict[int, np.ndarray] = {}

    def occupy(j: int, a: int, z: int) -> None:
        if z - a < COMMON:
            np.bitwise_or.at(occupied, slot[a:z] >> 3, bit[a:z])
            return
        if j not in common:  # the bits of a long list are set once for all items that hold its term
            flags = np.zeros(len(ids), np.uint8)
            flags[slot[a:z]] = 1
            common[j] = np.packbits(flags, bitorder="little")
        np.bitwise_or(occupied, common[j], out=occupied)

    for q, heap in enumerate(best):
        own = items.of[items.starts[q] : items.starts[q + 1]]
        lists = [(int(t), int(j)) for t, j in zip(own, where[own]) if j >= 0 and weights[t] > 0]
        if not lists:
            continue
        for t, j in lists:
            a, z = low[j], high[j]
            scores[slot[a:z]] += weights[t] * share[a:z]  # a term's slots are all different
            occupy(j, a, z)
        found = np.flatnonzero(np.unpackbits(occupied, count=len(ids), bitorder="little"))
        worth = scores[found]
        heap.harvest(worth[worth > 0], ids[found[worth > 0]])
        scores[found] = 0
        occupied[:] = 0


def _searched(posted: DataFrame, items: Items, weights: np.ndarray, docs: int, length: int, k: int, tasks: int) -> DataFrame:
    """(item, id, score): the k best documents of each item among those of a task."""
    sent = posted.sparkSession.sparkContext.broadcast((items.starts, items.of, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, of, weight = sent.value
        held = Items([], [], starts, of)
        best = [Best(k) for _ in range(len(starts) - 1)]
        parts: list[tuple] = []
        at, count = None, 0

        def score() -> None:
            ids, n, sizes, term, tf = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            large = int(n.max()) * docs * 90 >= 2**63
            m = 100 - 90 + ((90 * docs * n.astype(object)) // length).astype(np.int64) if large else 100 - 90 + (90 * docs * n) // length
            score_window(held, weight, ids, m, np.repeat(np.arange(len(ids)), sizes), term, tf, best)

        for b in batches:
            ids, n = (b.column(i).to_numpy() for i in (0, 1))
            window = ids // WINDOW
            edges = [0, *(np.flatnonzero(np.diff(window)) + 1).tolist(), len(ids)]
            sizes = np.diff(b.column(2).offsets.to_numpy())
            offsets = b.column(2).offsets.to_numpy()
            term, tf = (b.column(i).values.to_numpy(zero_copy_only=False) for i in (2, 3))
            low = 0
            for high in (e for e in edges[1:]):
                while low < high:
                    if window[low] != at or count >= WINDOW:  # a window with repeated ids may hold more rows than slots
                        if parts:
                            score()
                        at, count = window[low], 0
                    end = min(high, low + WINDOW - count)
                    a, z = offsets[low], offsets[end]
                    parts.append((ids[low:end], n[low:end], sizes[low:end], term[a:z], tf[a:z]))
                    count += end - low
                    low = end
        if parts:
            score()
        rows = [(q, -i, s) for q, heap in enumerate(best) for s, i in heap.heap]
        for low in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[low : low + 10_000])], ["item", "id", "score"])

    # Windows go by ranges of ids, and rows of one id are dealt by their numbers, so that no task gets more than its share.
    dealt = posted.select("id", "n", "terms", "counts", "row").repartitionByRange(tasks, "id", "row").sortWithinPartitions("id", "row")
    return dealt.select("id", "n", "terms", "counts").mapInArrow(tidied(run), "item long, id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", pairs: int = PAIRS) -> DataFrame:
    """Each item's k highest-scoring documents with a score above 0: item, rank, id, score; all if fewer.

    Terms are the maximal runs of ASCII letters and digits and characters beyond ASCII, of which only A-Z are lower-cased.
    N documents have a term, L terms with repeats all together; a document has n, of which tf are a term that df documents
    hold. The term weighs w = floor(1000 * ln((2N+2) / (2df+1))); m is 10 + 90*n*N div L, and a document's score is
    the sum over the item's distinct terms of w * (1000000000*tf div (1000*tf + 8*m)). Equal scores go by id.

    Each row of docs is a document: repeated rows and ids count, and are ranked, as often as they occur. Rows without an id
    count as documents but are not ranked. Each row of items is an item with ranks of its own. Null and empty texts have no terms: nothing is found for, or in, them. Other columns are not read; empty tables
    give an empty result.

    All texts are read once for `pairs` pairs of item and term, as many as the driver and each task hold at a time (one
    item's terms at least). Their postings are written, counted for N, L and df, and sorted into windows of ids.
    """
    spark = docs.sparkSession
    kind = items.schema[item_column].dataType.simpleString()
    asked = items.select(F.col(item_column).alias("id"), F.array_distinct(F.expr(rf"regexp_extract_all(translate(`{item_text_column}`, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)")).alias("terms")).where(F.size("terms") > 0)
    asked = asked.withColumn("part", F.xxhash64("id", "terms"))
    total = asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    passes = -(-total // pairs)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    out = spark.createDataFrame([], f"item {kind}, rank int, id long, score long")
    for p in range(passes):
        block = gathered(asked.where(F.pmod("part", F.lit(passes)) == p).select("id", "terms").collect())
        if not block.ids:
            continue
        posted = cut(postings(rows, block))
        sums = posted.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
        if not sums.docs:
            discard(posted)
            continue
        weights = np.full(len(block.names), 0, np.int64)
        for r in posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the items have terms
            weights[r.t] = math.floor(1000 * math.log((2 * sums.docs + 2) / (2 * r["count"] + 1)))
        found = _searched(posted.where("id is not null"), block, weights, sums.docs, sums.length, k, partitions(docs, 32_000_000))
        # Candidates are merged in two steps, so that none sees those of all tasks.
        best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best")
        some = found.withColumn("part", F.spark_partition_id() % 64).groupBy("item", "part").agg(best).select("item", F.inline("best")).select("item", "id", (-F.col("s")).alias("score"))
        top = cut(some.groupBy(F.col("item").alias("number")).agg(best).select("number", F.posexplode("best").alias("at", "b")))
        discard(posted)
        named = spark.createDataFrame(list(enumerate(block.ids)), f"number long, item {kind}")
        out = out.union(top.join(named, "number").select("item", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score")))
    return out.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")
