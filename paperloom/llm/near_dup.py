"""Near-duplicate classes of documents: BagMinHash signatures, banding, and verified multiset overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import as_bytes, cut, discard, mix, steps, text_steps, tidied, tidied_group, unit, windows, Words

#: Hashes of a signature, in BANDS bands of ROWS: a pair of similarity 0.8 shares no band with probability 1.9e-6.
BANDS, ROWS = 25, 4
#: Rounds in which each bucket that still holds several components tries another leader, before all that is left is compared.
LEADER_ROUNDS = 2
#: Buckets of more nodes than this compare what is left block by block, smaller ones pair by pair.
SMALL_BUCKET = 48
#: Nodes of a block, and shingles that two blocks are multiplied over at once.
BLOCK, COLUMNS = 256, 8192

_POINT, _PLACE, _BLOCK = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_NEXT, _SIDE, _HALVES = np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F), (np.uint64(0xEB44ACCAB455D165), np.uint64(0xC2B2AE3D27D4EB4F))
#: Keys of texts that a task remembers, so that it sends each of them once; it bounds memory, not the result.
REMEMBERED = 200_000


def bags(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """The shingles of texts as (owner, hash, count), sorted; a text of fewer than `size` words is one shingle."""
    w = Words(texts)
    h = w.hashes()
    owner = w.owners()
    s = windows(h, size)
    whole = owner[: len(s)] == owner[size - 1 : size - 1 + len(s)]
    s, o = s[whole], owner[: len(s)][whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        extra = np.array([windows(h[w.first[i] : w.first[i + 1]], int(w.counts[i]), salt=3)[0] for i in short.tolist()], np.uint64)
        s, o = np.concatenate([s, extra]), np.concatenate([o, short])
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    return o[at], s[at], np.diff(np.append(at, len(s))), w


def bag_min_hash(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """m registers for each text, whose share of agreement between two texts is unbiased for their weighted Jaccard similarity.

    Each shingle has Poisson processes over time and weight, from seeds that all texts share: one for each of the dyadic
    weight ranges (0,1], (1,2], (2,4], (4,8] ... that its count reaches. A process shows its first point alone. If the text's
    count covers the process's range, the point may enter its register; then the process is split into those of the range's
    halves, one of which keeps the point while the other draws a first one of its own after it, so that texts of different
    counts see the same points wherever both have weight. Halves above the count are dropped, a range of one weight draws
    its next point. A process ends as soon as its point comes after the text's last register, so long texts take little
    more than one point a shingle. All processes of all texts take a step at once, the earliest points of each coming first.
    """
    registers = np.full(texts * m, np.inf)
    blocks = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    one = np.repeat(np.arange(len(owner)), blocks)
    block = np.arange(len(one)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    o, w = owner[one], count[one].astype(np.int64)
    length = np.left_shift(np.int64(1), np.maximum(block - 1, 0))
    low = np.where(block > 0, length, 0)
    seed = mix(shingle[one] ^ (block.astype(np.uint64) * _BLOCK))

    def wait(seed: np.ndarray, length) -> np.ndarray:
        return -np.log(unit(mix(seed ^ _POINT))) / (length * m)

    time, mark = wait(seed, length), mix(seed ^ _PLACE)  # a point keeps its mark, which tells its register, wherever it goes
    worst = np.full(texts, np.inf)
    while len(o):
        on = time < worst[o]
        if not on.all():
            o, w, low, length, seed, time, mark = o[on], w[on], low[on], length[on], seed[on], time[on], mark[on]
        covered = low + length <= w
        register = ((mark >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(registers, o[covered] * m + register[covered], time[covered])
        active = np.flatnonzero(np.bincount(o, minlength=texts)) if len(o) else o
        worst[active] = registers.reshape(texts, m)[active].max(axis=1)
        split = np.flatnonzero(length > 1)
        # Ranges of one weight go on to their next point.
        single = length == 1
        seed = np.where(single, mix(seed ^ _NEXT), seed)
        after, fresh = time + wait(seed, 1), mix(seed ^ _PLACE)
        if not len(split):
            time, mark = after, fresh
            continue
        half, upper = length[split] // 2, (mix(seed[split] ^ _SIDE) >> np.uint64(63)).astype(np.int64)  # upper: the half that keeps the point
        halves = []
        for side in (0, 1):
            own, keeps = mix(seed[split] ^ _HALVES[side]), upper == side
            halves.append((o[split], w[split], low[split] + side * half, half, own, np.where(keeps, time[split], time[split] + wait(own, half)), np.where(keeps, mark[split], mix(own ^ _PLACE))))
        rest = (o[single], w[single], low[single], length[single], seed[single], after[single], fresh[single])
        o, w, low, length, seed, time, mark = (np.concatenate(c) for c in zip(rest, *halves))
        on = low < w
        o, w, low, length, seed, time, mark = o[on], w[on], low[on], length[on], seed[on], time[on], mark[on]
    return registers.reshape(texts, m)


def band_keys(registers: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(registers).view(np.uint64).reshape(-1, BANDS, ROWS)
    out = np.tile(mix(np.arange(BANDS, dtype=np.uint64)), (len(bits), 1))
    for r in range(ROWS):
        out = mix(out ^ bits[:, :, r])
    return out.view(np.int64)


def text_key(w: Words, i: int) -> bytes:
    """A 128-bit hash of a text's word sequence."""
    a, z = int(w.first[i]), int(w.first[i + 1])
    return hashlib.blake2b(b" ".join(w.raw[w.starts[a] : w.ends[z - 1]].split()) if z > a else b"", digest_size=16).digest()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """id, key (of the word sequence) and bands of every row of (id, text); bands are null where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, texts in text_steps(b.column(1)):
                owner, shingle, count, w = bags(texts, size)
                keys = band_keys(bag_min_hash(owner, shingle, count, high - low, BANDS * ROWS))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()), mask=pa.array(w.counts == 0))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array([text_key(w, i) for i in range(high - low)], pa.binary()), lists], ["id", "key", "bands"])

    return docs.mapInArrow(tidied(run), f"id {docs.schema['id'].dataType.simpleString()}, key binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle multisets have a Jaccard similarity of at least `least`; texts has (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = as_bytes(b.column(2)), as_bytes(b.column(3))
            good = np.zeros(b.num_rows, bool)
            both = [x for pair in zip(left, right) for x in pair]
            for low, high in ((x // 2, -(-y // 2)) for x, y in steps(both, 4_000_000)):
                part = list(dict.fromkeys(both[2 * low : 2 * high]))
                at = {t: i for i, t in enumerate(part)}
                owner, shingle, count, _ = bags(part, size)
                edge = np.searchsorted(owner, np.arange(len(part) + 1))
                for i in range(low, high):
                    (p, q), (r, s) = ((edge[k], edge[k + 1]) for k in (at[left[i]], at[right[i]]))
                    _, x, y = np.intersect1d(shingle[p:q], shingle[r:s], assume_unique=True, return_indices=True)
                    both_have = int(np.minimum(count[p:q][x], count[r:s][y]).sum())
                    either = int(count[p:q].sum() + count[r:s].sum()) - both_have
                    good[i] |= bool(either) and both_have >= least * either - 1e-9
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good))

    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(tidied(run), "a long, b long")


def _levels(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: (owner, hash of shingle and occurrence), so that multiset overlap is set overlap."""
    at = np.repeat(np.arange(len(owner)), count)
    level = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return owner[at], np.where(level > 0, mix(shingle[at] + level.astype(np.uint64) * _BLOCK), shingle[at])


def _overlaps(owner: np.ndarray, element: np.ndarray, left: int, right: int) -> np.ndarray:
    """The sizes of the overlaps of the sets of owners 0 .. left-1 with those of the `right` owners after them."""
    ids, place = np.unique(element, return_inverse=True)
    seen_left = np.bincount(place[owner < left], minlength=len(ids)) > 0
    seen_right = np.bincount(place[owner >= left], minlength=len(ids)) > 0
    column = np.where(seen_left & seen_right, np.cumsum(seen_left & seen_right) - 1, -1)[place]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((left, right), np.float64)
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, z = np.searchsorted(column, [low, low + COLUMNS])
        x = np.zeros((left + right, COLUMNS), np.float32)
        x[owner[a:z], column[a:z] - low] = 1
        out += x[:left] @ x[left:].T
    return out


def block_links(placed: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Links (a, b) between nodes of different components in the same bucket; placed has (bucket, node, component).

    A bucket's nodes are dealt to blocks of about BLOCK nodes, those of a large component to blocks of their own, and each
    pair of blocks that may hold two components is one group: all its pairs are compared by multiplying the two blocks'
    shingle matrices, and links alone come out. No group grows with its bucket.
    """
    sizes = cut(placed.groupBy("bucket", "component").agg(F.count("*").alias("n")))
    small = sizes.where(F.col("n") < BLOCK).groupBy("bucket").agg(F.sum("n").alias("rest"))
    sized = placed.join(sizes, ["bucket", "component"]).join(small, "bucket", "left")
    part = lambda what, n: F.pmod(F.xxhash64(what), F.ceil(F.col(n) / BLOCK))
    large = F.col("n") >= BLOCK
    dealt = cut(sized.select("bucket", "node", "component", F.when(large, F.col("component")).otherwise(-1).alias("own"), F.when(large, part("node", "n")).otherwise(part("component", "rest")).alias("part")))
    blocks = dealt.select("bucket", "own", "part").distinct()
    pairs = blocks.toDF("bucket", "own_a", "part_a").join(blocks.toDF("bucket", "own_b", "part_b"), "bucket")
    pairs = pairs.where((F.struct("own_a", "part_a") <= F.struct("own_b", "part_b")) & ((F.col("own_a") != F.col("own_b")) | (F.col("own_a") == -1)))
    key = ["bucket", "own_a", "part_a", "own_b", "part_b"]

    def side(name: str) -> DataFrame:
        return dealt.withColumnsRenamed({"own": f"own_{name}", "part": f"part_{name}"}).join(pairs, ["bucket", f"own_{name}", f"part_{name}"]).select(*key, F.lit(name).alias("side"), "node", "component")

    alone = (F.col("own_a") == F.col("own_b")) & (F.col("part_a") == F.col("part_b"))
    rows = side("a").union(side("b").where(~alone)).join(texts, "node")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("side")
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        left = int(np.count_nonzero(np.array(table.column("side").to_pylist()) == "a"))
        own = left == len(node)
        raw = as_bytes(table.column("text").combine_chunks())
        if own:
            raw, node, component = raw + raw, np.tile(node, 2), np.tile(component, 2)
        owner, element = [], []
        for low, high in steps(raw, 4_000_000):
            o, s, c, _ = bags(raw[low:high], size)
            o, s = _levels(o, s, c)
            owner.append(o + low)
            element.append(s)
        owner, element = np.concatenate(owner), np.concatenate(element)
        total = np.bincount(owner, minlength=len(node)).astype(np.float64)
        both = _overlaps(owner, element, left, len(node) - left)
        either = total[:left, None] + total[None, left:] - both
        good = (both >= least * either - 1e-9) & (either > 0) & (component[:left, None] != component[None, left:])
        i, j = np.nonzero(good)
        a, b = node[i], node[left + j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.select(*key, "side", "node", "component", "text").groupBy(*key).applyInArrow(tidied_group(compare), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node that edges lead to.

    Each round takes the smallest label among the neighbours' and then the label's own label, until none changes; the
    labels are written to the shared folder after each round, and those of the round before are removed.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.col("node").alias("old"), F.least("node", "near").alias("component")))
    while not labels.where("old <> component").isEmpty():
        last = labels.select("node", "component")
        near = both.join(last.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = last.withColumnRenamed("component", "old").join(near, "node").select("node", "old", F.least("old", "near").alias("label"))
        top = last.select(F.col("node").alias("label"), F.col("component").alias("above"))
        new = cut(new.join(top, "label").select("node", "old", F.least("label", "above").alias("component")))
        discard(labels)
        labels = new
    discard(both)
    return labels.select("node", "component")


def near_duplicates(docs: DataFrame, *, size: int = 5, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text", counts: bool = False) -> DataFrame:
    """One row for each row of docs: its id and class_id, the smallest id of its class; with counts, class_docs and class_texts too.

    class_docs counts the rows of its class, class_texts their different texts.

    Two texts are linked if their multisets of `size`-word shingles have a Jaccard similarity of at least `least`; texts of
    equal words are one text; classes are what links connect. Signatures find candidates, an exact comparison decides.

    Each distinct text is one node. Nodes that share a band are compared with the band's leader; in buckets that then hold
    nodes of several components the members try further leaders, and at the end all nodes of unlike components are compared,
    pair by pair in small buckets and block by block in large ones. So no candidate link between different components is left
    out, while a large group of copies takes few comparisons.

    A null or empty text has no words; all such rows are one class of equal texts. A null id gets the smallest id of its
    class, null if there is none; repeated rows have the same class. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    signed = cut(signatures(rows, size))
    nodes = cut(signed.groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    # What is counted by a key is written before it is joined by that key, so that Spark may split a hot key's side of the join.
    shared = cut(banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last"))
    members = cut(banded.join(shared, "bucket"))
    discard(shared)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in batches:
            for low, high, texts in text_steps(b.column(0)):
                w = Words(texts)
                keys = [text_key(w, i) for i in range(high - low)]
                new = [i for i, k in enumerate(keys) if k not in sent and not sent.add(k)]
                if len(sent) > REMEMBERED:
                    sent.clear()
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()), b.column(0).take(pa.array([low + i for i in new]))], ["key", "text"])

    # A text is found by its key, as ids may be null or stand for many texts; a task sends copies of a text once.
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("key", "node")
    found = rows.select("text").mapInArrow(tidied(keyed), "key binary, text string").join(wanted, "key")
    texts = cut(found.groupBy("node").agg(F.first("text").alias("text")))

    tested = cut(members.where("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    links = components(verified(tested, texts, size, least))
    linked = cut(members.select("node").distinct().join(links, "node", "left").select("node", F.coalesce("component", "node").alias("component")))

    def joined(links: DataFrame) -> DataFrame:
        """Components after more links: only what the links join is labelled anew, by components of components."""
        end = lambda name: linked.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
        between = cut(links.join(end("a"), "a").join(end("b"), "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())
        if between.isEmpty():
            discard(between)
            return linked
        above = components(between).select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = cut(linked.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component")))
        discard(between, linked)
        return new

    def split() -> DataFrame:
        """Members of the buckets that still hold several components, and how many they are."""
        placed = members.select("bucket", "node").join(linked, "node")
        open_ = cut(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held")).where("low < high").select("bucket", "held"))
        out = cut(placed.join(open_, "bucket"))
        discard(open_)
        return out

    def other(placed: DataFrame, partners: DataFrame) -> DataFrame:
        """Pairs of members and partners of one bucket and unlike components that were not compared before."""
        partners = partners.select("bucket", F.col("node").alias("other"), F.col("component").alias("other_component"))
        pairs = placed.join(partners, "bucket").where("component <> other_component").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        return cut(pairs.join(tested, ["a", "b"], "left_anti"))

    placed = split()
    for turn in range(1, LEADER_ROUNDS + 1):
        if placed.isEmpty():
            break
        order = F.xxhash64("node", "bucket", F.lit(turn))
        lead = placed.groupBy("bucket").agg(F.min(order).alias("order"))
        pairs = other(placed, placed.withColumn("order", order).join(lead, ["bucket", "order"]))
        linked = joined(verified(pairs, texts, size, least))
        tested = tested.union(pairs)
        discard(placed)
        placed = split()
    if not placed.isEmpty():
        few = placed.where(F.col("held") <= SMALL_BUCKET)
        linked = joined(verified(other(few, few), texts, size, least).union(block_links(placed.where(F.col("held") > SMALL_BUCKET).drop("held"), texts, size, least)))
    discard(placed, texts, members)
    classes = nodes.select("key", "id", "copies", "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = ["class_docs", "class_texts"] * counts
    named = cut(classes.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_docs"), F.count("*").alias("class_texts")))
    of_key = classes.join(named, "component").select("key", "class_id", *more)
    return signed.select("id", "key").join(of_key, "key").select(F.col("id").alias(id_column), "class_id", *more)


def keep_one(docs: DataFrame, *, size: int = 5, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that stand for their near-duplicate class: those with its smallest id.

    Of repeated rows (same id and text) one stays. Rows without an id can't be named by a class; one stays of each text.
    """
    classes = near_duplicates(docs, size=size, least=least, id_column=id_column, text_column=text_column)
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_column).alias("id"), F.md5(F.col(text_column).cast("binary")).alias("hash"))  # names can't clash in here
    kept = cut(classes.where(F.col(id_column) == F.col("class_id")).select(F.col(id_column).alias("kept")).distinct())
    # The join is the same at every size; repeated rows are rare, so only hashes are counted, and texts move again only if some repeat.
    again = cut(rows.groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again_id"), F.col("hash").alias("again_hash")))
    rows = rows.where("id is not null").join(kept.hint("merge"), F.col("id") == F.col("kept"), "left_semi").union(rows.where("id is null"))
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("again_id")) & F.col("hash").eqNullSafe(F.col("again_hash"))
        rows = rows.join(again, same, "left_anti").union(rows.join(again, same, "left_semi").dropDuplicates(["id", "hash"]))
    return rows.select(*(F.col("row")[c].alias(c) for c in names))
