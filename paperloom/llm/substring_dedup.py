"""Removal of repeated word passages, found through difference-cover anchors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.batches import as_bytes, partitions, steps, text_steps, tidied, tidied_group, windows, Words, xxhash64_long

#: The perfect difference cover of period 13: each remainder is the difference of two of these (fixed values).
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Anchors and windows that a task gathers before it sends them on, sorted by bucket.
GATHER = 400_000
#: Groups of texts for each bucket of hashes: many, so that hashing deals texts out evenly.
GROUPS_PER_BUCKET = 2
#: Bits of an anchor's hash that are sent; a chance agreement only adds a candidate.
ANCHOR_BITS = np.uint64(2**48 - 1)

#: A pair of id and text that more than this share of all rows have is hot: there are at most as many as its inverse.
HOT_SHARE = 1 / 1000

#: tag is a hash of the text; it tells apart the texts of rows that share an id. hash and check together are 96 bits of a window.
ENTRY = np.dtype([("hash", "<u8"), ("check", "<u4"), ("row", "<i8"), ("tag", "<i8"), ("place", "<i4")])
RUN = np.dtype([("row", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("length", "<i4")])
#: kind 0: entries of a bucket of hashes; kind 1: runs of a bucket of rows.
SENT = "kind int, bucket int, blob binary"


def _packed(x: np.ndarray) -> bytes:
    """x, column by column and byte by byte of significance, ids as differences, compressed."""
    planes = []
    for name in x.dtype.names:
        c = np.ascontiguousarray(x[name])
        if name in ("row", "tag"):
            c = np.concatenate([c[:1], c[1:] - c[:-1]])
        planes.append(c.view(np.uint8).reshape(len(c), -1).T.tobytes())
    return len(x).to_bytes(8, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    out = []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        raw = np.frombuffer(pa.decompress(blob[8:], n * dtype.itemsize, codec="zstd", asbytes=True), np.uint8)
        x, at = np.zeros(n, dtype), 0
        for name in dtype.names:
            kind = dtype[name]
            c = np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel()
            x[name] = np.cumsum(c, dtype=kind) if name in ("row", "tag") else c
            at += n * kind.itemsize
        out.append(x)
    return np.concatenate(out) if out else np.zeros(0, dtype)


def _by_bucket(kind: int, x: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, with its part of x."""
    if len(x):
        order = np.argsort(bucket, kind="stable")
        ids, at = np.unique(bucket[order], return_index=True)
        blobs = [_packed(p) for p in np.split(x[order], at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids.astype(np.int32)), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])


def _runs(e: np.ndarray, reach: int) -> np.ndarray:
    """The runs of words that entries cover, each with the `reach` words from its place on."""
    if not len(e):
        return np.zeros(0, RUN)
    e = e[np.lexsort((e["place"], e["tag"], e["row"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["row"][1:] != e["row"][:-1]) | (e["tag"][1:] != e["tag"][:-1]) | (e["place"][1:] > e["place"][:-1] + reach)
    at = np.flatnonzero(new)
    out = np.zeros(len(at), RUN)
    out["row"], out["tag"], out["start"] = e["row"][at], e["tag"][at], e["place"][at]
    out["length"] = e["place"][np.append(at[1:], len(e)) - 1] + reach - out["start"]
    return out


def _tags(texts: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives for each text."""
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts)).view(np.int64)


#: Where the number of a hot text's group is mixed into its key.
SPLIT_BIT = 44


class Dealer:
    """Which group of texts a run belongs to: one for each id and text, all groups among which the rows of a hot one are dealt."""

    def __init__(self, groups: int, hot: dict[int, int]):
        self.groups, self.hot, self.keys = groups, hot, np.array(sorted(hot), np.int64)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """pmod(xxhash64(key), groups)."""
        return xxhash64_long(np.ascontiguousarray(key)) % self.groups

    def __call__(self, runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = runs["row"] ^ runs["tag"]
        yield from _by_bucket(1, runs, self.bucket(key))
        if len(self.keys):
            for k in np.intersect1d(key, self.keys).tolist():
                mine = runs[key == k]
                for split in range(1, self.hot[k]):
                    yield from _by_bucket(1, mine, np.repeat(self.bucket(np.array([k ^ (split << SPLIT_BIT)], np.int64)), len(mine)))


def _hash_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(13)) % np.uint64(buckets)).astype(np.int64)


def _same(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by hash and check: which are the first of theirs, and how many share each one's."""
    first = np.ones(len(e), bool)
    first[1:] = (e["hash"][1:] != e["hash"][:-1]) | (e["check"][1:] != e["check"][:-1])
    sizes = np.diff(np.append(np.flatnonzero(first), len(e)))
    return first, np.repeat(sizes, sizes)


def _later(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by window, row and place; which are the first of their window, and which have an earlier one."""
    e = e[np.lexsort((e["place"], e["row"], e["check"], e["hash"]))]
    first, _ = _same(e)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(e)), 0))
    return e, first, (e["row"] != e["row"][lead]) | (e["place"] != e["place"][lead])


def _fill(texts: list[bytes], rows: np.ndarray, w: Words, at: np.ndarray, h: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """Entries for the windows with hashes h that start at the words `at`."""
    owner = w.owners()[at]
    out = np.zeros(len(at), ENTRY)
    out["hash"], out["row"], out["tag"], out["place"] = h[at], rows[owner], _tags(texts)[owner], w.places()[at]
    if check is not None:
        out["check"] = check[at] >> np.uint64(32)
    return out


def _anchors(texts: list[bytes], rows: np.ndarray, size: int) -> np.ndarray:
    """An entry for each window of `size` words that starts at a cover position of its text."""
    w = Words(texts)
    owner = w.owners()
    h = windows(w.hashes(), size, salt=5)
    at = np.flatnonzero(np.isin(w.places()[: len(h)] % PERIOD, COVER) & (owner[: len(h)] == owner[size - 1 : size - 1 + len(h)]))
    return _fill(texts, rows, w, at, h)


def remove_repeats(docs: DataFrame, *, size: int = 20, id_column: str = "doc_id", text_column: str = "text", text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every word covered by a window of `size` words whose words also start earlier in the corpus.

    Earlier is a smaller id, or the same document and an earlier start; windows are judged on the input. Returns id,
    n_words, n_removed, kept_sha256 (and, if asked for, text: the kept words joined by one space where some went, else
    the text as it was; and the columns to carry).

    A period-13 difference cover has 4 positions; for any two positions some shift below 13 brings both onto it. So two
    equal windows of `size` words hold, at the same offset, windows of `size - 12` words that both start at cover
    positions of their own documents. Only those anchors are hashed and compared (4 of 13 positions); each shared anchor
    then extends to the full windows around it, and the first of each window's holders keeps its words.

    Anchors and windows travel in blobs by hash bucket, texts by a hash of their row. Within a task equal hashes are
    combined first, so a passage that a third of all rows hold sends one entry a task. Nothing is capped.

    Windows are told apart by 96 bits. Texts are dealt by id and text, so that many rows without an id, or of one id, are
    spread as well; the rows of a pair of id and text that is hot (at most 1 / HOT_SHARE pairs are) are dealt to several groups,
    each of which gets what is found of that text.

    A null or empty text has no words. A null id counts as the smallest. Rows that share an id count as one document where
    starts are compared: neither of two equal starts is the earlier, so repeated rows both keep their words. Ids that are
    no whole numbers are an error. Columns besides the two are not read. An empty table gives an empty result.
    """
    if size < PERIOD:
        raise ValueError(f"size must be {PERIOD} at least")
    if not isinstance(docs.schema[id_column].dataType, T.IntegralType):
        raise TypeError(f"{id_column} must be of a whole number type, as the smaller id keeps a passage")
    buckets = partitions(docs)
    groups = buckets * GROUPS_PER_BUCKET
    anchor = size - PERIOD + 1
    null_row = -(2**63)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(null_row)).alias("row"), F.col(text_column).alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    key = F.col("row").bitwiseXOR(F.xxhash64(F.coalesce("text", F.lit(""))))
    most = max(1000, math.ceil(docs.count() * HOT_SHARE))
    hot = {r["key"]: -(-r["n"] // most) for r in rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()}
    deal = Dealer(groups, hot)

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                e = np.concatenate(held)
                held.clear()
                e["hash"] &= ANCHOR_BITS
                order = np.argsort(e["hash"], kind="stable")
                first, count = _same(e[order])
                runs = _runs(e[order[count > 1]], anchor)  # shared within the task: nobody else need be asked
                yield from deal(runs)
                ask = e[np.sort(order[first])]
                yield from _by_bucket(0, ask, _hash_bucket(ask["hash"], buckets))

        for b in batches:
            ids = b.column(0).to_numpy()
            for low, high, texts in text_steps(b.column(1), 1_000_000):
                held.append(_anchors(texts, ids[low:high], anchor))
                if sum(map(len, held)) > GATHER:
                    yield from send()
        yield from send()

    def in_buckets(batches: Iterator[pa.RecordBatch], settle) -> Iterator[pa.RecordBatch]:
        """Passes runs on and settles each bucket of entries, which arrive sorted by bucket."""
        held: list[bytes] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                runs = settle(_unpacked(held, ENTRY))
                held.clear()
                yield from deal(runs)

        for b in batches:
            kinds = b.column(0).to_numpy()
            passed = np.flatnonzero(kinds == 1)
            if len(passed):
                yield b.take(pa.array(passed))
            for i in np.flatnonzero(kinds == 0).tolist():
                if (k := b.column(1)[i].as_py()) != at:
                    yield from done()
                    at = k
                held.append(b.column(2)[i].as_py())
        yield from done()

    def shared_anchors(e: np.ndarray) -> np.ndarray:
        e = e[np.argsort(e["hash"], kind="stable")]
        return _runs(e[_same(e)[1] > 1], anchor)

    def later_windows(e: np.ndarray) -> np.ndarray:
        e, _, later = _later(e)
        return _runs(e[later], size)

    def with_runs(texts: pa.Table, blobs: pa.Table) -> Iterator[tuple[list[bytes], np.ndarray, Words, np.ndarray]]:
        """Steps of a bucket's texts with the words that runs cover."""
        runs = _unpacked(blobs.column("blob").to_pylist(), RUN)
        keys = runs["row"] ^ runs["tag"]
        order = np.argsort(keys, kind="stable")
        runs, keys = runs[order], keys[order]
        ids, all_texts = (texts.column("row").to_numpy(), as_bytes(texts.column("text").combine_chunks())) if texts.num_rows else (None, [])
        for low, high in steps(all_texts, 1_000_000):
            w, own = Words(all_texts[low:high]), ids[low:high]
            change = np.zeros(len(w.starts) + 1, np.int32)
            tags = _tags(all_texts[low:high])
            from_, to = (np.searchsorted(keys, own ^ tags, side) for side in ("left", "right"))
            for i in np.flatnonzero(to > from_).tolist():
                mine = runs[from_[i] : to[i]]
                mine = mine[(mine["tag"] == tags[i]) & (mine["row"] == own[i])]
                np.add.at(change, np.minimum(w.first[i] + mine["start"], w.first[i + 1]), 1)
                np.add.at(change, np.minimum(w.first[i] + mine["start"] + mine["length"], w.first[i + 1]), -1)
            yield all_texts[low:high], own, w, np.cumsum(change[:-1]) > 0

    def extend(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        out, found = [], []
        for own_texts, own, w, near in with_runs(texts, blobs):
            if near.any():
                h, owner = windows(w.hashes(), size, salt=7), w.owners()
                # Whoever holds a shared anchor has all its words near one.
                reach = np.concatenate([[0], np.cumsum(near)])
                at = np.flatnonzero((reach[size : size + len(h)] - reach[: len(h)] >= anchor) & (owner[: len(h)] == owner[size - 1 : size - 1 + len(h)]))
                found.append(_fill(own_texts, own, w, at, h, windows(w.hashes(), size, salt=11)))
        if found:
            e, first, later = _later(np.concatenate(found))
            out += deal(_runs(e[later], size))
            ask = e[first]  # of equal rows one entry is enough
            ask = ask[np.argsort(ask["row"], kind="stable")]
            out += _by_bucket(0, ask, _hash_bucket(ask["hash"], buckets))
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
        return pa.Table.from_batches(out, schema)

    def remove(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        n_words, n_removed, shas, kept, ids = [], [], [], [], []
        for own_texts, own, w, gone in with_runs(texts, blobs):
            for i, row in enumerate(own.tolist()):
                a, z = int(w.first[i]), int(w.first[i + 1])
                cut = gone[a:z]
                lost = int(cut.sum())
                # Whole stretches between removed words are cut out of the text, then their words are joined again.
                if lost:
                    edge = np.flatnonzero(np.diff(np.concatenate([[1], cut.astype(np.int8), [1]])))
                    left = b" ".join(b" ".join(w.raw[w.starts[a + p] : w.ends[a + q - 1]].split()) for p, q in edge.reshape(-1, 2).tolist())
                else:
                    left = b" ".join(w.raw[w.starts[a] : w.ends[z - 1]].split()) if z > a else b""
                n_words.append(z - a)
                n_removed.append(lost)
                shas.append(hashlib.sha256(left).hexdigest())
                if text:
                    kept.append((left if lost else own_texts[i]).decode())
                ids.append(row)
        columns = [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
        columns += [pa.array(kept, pa.string())] * text + ([texts.column("rest")] if carry else [])
        return pa.Table.from_arrays(columns, ["row", "n_words", "n_removed", "kept_sha256"] + ["text"] * text + ["rest"] * bool(carry))

    def settled(sent: DataFrame, settle) -> DataFrame:
        """The runs (bucket, blob) that entries by hash bucket come to."""
        dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("kind", "bucket")
        return dealt.mapInArrow(tidied(lambda batches: in_buckets(batches, settle)), SENT).select("bucket", "blob")

    dealt_texts = rows.withColumn("key", key)
    if hot:
        splits = F.broadcast(docs.sparkSession.createDataFrame(list(hot.items()), "key long, splits int"))
        split = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("splits", F.lit(1)))
        dealt_texts = dealt_texts.join(splits, "key", "left").withColumn("key", F.col("key").bitwiseXOR(F.shiftleft(split, SPLIT_BIT)))
    dealt_texts = dealt_texts.select(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("bucket"), "row", "text", *["rest"] * bool(carry))
    near = settled(rows.select("row", "text").mapInArrow(tidied(find_anchors), SENT), shared_anchors)
    cogroup = lambda runs, f, schema: dealt_texts.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(tidied_group(f), schema)
    gone = settled(cogroup(near, extend, SENT), later_windows)
    result = T.StructType.fromDDL("row long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text)
    out = cogroup(gone, remove, result.add(rows.schema["rest"]) if carry else result)
    own_id = F.when(F.col("row") != null_row, F.col("row")).cast(kind).alias(id_column)
    return out.select(own_id, "n_words", "n_removed", "kept_sha256", *["text"] * text, *(F.col("rest")[c].alias(c) for c in carry))


def cut_repeats(docs: DataFrame, *, size: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the repeated words of each text taken out and all other columns as they are; no row goes, even if no word stays."""
    others = [c for c in docs.columns if c not in (id_column, text_column)]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("others"))  # names can't clash in here
    out = remove_repeats(rows, size=size, id_column="id", text=True, carry=("others",))
    return out.select(*(F.col({id_column: "id", text_column: "text"}[c]).alias(c) if c in (id_column, text_column) else F.col("others")[c].alias(c) for c in docs.columns))
