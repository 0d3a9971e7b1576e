"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import cut, mix, one_a_id, text_steps, tidied

#: Labelled documents that the model is fitted on, the first by a hash of their id.
SAMPLE = 20_000
#: Word and word-start features that may enter the model: the most telling ones of the sample.
FEATURES = 4096
#: Lengths in bytes of the word starts that are features besides whole words.
STARTS = (4, 5, 6, 7, 8)
#: Toxic documents of the sample that a feature occurs in at least.
LEAST_DOCUMENTS = 3
#: Steps of the optimiser, and the decay of a weight, over the toxic documents of the sample that hold its feature.
STEPS, DECAY = 800, 3e-5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Sentences:
    """Words of texts (runs of letters, digits and bytes above 127, in lower case), their features, and their sentences."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join([*texts, b""])
        self.buf = np.frombuffer(raw, np.uint8)
        letter = ((self.buf | 32) >= 97) & ((self.buf | 32) <= 122) | (self.buf >= 128) | (self.buf >= 48) & (self.buf <= 57)
        edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.cumsum(lengths) - lengths
        self.owner = np.searchsorted(self.text_starts, self.starts, "right") - 1
        stop = (self.buf == 46) | (self.buf == 33) | (self.buf == 63) | (self.buf == 10)
        stops = np.concatenate([[0], np.cumsum(stop)])
        number = stops[self.starts]  # a sentence ends at . ! ? or a line's end
        self.new = np.ones(len(self.starts), bool)
        self.new[1:] = number[1:] != number[:-1]
        self.sentence = np.cumsum(self.new) - 1
        self.sentence_owner = self.owner[self.new]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) of each whole word and each start of it that is shorter than the word."""
        length = self.ends - self.starts
        folded = np.append(_FOLD[self.buf], np.zeros(max(STARTS), np.uint8))
        h = np.zeros(len(self.starts), np.uint64)
        out, words = [], []
        for j in range(max(STARTS)):
            h = h * np.uint64(0x100000001B3) + folded[self.starts + j].astype(np.uint64) + np.uint64(1)
            if j + 1 in STARTS:
                at = np.flatnonzero(length > j + 1)
                out.append(mix(h[at] ^ np.uint64(j + 1)))
                words.append(at)
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        powers = np.cumprod(np.concatenate([[1], np.full(max(0, int(length.max(initial=1)) - 1), 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64))
        flat = folded[np.repeat(self.starts, length) + place].astype(np.uint64) + np.uint64(1)
        if len(length):
            out.append(mix(np.add.reduceat(flat * powers[place], np.cumsum(length) - length) ^ np.uint64(99)))
            words.append(np.arange(len(length)))
        return (np.concatenate(words), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


class Lookup:
    """Where features stand in the model's sorted list; a bit table answers for most that are none of it."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(known >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in feature, places in the list) of those that are known."""
        at = np.flatnonzero(self.bits[(feature >> np.uint64(44)).astype(np.int64)])
        if not len(self.known) or not len(at):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.known, feature[at]), len(self.known) - 1)
        good = self.known[place] == feature[at]
        return at[good], place[good]


@dataclass
class Model:
    """Sorted features with their weights, and the sentence intercept."""

    known: np.ndarray
    weights: np.ndarray
    intercept: float


def _distinct(sentence: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(sentence.astype(np.int64) * FEATURES * 2 + place)
    return pairs // (FEATURES * 2), pairs % (FEATURES * 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on documents (id, text) with labels (id, label); both as DataFrames, at most SAMPLE of them.

    The sample is the first by a hash of the id, sent to all tasks (SAMPLE rows of id and label); of rows that share an id
    one stands for it, that of the least hash, and an id with several labels is toxic if one of them says so. Executors count in how
    many toxic and other documents each feature occurs; the FEATURES most telling ones come to the driver, then which of
    them each sentence of the sample holds. There the noisy-or likelihood of the document labels is maximised.
    """
    chosen = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = cut(one_a_id(docs.join(F.broadcast(chosen), "id").withColumn("label", F.col("label").cast("int")), "label").select("text", "label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy()
            for low, high, texts in text_steps(b.column(0)):
                s = Sentences(texts)
                word, feature = s.features()
                owner = s.owner[word]
                order = np.lexsort((owner, feature))
                feature, owner = feature[order], owner[order]
                first = np.ones(len(feature), bool)
                first[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
                feature, toxic = feature[first], label[low:high][owner[first]] == 1
                ids, at = np.unique(feature, return_index=True)
                n, t = np.diff(np.append(at, len(feature))), np.add.reduceat(toxic.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(t), pa.array(n.astype(np.int64) - t)], ["feature", "toxic", "other"])

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    if not n_toxic or not n_other:
        return none
    share = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    telling = F.col("toxic") * F.log(share("toxic", n_toxic) / share("other", n_other))
    best = sample.mapInArrow(tidied(count), "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    best = best.where((F.col("toxic") >= LEAST_DOCUMENTS) & (share("toxic", n_toxic) > 4 * share("other", n_other))).orderBy(telling.desc(), "feature").limit(FEATURES).collect()
    if not best:
        return none
    known = np.array([r["feature"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(known)
    known, decay = known[order], DECAY / np.array([r["toxic"] for r in best], np.float64)[order]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(known)
        for b in batches:
            for low, high, texts in text_steps(b.column(0)):
                s = Sentences(texts)
                word, feature = s.features()
                at, place = find(feature)
                sentence, place = _distinct(s.sentence[word[at]], place)
                counts = np.bincount(s.sentence_owner, minlength=high - low)
                first = np.cumsum(counts) - counts
                cuts = np.searchsorted(s.sentence_owner[sentence], np.arange(high - low + 1))
                lists = [pa.array([x[p:q] for p, q in zip(cuts, cuts[1:])], pa.list_(pa.int64())) for x in (sentence - first[s.sentence_owner[sentence]], place)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(low, high - low), pa.array(counts.astype(np.int64)), *lists], ["label", "sentences", "at", "place"])

    rows = sample.mapInArrow(tidied(hits), "label int, sentences long, at array<long>, place array<long>").collect()
    label = np.array([r["label"] for r in rows])
    total = np.array([r["sentences"] for r in rows], np.float64)
    size = np.array([len(r["at"]) for r in rows])
    doc = np.repeat(np.arange(len(rows)), size)
    raw = np.array([x for r in rows for x in r["at"]], np.int64)
    place = np.array([x for r in rows for x in r["place"]], np.int64)
    _, sentence = np.unique(np.stack([doc, raw]), axis=1, return_inverse=True) if len(doc) else (None, doc)
    sentence = sentence.ravel()
    n = int(sentence.max(initial=-1)) + 1
    of = np.zeros(n, np.int64)
    of[sentence] = doc
    plain = total - np.bincount(of, minlength=len(rows))  # sentences without any feature

    x, m, v = np.concatenate([np.full(len(known), 1.0), [-6.0]]), 0.0, 0.0
    for step in range(1, STEPS + 1):
        w, c = x[:-1], x[-1]
        z = c + np.bincount(sentence, w[place], n)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-c))
        clear = np.bincount(of, np.logaddexp(0, z), len(rows)) + plain * np.logaddexp(0, c)  # -log of the chance of no toxic sentence
        pull = np.where(label == 1, -1 / np.maximum(np.expm1(np.minimum(clear, 500)), 1e-9), 1.0) / len(rows)
        g = p * pull[of]
        grad = np.concatenate([np.bincount(place, g[sentence], len(w)) + decay * w, [float((plain * p0 * pull).sum() + g.sum())]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        x[-1] = min(x[-1], -3.0)
    return Model(known, x[:-1], float(x[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score, offending) of every row of (id, text): the chance that some sentence is toxic, and the sentences whose own chance is 0.5 or more, as start:end in code points, comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(model.known)
        for b in batches:
            for low, high, texts in text_steps(b.column(1)):
                s = Sentences(texts)
                word, feature = s.features()
                at, place = find(feature)
                sentence, place = _distinct(s.sentence[word[at]], place)
                z = model.intercept + np.bincount(sentence, model.weights[place] if len(place) else None, len(s.sentence_owner))
                clear = np.bincount(s.sentence_owner, np.logaddexp(0, z), high - low)
                spans = [""] * (high - low)
                if (z >= 0).any():
                    points = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80)])
                    first = np.flatnonzero(s.new)
                    last = np.append(first[1:], len(s.starts)) - 1
                    for k in np.flatnonzero(z >= 0).tolist():
                        o = int(s.sentence_owner[k])
                        base = points[s.text_starts[o]]
                        spans[o] += f",{points[s.starts[first[k]]] - base}:{points[s.ends[last[k]]] - base}"
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(-np.expm1(-clear)), pa.array([x[1:] for x in spans], pa.string())], ["id", "score", "offending"])

    return docs.mapInArrow(tidied(run), f"id {docs.schema['id'].dataType.simpleString()}, score double, offending string")


def toxicity(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """Fits on `labels` (which the caller restricts to what may be learnt from) and scores every row of docs: id, score, offending.

    Whole texts are read; labels, lang, source and ids are no inputs of a score. A null or empty text has no sentence and
    scores 0. Without labels of both kinds, or without a telling feature, every text scores near 0. Repeated rows get equal
    scores; null ids stay null. Documents are not shuffled: the bounded sample of label rows goes to the documents' tasks.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
    return score(rows, fit(rows, known)).withColumnRenamed("id", id_column)
