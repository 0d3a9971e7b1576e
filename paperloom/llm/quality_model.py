"""Quality classifier from positive and unlabelled documents, by the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import cut, discard, text_steps, tidied, windows, Words

#: Trusted positives that the model is fitted on, the first by a hash of their id; of unlabelled documents as many make the
#: start of the fit and the models that tell the prior, while the risk itself is of all of them.
SAMPLE = 8000
HIDDEN, STEPS, DECAY, SEED = 12, 400, 1e-3, 7
#: Steps over all unlabelled documents, each of which is one pass over their features.
WHOLE_STEPS = 12


def features(texts: list[bytes]) -> np.ndarray:
    """A row of style features for each text; all zeros (but for the sizes) where there is no word."""
    w = Words(texts)
    n = len(texts)
    owner, length = w.owners(), (w.ends - w.starts).astype(np.float64)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    text_of = np.repeat(np.arange(n), lengths + 1)
    per = lambda mask: np.bincount(text_of[mask], minlength=n).astype(np.float64)
    b = w.buf
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    solid = np.maximum(per(~w.blank), 1)
    words = np.maximum(w.counts, 1).astype(np.float64)
    symbol = np.isin(b, np.frombuffer(b"#*$%&|<>", np.uint8))
    columns = [np.log1p(w.counts), np.log1p(solid / words), per(symbol) / solid, per(b == 33) / solid, per(b == 124) / solid, per(upper) / np.maximum(per(upper) + per(lower), 1), per(digit) / solid, per((b == 46) | (b == 44)) / words, per(b >= 128) / solid]
    columns.append(np.bincount(owner, length <= 2, n) / words)
    columns.append(np.bincount(owner, b[w.ends - 1] == 33, n) / words if len(owner) else np.zeros(n))
    h = w.hashes()
    # Words equal to the one before, distinct words, and words in 5-word windows that occur again.
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    columns.append(np.bincount(owner, same, n) / words)
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], new, n)
    columns += [distinct / words, np.log1p(distinct), distinct / np.sqrt(words)]
    top = np.zeros(n)
    if len(h):
        runs = np.diff(np.append(np.flatnonzero(new), len(h)))
        np.maximum.at(top, owner[order][new], runs)
    columns.append(top / words)
    s = windows(h, 5)
    whole = np.flatnonzero(owner[: len(s)] == owner[4 : 4 + len(s)])
    repeated = np.zeros(len(h) + 1, np.int64)
    if len(whole):
        at = whole[np.lexsort((s[whole], owner[whole]))]
        equal = np.zeros(len(at) + 1, bool)
        equal[1:-1] = (s[at][1:] == s[at][:-1]) & (owner[at][1:] == owner[at][:-1])
        again = at[equal[1:] | equal[:-1]]
        np.add.at(repeated, again, 1)
        np.add.at(repeated, again + 5, -1) if len(again) else None
    columns.append(np.bincount(owner, np.cumsum(repeated[:-1])[: len(h)] > 0, n) / words if len(h) else np.zeros(n))
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    columns.append(np.array([1 - len(set(x)) / max(1, len(x)) for x in lines]))
    columns.append(np.array([np.log1p(len(x)) for x in lines]))
    return np.stack(columns, axis=1) if n else np.zeros((0, len(columns)))


@dataclass
class Model:
    """Scaling of the features and the weights of a network with one hidden layer; None scores 1 everywhere."""

    mean: np.ndarray
    spread: np.ndarray
    layers: tuple
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return 1 / (1 + np.exp(-np.clip(np.tanh(np.clip((x - self.mean) / self.spread, -6, 6) @ a + b) @ c + d, -50, 50)))


def _train(x: np.ndarray, positive: np.ndarray, prior: float | None) -> tuple:
    """Layers that minimise the non-negative risk at a class prior, or plain log loss of positive against the rest."""
    rng = np.random.RandomState(SEED)
    p = [rng.randn(x.shape[1], HIDDEN) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.randn(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    for step in range(1, STEPS + 1):
        hidden = np.tanh(x @ p[0] + p[1])
        s = 1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -50, 50)))
        if prior is None:
            pull = np.where(positive, (s - 1) / n_p, s / n_u)
        else:
            # Risk = prior E_p[l(+)] + max(0, E_u[l(-)] - prior E_p[l(-)]) with the logistic loss; where the second part is
            # negative, steps go against it only.
            minus = -np.log(np.maximum(1 - s, 1e-12))
            rest = minus[~positive].mean() - prior * minus[positive].mean()
            negative_part = np.where(positive, -prior * s / n_p, s / n_u)
            pull = negative_part + np.where(positive, prior * (s - 1) / n_p, 0) if rest >= 0 else -negative_part
        back = (pull[:, None] * p[2]) * (1 - hidden**2)
        grads = [x.T @ back + DECAY * p[0], back.sum(0), hidden.T @ pull + DECAY * p[2], np.array([pull.sum()])]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return tuple(p)


def cutoffs(scores: np.ndarray) -> np.ndarray:
    """The scores above which estimate_prior() compares shares: quantiles of those of the positives."""
    return np.quantile(np.sort(scores), np.linspace(0.0, 0.5, 51))


def estimate_prior(scores: np.ndarray, positive: np.ndarray, more: np.ndarray | None = None) -> float:
    """The share of positives among the unlabelled: the least ratio of the two kinds' shares above a score.

    No region holds a smaller share of the unlabelled than prior times its share of positives, so the ratio over regions
    is an upper bound that is tight where hardly any negative lies. Regions with under half of the positives are left out,
    and a standard error is added, so that chance does not make the bound too small. The scores must come from a model that
    was fitted on other rows, or positives score above unlabelled rows of their kind. more: counts of further unlabelled rows
    by how many of the cutoffs they reach.
    """
    more = np.zeros(52, np.int64) if more is None else more
    p, u = np.sort(scores[positive]), np.sort(scores[~positive])
    at, n_u = cutoffs(p), len(u) + more.sum()
    share_p, share_u = 1 - np.searchsorted(p, at) / len(p), 1 - (np.searchsorted(u, at) + np.cumsum(more)[:-1]) / n_u
    error = np.sqrt(share_u * (1 - share_u) / n_u + (share_u / share_p) ** 2 * share_p * (1 - share_p) / len(p))
    return float(np.clip(((share_u + error) / share_p).min(), 0.01, 0.99))


def tabled(docs: DataFrame) -> DataFrame:
    """(id, hash, x): the features of every row of (id, text), written to the shared folder; texts are read once and not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, texts in text_steps(b.column(1)):
                x = features(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), b.column(2).slice(low, high - low), lists], ["id", "hash", "x"])

    kind = docs.schema["id"].dataType.simpleString()
    return cut(docs.select("id", "text", F.xxhash64("text").alias("hash")).mapInArrow(tidied(run), f"id {kind}, hash long, x array<double>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _reached(unlabelled: DataFrame, models: list[tuple[Model, np.ndarray]]) -> list[np.ndarray]:
    """For each model, how many unlabelled rows reach how many of its cutoffs."""
    out = [np.zeros(52, np.int64) for _ in models]
    if not models:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _matrix(b.column(0)), np.zeros(b.num_rows, np.int64)
            for model, cuts in models:
                at = at * 64 + np.searchsorted(cuts, model(x), "right")
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])

    for r in unlabelled.select("x").mapInArrow(tidied(run), "at long").groupBy("at").count().collect():
        at = r["at"]
        for counts in reversed(out):
            counts[at % 64] += r["count"]
            at //= 64
    return out


def _pulled(p: list[np.ndarray], z: np.ndarray, pull) -> tuple[float, list[np.ndarray]]:
    """The summed loss of a label of 0, and the gradients of what pulls the scores of rows z by pull(s)."""
    hidden = np.tanh(z @ p[0] + p[1])
    s = 1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -50, 50)))
    by = pull(s)
    back = (by[:, None] * p[2]) * (1 - hidden**2)
    return float(-np.log(np.maximum(1 - s, 1e-12)).sum()), [z.T @ back, back.sum(0), hidden.T @ by, np.array([by.sum()])]


def _refined(unlabelled: DataFrame, model: Model, z_p: np.ndarray) -> tuple:
    """The model's layers after WHOLE_STEPS steps down the non-negative risk of the positives z_p and all unlabelled rows.

    Each step is one pass over the features: tasks add up losses and gradients, of which as many numbers as the model has
    weights come back.
    """
    p, prior = [a.copy() for a in model.layers], model.prior
    shapes = [a.shape for a in p]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, WHOLE_STEPS + 1):
        now = [a.copy() for a in p]

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + sum(a.size for a in now))
            for b in batches:
                z = np.clip((_matrix(b.column(0)) - model.mean) / model.spread, -6, 6)
                loss, grads = _pulled(now, z, lambda s: s)
                total += np.concatenate([[len(z), loss], *(g.ravel() for g in grads)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "s"])

        sums = unlabelled.select("x").mapInArrow(tidied(run), "k int, s double").groupBy("k").agg(F.sum("s").alias("s"))
        total = np.array([r.s for r in sums.agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("all")).first()["all"]])
        n_u, n_p = max(total[0], 1), len(z_p)
        of_u = [g.reshape(shape) / n_u for g, shape in zip(np.split(total[2:], np.cumsum([a.size for a in p])[:-1]), shapes)]
        loss_p, minus_p = _pulled(p, z_p, lambda s: s * prior / n_p)
        _, plus_p = _pulled(p, z_p, lambda s: (s - 1) * prior / n_p)
        rest = total[1] / n_u - prior * loss_p / n_p
        for i in range(len(p)):
            g = of_u[i] - minus_p[i] + plus_p[i] if rest >= 0 else minus_p[i] - of_u[i]
            g = g + DECAY * p[i] * (i in (0, 2))
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] - 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return tuple(p)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """fit_tabled() of documents (id, text)."""
    table = tabled(docs)
    out = fit_tabled(table, labels)
    discard(table)
    return out


def fit_tabled(table: DataFrame, labels: DataFrame) -> Model | None:
    """Fits the model on tabled() documents: positives are ids with label 1, unlabelled rows those whose id has no label.

    At most SAMPLE positives are taken, the first by a hash of the id; of rows that share an id one stands for it, that of
    the least hash. Labels of 0 are not used. The driver gets SAMPLE rows of numbers of each kind at most: with these the fit
    starts. Class prior and risk are of all unlabelled rows: both cross-fitted models score and count them, and the last
    steps go down the risk of all of them.
    """
    known = labels.where("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    positives = known.where("label = 1").select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows_p = table.join(F.broadcast(positives), "id").groupBy("id").agg(F.min(F.struct("hash", "x")).alias("r")).select("r.x").collect()
    unlabelled = cut(table.where("id is not null").join(known.select("id"), "id", "left_anti").select("id", "hash", "x"))
    rows_u = unlabelled.orderBy(F.xxhash64("id", "hash"), "id", "hash").limit(SAMPLE).select("x").collect()
    if not rows_p or not rows_u:
        discard(unlabelled)
        return None
    x, positive = np.array([r.x for r in rows_p + rows_u]), np.arange(len(rows_p) + len(rows_u)) < len(rows_p)
    order = np.lexsort(x.T[::-1])  # the same sums whatever order rows came in
    x, positive = x[order], positive[order]
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / spread, -6, 6)
    half = np.random.RandomState(SEED).permutation(len(z)) % 2 == 0
    held = []
    for side in (half, ~half):
        if 0 < positive[side].sum() < side.sum() and 0 < positive[~side].sum() < (~side).sum():
            model = Model(mean, spread, _train(z[side], positive[side], None), 0.5)
            held.append((model, model(x[~side]), positive[~side]))
    models = [(model, cutoffs(scores[own])) for model, scores, own in held]
    # The sample's own rows are among all rows, and are no further ones.
    seen = [np.bincount(np.searchsorted(cuts, model(x[~positive]), "right"), minlength=52) for model, cuts in models]
    priors = [estimate_prior(scores, own, np.maximum(counts - some, 0)) for (_, scores, own), counts, some in zip(held, _reached(unlabelled, models), seen)]
    prior = float(np.mean(priors)) if priors else 0.5
    start = Model(mean, spread, _train(z, positive, prior), prior)
    out = Model(mean, spread, _refined(unlabelled, start, z[positive]), prior)
    discard(unlabelled)
    return out


def score(table: DataFrame, model: Model | None) -> DataFrame:
    """(id, score) of every row of tabled() documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.ones(b.num_rows) if model is None else model(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["id", "score"])

    return table.select("id", "x").mapInArrow(tidied(run), f"id {table.schema['id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """Fits on trusted positives of `labels` and unlabelled rows of docs, and scores every row of docs: id, score.

    Whole texts are read; labels, lang, source and ids are no inputs of a score. A null or empty text has the features of
    no words and is scored like any other. Without positives or without unlabelled rows nothing can be learnt and every
    score is 1 (nothing is rejected). Repeated rows get equal scores; null ids stay null.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
    table = tabled(rows)
    return score(table, fit_tabled(table, known)).withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.7, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at least `least`; fitted like quality()."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    model = fit(rows, labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label")))
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, texts in text_steps(b.column(b.schema.get_field_index(text_column))):
                yield b.slice(low, high - low).filter(pa.array(model(features(texts)) >= least))

    return docs.mapInArrow(tidied(run), docs.schema)
