"""Whitening against LAPACK, ranked search and rank-file BPE against plain versions and the library they stand for."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import byte_bpe, ranked, whitening
from paperloom.llm.queries import QUERIES, ranks_path
from tests.llm.test_text_operators import awkward, frame

SF = "/root/testdata/sf0.001"


def whole(vectors):
    return np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)


def check_white(got, vectors, components):
    """got: rows of whiten() by id; vectors: usable ones by id."""
    ids = sorted(vectors)
    x = whole([vectors[i] for i in ids])
    n, sums = len(ids), x.sum(axis=0)
    d = n * x - sums
    centred = (d / n).astype(float)
    v = centred.T @ centred / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1], c[:, ::-1]
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        r = got[i]
        assert r.n == n and r.deviation == sum(int(y) ** 2 for y in d[k]) and len(r.whitened) == components
        assert r.explained == pytest.approx((e[:components] / np.trace(v)).tolist(), rel=1e-9) and 0 <= r.identity_error <= 1e-9
    w = np.array([got[i].whitened for i in ids])
    for j in range(components):
        own = centred @ c[:, j] / math.sqrt(e[j])
        assert min(np.abs(w[:, j] - own).max(), np.abs(w[:, j] + own).max()) < 1e-6
    assert np.abs(w.T @ w / n - np.eye(components)).max() < 1e-9


@pytest.mark.parametrize("width", [3, 8, 13])
def test_whitening_brute_force(spark, width):
    rng = np.random.RandomState(width)
    scales = 10.0 ** -np.arange(width).clip(0, 2)
    made = {i: (rng.normal(size=width) * scales).tolist() for i in range(900)}
    rows = [*made.items(), (1000, None), (1001, [None] + [0.0] * (width - 1)), (1002, [float("nan")] * width), (1003, [float("-inf")] * width), (1004, [0.5] * (width + 1)), (1005, []), (1006, [1e30] * width)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "v", "n", "whitened", "r", "k")}).repartition(5)
    got = {r.vec_id: r for r in whitening.whiten(df).collect()}
    check_white(got, made, min(width, 8))


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    make = lambda rows: {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, schema)).collect()}
    assert make([]) == {} and make([(1, None), (2, [])]) == {}
    one = make([(1, [0.5, 0.5])])  # no variance, no component
    assert one[1].whitened == [] and one[1].deviation == 0 and one[1].identity_error == 0
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(6)]
    got = make(flat)  # all on a line: one component
    assert all(len(r.whitened) == 1 and r.explained == pytest.approx([1.0]) for r in got.values())
    check_white(got, dict(flat), 1)
    doubled = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (2, [1.0, 1.0])], schema)).collect()
    assert len(doubled) == 4 and sorted(r.n for r in doubled) == [4] * 4 and sum(r.vec_id is None for r in doubled) == 1
    wide = spark.createDataFrame([(i, [1.5e6 * (-1) ** i] * 40) for i in range(4)], schema)
    n, d = 4, 4 * 1024 * 1_500_000
    assert {r.deviation for r in whitening.whiten(wide).collect()} == {40 * d * d if 40 * d * d < 2**63 else None}


def test_whitening_deviation_beyond_a_long():
    d = np.array([[2**40, 1], [3, 4]], np.int64)
    assert whitening.squared_deviation(d) == [None, 25]


def test_whitening_query(spark):
    rows = QUERIES["op11_whitening"](spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)}
    assert len(rows) == 8 * len(vectors) and Counter(r.component for r in rows) == {k: len(vectors) for k in range(1, 9)}
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    merged = {i: type("R", (), {"n": c[1].n, "deviation": c[1].deviation, "identity_error": c[1].identity_error, "whitened": [c[k].whitened for k in range(1, 9)], "explained": [c[k].explained for k in range(1, 9)]}) for i, c in by_id.items()}
    check_white(merged, vectors, 8)


def test_jacobi_keeps_small_singular_values():
    rng = np.random.RandomState(4)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    a = q @ np.diag(10.0 ** -np.arange(30.0))  # columns of very unlike lengths
    s, v = whitening.jacobi_svd(a)
    assert s == pytest.approx(10.0 ** -np.arange(30.0), rel=1e-12) and np.abs(v.T @ v - np.eye(30)).max() < 1e-13
    for shape in ((1, 1), (2, 5), (5, 2), (9, 9)):
        a = rng.normal(size=shape)
        s, v = whitening.jacobi_svd(a)
        assert s[: min(shape)] == pytest.approx(np.linalg.svd(a)[1], rel=1e-12) and np.abs(v.T @ v - np.eye(shape[1])).max() < 1e-13
    assert whitening.jacobi_svd(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_rank(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score), sorted."""
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = set(split(text))
        scored = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got_rank(spark, docs, items, **more):
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in docs], True)
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("clash")).withColumn("terms", F.lit(1))
    return sorted((tuple(r) for r in ranked.rank(docs.repartition(3), items, **more).collect()), key=str)


@pytest.mark.parametrize("window, pairs", [(1 << 16, 500_000), (8, 40)])
def test_ranking_brute_force(spark, window, pairs, monkeypatch):
    """Also with many small windows and several passes."""
    monkeypatch.setattr(ranked, "WINDOW", window)
    monkeypatch.setattr(ranked, "COMMON", max(1, window // 16))
    rng = random.Random(window)
    words = ["the", "The", "of", "é", "É", "漢字", "a1", "x", "naïve", *(f"w{i}" for i in range(60))]
    say = lambda most: rng.choice([" ", "-", "_", "\n"]).join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, most)))
    docs = [(rng.choice([1, -1]) * i * rng.choice([1, 1, 5000]), say(80)) for i in range(300)]
    docs += [(5, "the of"), (5, "the of"), (None, "the of w1"), (10**12, "w1 w2 " * 30_000), (7, None), (8, ""), (9, "!!"), *((77, "w3 the") for _ in range(40))]
    items = [(i, say(30)) for i in range(25)] + [(100, None), (101, " ?"), (102, "the"), (103, "nowhere"), (104, "THE the tHe"), (None, "of w1")]
    assert got_rank(spark, docs, items, pairs=pairs) == brute_rank(docs, items)


def test_ranking_repeated_items_and_empty_tables(spark):
    docs = [(i, f"red {'blue ' * i}") for i in range(6)]
    items = [(1, "blue"), (1, "blue"), (1, "red")]
    assert got_rank(spark, docs, items) == brute_rank(docs, items)
    assert got_rank(spark, [], items) == [] and got_rank(spark, docs, []) == [] and got_rank(spark, [(1, "!")], items) == []


def test_a_hot_id_is_dealt_to_many_tasks(spark, monkeypatch):
    """Rows of one id in several tasks give the same ranks as one task would."""
    monkeypatch.setattr(ranked, "partitions", lambda *_: 7)
    monkeypatch.setattr(ranked, "WINDOW", 16)
    monkeypatch.setattr(ranked, "COMMON", 1)
    docs = [(3, f"red {'blue ' * (i % 9)}") for i in range(200)] + [(i, "red green") for i in range(100)]
    assert got_rank(spark, docs, [(1, "blue red"), (2, "green")]) == brute_rank(docs, [(1, "blue red"), (2, "green")])


@pytest.fixture(scope="session")
def reference_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(ranks_path()), special_tokens={})


def test_rank_file_bpe_is_exact(spark, reference_encoding):
    rows = awkward(3) + [(900, "\x1c \x1da  \x85 b　 c᠎ d", None, None, None), (901, "  a  \xa0 b \xa0  c \xa0 ", None, None, None)]
    got = byte_bpe.encode(frame(spark, rows, True), ranks_path(), tokens=True).collect()
    assert len(got) == len(rows)
    core, texts = byte_bpe.RankedTokenizer(ranks_path()).core, {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in got:
        fits = []
        for t in texts[r.doc_id]:
            ids = reference_encoding.encode_ordinary(t)
            fits.append(r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids)).encode()) and r.decoded_sha256 == sha(t.encode()))
        assert any(fits)
        t = texts[r.doc_id][fits.index(True)]
        assert list(zip(r.starts, r.ends)) == core.encode(t, add_special_tokens=False).offsets
    assert byte_bpe.encode(frame(spark, []), ranks_path()).count() == 0


def test_offsets_equal_the_library(reference_encoding):
    tokenizer = byte_bpe.RankedTokenizer(ranks_path())
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a", "é", " ", "漢", "😀", "ing", "\n", "1", "ß", " the", "　"]) for _ in range(rng.randint(1, 60)))
        ids = tokenizer.encode([t])[0]
        starts, ends = tokenizer.offsets(t.encode(), ids)
        own = tokenizer.core.encode(t, add_special_tokens=False)
        assert ids.tolist() == own.ids == reference_encoding.encode_ordinary(t)
        assert list(zip(starts.tolist(), ends.tolist())) == own.offsets


def test_merges_of_every_cut_follow_ranks(reference_encoding):
    """Words of tokens that can be made in several ways, side by side and overlapping."""
    ranks = byte_bpe.read_ranks(ranks_path())
    many = [t for t in ranks if sum(t[:i] in ranks and t[i:] in ranks for i in range(1, len(t))) > 1]
    rng, tokenizer = random.Random(6), byte_bpe.RankedTokenizer(ranks_path())
    words = []
    for _ in range(20_000):
        t, u = rng.choice(many), rng.choice(many)
        words.append(b"".join(rng.choice([t, u, t[1:], t[:-1], u[1:]]) for _ in range(rng.randint(1, 5))).decode("utf-8", "ignore"))
    assert [x.tolist() for x in tokenizer.encode(words)] == [reference_encoding.encode_ordinary(w) for w in words]


def test_store_is_bounded(monkeypatch, reference_encoding):
    monkeypatch.setattr(byte_bpe, "STORE_CHARS", 200)
    tokenizer, rng = byte_bpe.RankedTokenizer(ranks_path()), random.Random(1)
    for _ in range(50):
        texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 20))) for _ in range(4)]
        assert [x.tolist() for x in tokenizer.encode(texts)] == [reference_encoding.encode_ordinary(t) for t in texts]
        assert len(tokenizer.known) < 120


def test_decoding_of_whole_and_cut_sequences(spark, reference_encoding):
    rows = awkward(4)[:46] + [(500, "漢字😀é" * 50, None, None, None)]
    coded = byte_bpe.encode(frame(spark, rows), ranks_path(), tokens=True)
    assert {r.doc_id: r.text for r in byte_bpe.decode(coded, ranks_path()).collect()} == {i: t or "" for i, t, *_ in rows}
    parts = []
    for r in coded.collect():
        low, rng = 0, random.Random(r.doc_id)
        while low < len(r.ids) or low == 0:
            high = low + rng.randint(1, 3)
            parts.append((r.doc_id, low, r.ids[low:high]))
            low = high
    df = spark.createDataFrame(parts, "doc_id long, start long, ids array<int>")
    out = byte_bpe.decode_parts(df, ranks_path()).orderBy("doc_id", "start").collect()
    assert len(out) == len(parts)
    joined = {}
    for r in out:
        joined[r.doc_id] = joined.get(r.doc_id, "") + r.text
    assert joined == {i: t or "" for i, t, *_ in rows} and not any("�" in r.text for r in out)
    odd = spark.createDataFrame([(1, 0, None), (2, 0, []), (3, 0, [None, 10**9, -4]), (None, 0, reference_encoding.encode_ordinary("é")), (4, 0, [reference_encoding.encode_single_token(b"\xe6")])], "doc_id long, start long, ids array<long>")
    assert {r.doc_id: r.text for r in byte_bpe.decode(odd, ranks_path()).collect()} == {1: None, 2: "", 3: "", None: "é", 4: "�"}
    assert {r.doc_id: r.text for r in byte_bpe.decode_parts(odd, ranks_path()).collect()} == {1: "", 2: "", 3: "", None: "é", 4: "�"}


def test_whole_characters():
    for text in ("a", "é", "漢", "😀", "a漢"):
        raw = text.encode()
        for k in range(len(raw) + 1):
            head, rest = byte_bpe.whole_characters(raw[:k])
            assert head + rest == raw[:k] and head.decode() == raw[:k].decode("utf-8", "ignore")
    assert byte_bpe.whole_characters(b"\x80\x80\x80\x80") == (b"\x80\x80\x80\x80", b"")


def test_pieces_are_matches_of_the_pattern(reference_encoding):
    """Letters of many scripts, numbers, marks, signs, contractions and white space next to each other."""
    alphabet = ["a", "Z", "é", "²", "1", "'", "'s", "'re", "n't", "_", "-", ".", "!", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "漢", "😀", "́", "ǅ", "ª", "Ⅷ", "$", "~", "[", "\\", "^"]
    rng, tokenizer = random.Random(3), byte_bpe.RankedTokenizer(ranks_path())
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(8_000)]
    assert [x.tolist() for x in tokenizer.encode(texts)] == [reference_encoding.encode_ordinary(t) for t in texts]
    assert all("".join(tokenizer.pieces.findall(t)) == t for t in texts)
