"""The operators on texts against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from paperloom.llm import bpe, near_dup, packing, pii, quality_rules, substring_dedup
from paperloom.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def awkward(seed: int = 1) -> list[tuple]:
    """Null, empty, blank and long texts, repeated rows, equal ids with other texts, null ids."""
    rng = random.Random(seed)
    alphabet = ["a", "é", " ", "  ", "\n", "\t", " ", "漢", "😀", "'s", "1", "<|endoftext|>", "!", "word ", "\x85", "the ", "Ab", "_"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    made += [None, "", " \n ", "x" * 50_000, "long words here " * 4_000, " " * 3_000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(made)]
    return rows + [rows[3], (5, "another text of id five", None, None, None), (None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1)]


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns whose names the operators use themselves
        from pyspark.sql import functions as F

        for name in ("id", "row", "bucket", "key", "node", "rest", "_text", "spans", "base", "n_words", "others", "score", "stratum"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def test_bpe_is_exact(spark, tokenizer):
    rows = awkward()
    got = sorted(map(str, bpe.encode_decode(frame(spark, rows, True), vocabulary_path()).collect()))
    want = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())))
    assert [tuple(r) for r in bpe.encode_decode(frame(spark, rows), vocabulary_path()).collect()].__len__() == len(want)
    assert got == sorted(f"Row(doc_id={i}, n_tokens={n}, ids_sha256='{a}', decoded_sha256='{d}')" for i, n, a, d in want)
    assert bpe.encode_decode(frame(spark, []), vocabulary_path()).count() == 0


def test_bpe_chunks_are_shared_and_repaired(tokenizer):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    body = " ".join(rng.choice(words) for _ in range(6_000))
    texts = [body, body, "start " + body, body[:9_000] + " changed " + body[9_000:], "".join(body.split())]
    encoder = bpe.ChunkEncoder(bpe.Vocabulary(vocabulary_path()))
    got = list(encoder.batch([t.encode() for t in texts]))
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.reused > encoder.encoded  # chunks of the copies were encoded once


def test_packing_round_trip(spark, tokenizer):
    rows = awkward(2)
    out = packing.pack(frame(spark, rows, True), vocabulary_path(), ids=True).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 for r in out)
    assert all(r.length == 2**r.bucket <= 1024 for r in out)
    assert all(r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) for r in out)
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        if i is None or i in (3, 5):
            continue
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in parts for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in parts)
        assert [r.start for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
    assert packing.pack(frame(spark, []), vocabulary_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), vocabulary_path(), most=1000)


def test_substring_dedup_brute_force(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            a = rng.randint(0, 30)
            at = rng.randint(0, len(words))
            words[at:at] = passage[a : a + rng.randint(15, 30)]
        if rng.random() < 0.15 and rows:
            words = WORD.findall(rows[rng.randrange(len(rows))][1] or "")
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), "en", "s", 1))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "z " * 30_000, "en", "s", 1), (203, " ".join(passage * 3), "en", "s", 1)]
    seen, want = set(), {}
    for i, t, *_ in sorted(rows):
        words = WORD.findall(t or "")
        gone = [0] * len(words)
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone[k : k + 20] = [1] * 20
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        want[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = substring_dedup.remove_repeats(frame(spark, rows, True)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(w[1] for w in want.values()) > 500
    cut = {r.doc_id: r for r in substring_dedup.cut_repeats(frame(spark, rows)).collect()}
    assert len(cut) == len(rows) and all(cut[i].text == t for i, t, *_ in rows if not want[i][1] and t is not None)
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_substring_dedup_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text, "en", "s", 1)] * 2 + [(7, "other", "en", "s", 1), (9, text, "en", "s", 1), (None, text + " tail", "en", "s", 1)]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    # The null id is the smallest: its words stay, all later copies go.
    assert got == Counter({(7, 30, 30): 2, (7, 1, 0): 1, (9, 30, 30): 1, (None, 31, 0): 1})


def brute_classes(rows):
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    bags, parent = list(map(bag, words)), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            either = sum(bags[i].values()) + sum(bags[j].values()) - both
            if words[i] == words[j] or (both and 5 * both >= 4 * either):
                parent[root(i)] = root(j)
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(root(i), []).append(r[0])
    return {i: min((d for d in ids if d is not None), default=None) for ids in members.values() for i in ids}


@pytest.mark.parametrize("small", [48, 2])
def test_near_duplicates_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(110)]
    texts = []
    for _ in range(90):  # a hot family, some of whose members are too far apart
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(0, 40))) for _ in range(20)]
    texts += [None, "", " ", "a b c", "a  b\nc", "a b c d", "again " * 3_000, "again " * 2_900]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, rows, True)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_edges(spark):
    rows = [(3, "one two three four five six", "en", "s", 1)] * 2 + [(None, "one two three four five six", "en", "s", 1), (None, "alone here", "en", "s", 1), (3, "a different text of this id", "en", "s", 1)]
    got = Counter((r.doc_id, r.class_id) for r in near_dup.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter({(3, 3): 3, (None, 3): 1, (None, None): 1})
    kept = near_dup.keep_one(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and Counter(r.text for r in kept.collect())["one two three four five six"] == 2
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_bag_min_hash_is_unbiased():
    import numpy as np

    rng = np.random.RandomState(4)
    shingles = rng.randint(0, 2**62, 300).astype(np.uint64)
    a, b = rng.randint(0, 9, 300), rng.randint(0, 9, 300)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    owner = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    h = near_dup.bag_min_hash(owner, np.concatenate([shingles[a > 0], shingles[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert abs((h[0] == h[1]).mean() - exact) < 4 * (exact * (1 - exact) / 4096) ** 0.5


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text: str) -> list[str]:
    def good(kind, x):
        d = re.sub("[^0-9]", "", x)
        luhn = sum(int(str(2 * int(c) - 9 if i % 2 and c > "4" else 2 * int(c) if i % 2 else c)) for i, c in enumerate(reversed(d))) % 10 == 0 if d else False
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in x.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m.group())]


def test_pii_base_spans(spark):
    rng = random.Random(4)
    bits = ["a", "b.", "@", ".", "1", "23", "-", " ", "+", "(", "255", "é", "😀", "x@y.z", "_", "%", "\n", "4532 0151 1283 0366", "1.2.3.4", "+1 (222) 333-4444", "a@b.c"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(600)] + awkward() + [(900, "9" * 20_000 + " " + "a" * 20_000 + "@", "en", "s", 1), (901, "a@b" + ".c" * 20_000, "en", "s", 1)]
    found = pii.annotate(frame(spark, rows).select("doc_id", "text"), pii.SpanModel({}, {"bias": -9.0})).select("text", pii.listed("base").alias("base")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.base == ",".join(brute_spans(r.text or ""))


def test_pii_method_adds_spans_and_redacts(spark):
    secrets = [f'note token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end' for i in range(40)]
    plain = [f"see commit {hashlib.sha1(str(-i).encode()).hexdigest()} there" for i in range(40)] + [None, "", "nothing at all", "ab" * 20_000 + "1" + "ab" * 20_000 + "-"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(secrets + plain)]
    found = {r.doc_id: r.spans for r in pii.find(frame(spark, rows, True)).collect()}
    assert all([s.kind for s in found[i]] == ["secret"] for i in range(40)) and not any(found[i] for i in range(40, len(rows)))
    clean = {r.doc_id: r for r in pii.redact(frame(spark, rows)).collect()}
    assert clean[0].text == 'note token = "[SECRET]" end' and clean[80].text is None and clean[82].text == "nothing at all"
    assert pii.find(frame(spark, [])).count() == 0


def brute_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_measures_brute_force(spark):
    rng = random.Random(6)
    rows = awkward() + [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "d|", "#", "e ", "\x0b", "\x85 "]) for _ in range(rng.randint(0, 120))), "en", "s", 1) for i in range(150)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(frame(spark, rows, True), labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter(
        (i, *(m := brute_rules(t)), m[0] < 10 or 100 * m[4] > 20 * m[0]) for i, t, *_ in rows
    )
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels to certify any rule
    assert quality_rules.judge(frame(spark, []), labels).count() == 0


def test_quality_thresholds_are_certified(spark):
    """Of enough labelled rows a rule that separates is used, and rejects good rows at no more than the promised rate."""
    good = [(i, " ".join(f"word{i}x{k}" for k in range(30)), "en", "s", 1) for i in range(1500)]
    bad = [(2000 + i, " ".join(f"word{i}x{k}***" for k in range(30)), "en", "s", 1) for i in range(200)]
    few = [(5000 + i, " ".join(f"mot{i}x{k}***" for k in range(30)), "fr", "s", 1) for i in range(20)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 2000 or r[0] >= 5000), 0) for r in good + bad + few], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, good + bad + few), labels).collect()}
    assert not any(got[r[0]].kept for r in bad)
    assert sum(not got[r[0]].kept for r in good) <= 0.02 * len(good)
    assert all(got[r[0]].kept for r in few)  # nothing can be certified for 20 rows


def test_binomial_tail(spark):
    from math import comb, log

    from pyspark.sql import functions as F

    cases = [(k, n, p) for n in (1, 7, 400) for k in (0, 1, 5) if k <= n for p in (0.005, 0.3)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.log_binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(log(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))), abs=1e-9)


def test_bpe_encodes_copies_of_short_texts_once(tokenizer):
    texts = [b"a short text", b"another one"] * 5 + [b"", b""]
    encoder = bpe.ChunkEncoder(bpe.Vocabulary(vocabulary_path()))
    got = [x.tolist() for x in encoder.batch(texts)]
    assert got == [tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert encoder.encoded == 3 and encoder.reused == 9


def test_bag_min_hash_splits_agree():
    """Registers of a bag are the least of those of its parts by weight: texts of other counts see the same points."""
    import numpy as np

    rng = np.random.RandomState(8)
    shingles = rng.randint(0, 2**62, 40).astype(np.uint64)
    counts = rng.randint(1, 70, 40)
    less = np.maximum(1, counts - rng.randint(0, 40, 40))
    run = lambda c: near_dup.bag_min_hash(np.zeros(len(c), int), shingles, c, 1, 512)[0]
    a, b = run(counts), run(less)
    assert (a <= b).all() and np.isfinite(b).all()  # more weight only adds points
    share = less.sum() / counts.sum()
    assert abs((a == b).mean() - share) < 4 * (share * (1 - share) / 512) ** 0.5
    one = near_dup.bag_min_hash(np.zeros(1, int), shingles[:1], np.array([1 << 20]), 1, 64)[0]
    assert abs(1 / one.mean() / (1 << 20) - 1) < 0.5  # the rate is the weight
    both = near_dup.bag_min_hash(np.repeat([0, 1], 40), np.tile(shingles, 2), np.concatenate([counts, less]), 2, 512)
    assert (both[0] == a).all() and (both[1] == b).all()


def test_near_duplicates_with_thousands_of_null_ids(spark):
    """Texts are found by their words, so null and much repeated ids cost no more than others."""
    import time

    near = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(None, near(k // 2) + (" tail" if k % 2 else ""), "en", "s", 1) for k in range(3000)] + [(7, near(5000 + k), "en", "s", 1) for k in range(1000)]
    start = time.time()
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert time.time() - start < 60 and Counter((r.doc_id, r.class_id) for r in got) == Counter({(None, None): 3000, (7, 7): 1000})
    kept = near_dup.keep_one(frame(spark, rows + rows[-3:] + rows[:2])).collect()
    assert Counter(r.doc_id for r in kept) == Counter({None: 3000, 7: 1000})


def test_word_hashes_hold_against_polynomial_collisions():
    """Thue-Morse words collide under any polynomial modulo 2^64, whatever its base."""
    from paperloom.llm.batches import Words

    bits = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = (bytes(97 + (x ^ flip) for x in bits) for flip in (0, 1))
    assert len(set(Words([a + b" " + b]).hashes().tolist())) == 2


def test_shared_folder_is_never_local_to_a_machine():
    from types import SimpleNamespace as Space

    from paperloom.llm.batches import shared_folder

    conf = lambda named, warehouse: Space(get=lambda k, d=None: {"spark.checkpoint.dir": named, "spark.sql.warehouse.dir": warehouse}.get(k, d))
    on = lambda master, named, warehouse: shared_folder(Space(conf=conf(named, warehouse), sparkContext=Space(master=master)))
    assert on("spark://x", "/shared", "file:/w") == "/shared" and on("local[4]", None, "file:/w/") == "file:/w/_shared" and on("spark://x", None, "hdfs://w") == "hdfs://w/_shared"
    with pytest.raises(RuntimeError):
        on("spark://x", None, "file:/w")


def test_substring_dedup_deals_null_and_hot_ids(spark):
    """Many texts without an id, and one row that makes up much of the table, are spread over groups; the result is that of brute force."""
    passage = " ".join(f"p{k}" for k in range(30))
    hot = " ".join(f"hot{k}" for k in range(25))
    rows = [(None, f"n{i} {passage if i % 50 == 0 else ''} tail{i}", "en", "s", 1) for i in range(2000)] + [(5, hot, "en", "s", 1)] * 3000 + [(None, hot, "en", "s", 1)] * 1500 + [(9, hot + " more", "en", "s", 1)]
    df = frame(spark, rows).repartition(5)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    # Rows without an id count as one document: equal starts keep their words. Those of larger ids go.
    assert got == Counter({(None, 2, 0): 1960, (None, 32, 0): 40, (5, 25, 25): 3000, (None, 25, 0): 1500, (9, 26, 25): 1})
    tags = substring_dedup._tags([b"", "é x".encode()])
    assert tags.tolist() == list(spark.createDataFrame([("", "é x")], "a string, b string").selectExpr("xxhash64(a)", "xxhash64(b)").first())
    deal = substring_dedup.Dealer(64, {5: 4})
    runs = __import__("numpy").zeros(3, substring_dedup.RUN)
    runs["row"] = [5, 6, 5]
    sent = [(bucket, len(substring_dedup._unpacked([blob], substring_dedup.RUN))) for b in deal(runs) for bucket, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    assert sum(n for _, n in sent) == 1 + 2 * 4 and len({b for b, _ in sent}) >= 4


def test_substring_dedup_ids_must_be_numbers(spark):
    with pytest.raises(TypeError):
        substring_dedup.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def private_cases(rng) -> list[tuple[str, str, str, bool]]:
    """(kind, text with {} for the span, span, private): spans of each kind with and without words that announce them, and look-alikes."""
    sha = lambda: hashlib.sha1(str(rng.random()).encode()).hexdigest()
    key = lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(rng.randint(22, 38))) + "7k"
    lower = lambda n: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(n))
    name = lambda: lower(rng.randint(4, 8)).capitalize()

    def iban(sound: bool) -> str:
        country, account = rng.choice(["DE", "GB", "FR"]), "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
        return f"{country}{(check if sound else (check + rng.randint(1, 90)) % 97):02d}{account}"

    ssn = lambda sound: f"{rng.randint(100, 665) if sound else rng.choice(['000', '666', '912'])}-{rng.randint(11, 98)}-{rng.randint(1000, 9999)}"
    given = lambda: rng.choice(pii.GIVEN_NAMES)
    made = {
        "secret": ([('note token = "{}" end', sha), ("the api_key: {} here", key), ("password {} was set", key), ("she typed {} twice", key)], [("see commit {} there", sha), ("the md5 {} of it", sha), ("a {} idea", lambda: "-".join(lower(rng.randint(4, 7)) for _ in range(4))), ("the {} road", lambda: lower(24))]),
        "national_id": ([("his SSN {} is known", lambda: ssn(True)), ("social security: {} of hers", lambda: ssn(True)), ("the number {} on file", lambda: ssn(True))], [("part {} is out of stock", lambda: ssn(False)), ("model {} sold well", lambda: ssn(False)), ("see figure {} below", lambda: ssn(rng.random() < 0.3))]),
        "iban": ([("IBAN {} please", lambda: iban(True)), ("my account: {} there", lambda: iban(True)), ("pay {} soon", lambda: iban(True))], [("isbn {} is listed", lambda: iban(False)), ("catalogue {} of things", lambda: iban(False)), ("the code {} is odd", lambda: iban(False))]),
        "spelled_email": ([("contact {} for more", lambda: f"{lower(6)} [at] {lower(5)} [dot] org"), ("e-mail: {} now", lambda: f"{lower(6)}[at]{lower(5)}[dot]com"), ("or {} instead", lambda: f"{lower(7)} (at) {lower(4)} (dot) net")], [("chapter {} of it", lambda: f"{lower(3)} [at] {lower(3)} [dot] {rng.randint(10, 99)}"), ("figure {} shows", lambda: f"{lower(3)} [at] {lower(3)} [dot] {rng.randint(100, 999)}")]),
        "person": ([("signed {}, with thanks", lambda: f"Dr. {given()} {name()}"), ("patient {} came", lambda: f"Mrs {given()} {name()}"), ("then {} spoke", lambda: f"Mr. {given()} {name()}")], [("film {} was long", lambda: f"Dr. {name()}"), ("brand {} cleans", lambda: f"Mr. {name()}"), ("the {} drink", lambda: f"Dr. {name()}")]),
    }
    return [(kind, text, make(), good) for kind, sides in made.items() for good, side in zip((True, False), sides) for text, make in side for _ in range(30)]


def test_pii_classifier_on_labelled_spans(spark):
    """Each kind's precision and recall, beside a majority vote of the labelers; spans and context weigh differently, by kind."""
    from pyspark.sql import functions as F

    cases = private_cases(random.Random(12))
    rows = [(i, text.format(span), "en", "s", 1) for i, (_, text, span, _) in enumerate(cases)]
    spotted = pii.cut(pii.spot(frame(spark, rows).select("doc_id", "text")))
    model = pii.fit(spotted)
    assert len(set(model.weights.values())) > 25 and {k for k, _ in model.reliability} == set(pii.CANDIDATES)
    assert all(r != 0.5 for (k, x), r in model.reliability.items() if x == "announced")
    c = F.col("c")
    majority = sum(pii.votes(c["kind"], c["value"], c["before"], c["after"]).values()) > 0
    seen = spotted.select("doc_id", F.explode("more").alias("c")).select("doc_id", c["kind"].alias("kind"), c["value"].alias("value"), (model.log_odds(c) > 0).alias("ours"), majority.alias("majority")).collect()
    right = {"ours": 0, "majority": 0}
    for kind in pii.CANDIDATES:
        own = [r for r in seen if r.kind == kind and cases[r.doc_id][0] == kind]
        assert {r.doc_id for r in own if r.value == cases[r.doc_id][2]} == {i for i, case in enumerate(cases) if case[0] == kind}
        for who in right:
            hit = sum(r[who] and cases[r.doc_id][3] for r in own)
            precision, recall = hit / max(1, sum(r[who] for r in own)), hit / sum(cases[r.doc_id][3] for r in own)
            right[who] += sum(r[who] == cases[r.doc_id][3] for r in own) / len(own)
            print(kind, who, round(precision, 3), round(recall, 3))
            assert who != "ours" or (precision >= 0.9 and recall >= 0.7), (kind, precision, recall)  # secrets that nothing announces are missed
    assert right["ours"] >= 0.95 * right["majority"]  # 4.875 beside 5.0 of 5: a vote takes unannounced secrets for private, the estimate leaves them open


def test_pii_positions_in_texts_with_many_matches(spark):
    """More matches than a block holds, of all kinds, by brute force."""
    text = " ".join(f"é{i}@b.cd 1.2.3.{i % 256} x" for i in range(700))
    found = pii.annotate(frame(spark, [(1, text, "en", "s", 1)]).select("text"), pii.SpanModel({}, {"bias": -9.0})).select(pii.listed("base").alias("base")).first().base
    assert found == ",".join(brute_spans(text)) and found.count(",") > 1300


def test_quality_rules_equal_sql_where_strata_are_certified(spark):
    """The registered SQL on a table with two strata in which unlike rules are certified, a third with too few labels, and a null stratum."""
    import duckdb
    import pandas as pd

    from paperloom.llm.queries import QUERIES, SQL

    rng = random.Random(7)
    words = lambda i, mark="": " ".join(f"w{i}x{k}{mark}" for k in range(24))
    lines = lambda i: "\n".join([f"a line of text number {i}", f"one more line about {i} here"] + ["twice the same line"] * 2 + [f"last words of {i}"])
    rows = [(i, words(i), "en") for i in range(1500)] + [(2000 + i, words(i, "***"), "en") for i in range(150)]
    rows += [(5000 + i, words(i), "de") for i in range(1500)] + [(7000 + i, lines(i), "de") for i in range(150)] + [(8000 + i, words(i, "##"), "de") for i in range(40)]
    rows += [(9000 + i, words(i, "***"), "fr") for i in range(30)] + [(9500 + i, words(i, "***"), None) for i in range(5)] + [(9900, None, "en"), (9901, "few words", "de"), (9902, "again and again and so on " * 6, "en")]
    bad = set(range(2000, 2150)) | set(range(7000, 7150))
    labels = [(i, int(i not in bad), 0) for i, *_ in rows if rng.random() < 0.95 and i < 9500]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], SCHEMA)
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        df = QUERIES["op2_quality_rules"](spark, folder)
        got = sorted(tuple(r) for r in df.collect())
    con = duckdb.connect(config={"memory_limit": "2GB", "threads": 2})
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    out = con.execute(SQL["op2_quality_rules"])
    place = [[d[0] for d in out.description].index(c) for c in df.columns]
    assert got == sorted(tuple(r[i] for i in place) for r in out.fetchall())
    verdicts = {r[0]: (r[-2], r[-1]) for r in got}
    assert all(verdicts[i] == (False, False) for i in bad) and sum(v == (False, False) for v in verdicts.values()) == len(bad)
    assert verdicts[9000] == verdicts[9500] == verdicts[8000] == (False, True) and verdicts[9901][0] and verdicts[9902][0]
