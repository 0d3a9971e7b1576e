"""Fitted operators on held-out labels, exact search, archives and the pipeline."""

import gzip
import io
import math
import random
from collections import Counter

import pytest

from paperloom.llm import quality_model, topk, toxicity, warc
from paperloom.llm.queries import QUERIES
from tests.llm.test_text_operators import SCHEMA, awkward, frame

SF = "/root/testdata/sf0.01"


def accuracy(spark, rows, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    return sum(p == y for p, y in held) / len(held)


def test_toxicity_held_out(spark):
    rows = QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows) and accuracy(spark, rows, "toxic") >= 0.93


def test_toxicity_locates_sentences(spark):
    rng = random.Random(1)
    calm = lambda: " ".join(rng.choice(["river", "stone", "house", "green", "table"]) for _ in range(6))
    rows = [(i, f"{calm()}. {'You horrid fool. ' if i % 4 == 0 else ''}é {calm()}.", "en", "s", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows + [(1000 + k, *r[1:]) for k, r in enumerate(awkward())], True), labels).collect()}
    for i, text, *_ in rows:
        if i % 4 == 0:
            start, end = map(int, got[i].offending.split(":"))
            assert got[i].score >= 0.5 and text[start:end] == "You horrid fool"
        elif i > 50:
            assert got[i].score < 0.5 and not got[i].offending


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, awkward()), labels).collect()
    assert len(got) == len(awkward()) and all(r.score < 0.5 for r in got)
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0


def test_quality_held_out(spark):
    rows = QUERIES["op8_quality"](spark, SF).collect()
    assert all(0 <= r.score <= 1 for r in rows) and accuracy(spark, rows, "quality") >= 0.93


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.quality(frame(spark, awkward(), True), labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score == 1 for r in quality_model.quality(frame(spark, awkward()), none).collect())
    assert quality_model.keep_good(frame(spark, awkward()), none).count() == len(awkward())
    assert quality_model.quality(frame(spark, []), labels).count() == 0


def test_prior_is_estimated_from_scores():
    import numpy as np

    rng = np.random.RandomState(2)
    scores = np.concatenate([rng.normal(1, 0.3, 4000), rng.normal(1, 0.3, 2800), rng.normal(-1, 0.3, 1200)])
    positive = np.arange(8000) < 4000
    assert quality_model.estimate_prior(scores, positive) == pytest.approx(0.7, abs=0.05)


def brute_top(vectors, k):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in usable:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q and len(y) == len(x))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "large"])
def test_top_k_brute_force(spark, kind):
    rng = random.Random(kind)
    width = 3 if kind == "ties" else 8
    made = {
        "spread": lambda: [rng.uniform(-1, 1) for _ in range(width)],
        "clusters": lambda: [c + rng.gauss(0, 0.01) for c in rng.choice([[0.9] * 8, [-0.9] * 8, [0.5, -0.5] * 4])],
        "ties": lambda: [float(rng.randint(-1, 1)) for _ in range(width)],
        "large": lambda: [rng.uniform(-1, 1) * 1e5 for _ in range(width)],
    }[kind]
    vectors = [(i, made()) for i in range(700)] + [(700, None), (710, [1.0, None] + [0.0] * (width - 2)), (720, [float("nan")] * width), (730, [float("inf")] * width), (740, [0.5, 0.5]), (741, [0.5]), (None, made()), (750, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), 10).collect()
    assert sorted(tuple(r) for r in got) == brute_top([v for v in vectors if v[1] != []], 10)


def test_query_blocks_are_not_broadcast(spark):
    """A few queries, repeated for each task, don't pass through the driver, however small they are before that."""
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), 2)
    assert len(got.collect()) == 6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_dual_tree_prunes():
    """Far clusters are left out without being compared."""
    import numpy as np

    rng = np.random.RandomState(1)
    centres = rng.normal(0, 1, (12, 6)) * 3000
    data = np.rint(np.concatenate([c + rng.normal(0, 5, (300, 6)) for c in centres]))
    queries = np.rint(centres[0] + rng.normal(0, 5, (80, 6)))
    seen, exact = [], topk.exact_products(queries, data)

    def counted(i, j):
        seen.append(len(i) * len(j))
        return exact(i, j)

    best = topk.Best(np.arange(80) + 10**6, 10)
    topk.dual_tree(topk.CoverTree(queries), topk.CoverTree(data), np.arange(len(data)), counted, best)
    full = queries @ data.T
    for i in range(80):
        assert best.found[i].tolist() == sorted(range(len(data)), key=lambda j: (-full[i, j], j))[:10]
    assert sum(seen) < 0.5 * full.size


PAGES = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 300_000), (6, "u", "one"), (6, "u", "one"), (7, "u\r\nX: y", "<p>é</p>"), (None, "u", "one"), (None, "u", "alone")]


def test_warc_round_trip(spark, tmp_path):
    import base64
    import hashlib

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.round_trip(pages, f"file://{tmp_path}/w").collect())
    want = Counter()
    for i, _, html in PAGES:
        body = (html or "").encode()
        last = max((j for j, _, h in PAGES if j is not None and (h or "") == (html or "")), default=None)
        revisit = i is not None and i < last
        want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", last if revisit else None)] += 1
    assert got == want
    least = warc.round_trip(pages, f"file://{tmp_path}/l", least=9).collect()
    assert {r.page_id for r in least if r.record_type == "revisit"} == {1, 2}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_members_and_damage():
    parts = [warc.record("response", 1, "0", "http://a", b"x" * 200_000, None), warc.record("revisit", 0, "1", None, b"x" * 200_000, 1)]
    whole = b"".join(parts)
    assert gzip.decompress(parts[0]).startswith(b"WARC/1.1\r\n")  # each record is a member of its own
    records = list(warc.read_records(io.BytesIO(whole)))
    assert [f["warc-type"] for f, _ in records] == ["response", "revisit"] and records[1][1].endswith(b"\r\n\r\n")
    assert list(warc.read_records(io.BytesIO(b""))) == []
    with pytest.raises(warc.CorruptArchive):
        list(warc.read_records(io.BytesIO(whole[:-5])))
    text = gzip.decompress(parts[0])
    for broken in (text.replace(b"xxx", b"xxy", 1), text.replace(b"Content-Length: 2000", b"Content-Length: 1000", 1), text[5:], text[:-4]):
        with pytest.raises(warc.CorruptArchive):
            list(warc.read_records(io.BytesIO(gzip.compress(broken))))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    passage = " ".join(f"shared{i}" for i in range(40))
    clean = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n)).capitalize() + "."
    rows = [(i, clean(60), "en", "s", 1) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s", 1) for i in range(5)]  # copies
    rows += [(300 + i, f"{clean(30)} {passage} {clean(30)}", "en", "s", 1) for i in range(4)]
    rows += [(400, f"{clean(40)} me@example.com", "en", "s", 1), (401, None, None, None, None)]
    rows += [(500 + i, "AGAIN!! " * 60, "en", "s", 1) for i in range(30)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert set(range(120)) <= ids["quality"] and not ids["quality"] & set(range(500, 530))
    assert ids["near_duplicates"] == ids["quality"] - set(range(200, 205))
    texts = {r.doc_id: r.text for r in kept["substring_dedup"].collect()}
    assert "shared20" in texts[300] and all("shared20" not in texts[300 + i] for i in (1, 2, 3))
    if 400 in ids["pii"]:
        assert "[EMAIL]" in {r.doc_id: r.text for r in kept["pii"].collect()}[400]
    assert ids["packing"] == ids["pii"]
    assert corpus_pipeline.run(spark, sf).count() == kept["packing"].count()


def test_stages_keep_other_columns(spark, tmp_path):
    """Clashing names, nulls, repeated rows and empty tables go through all stages that return documents."""
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (awkward(), []):
        for name, stage in corpus_pipeline.STAGES:
            docs = frame(spark, rows, True)
            out = stage(spark, docs, str(tmp_path))
            kept = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and all(r.spans == r.row == r.n_words == "clash" for r in kept)
            if name in ("pii", "substring_dedup"):
                assert len(kept) == len(rows)


def test_registered_queries():
    names = [f"op{n}_" for n in range(1, 11)]
    assert [sum(q.startswith(n) for q in QUERIES) for n in names] == [1] * 10


def test_prior_counts_all_unlabelled_rows(spark, monkeypatch):
    """Every unlabelled row beyond the sample is counted once by each model, labelled and null ids are not."""
    import numpy as np

    from paperloom.llm import quality_model

    monkeypatch.setattr(quality_model, "SAMPLE", 60)
    good, bad = "The committee has read the report and it was found to be of use to the town {}.", "zxq {} zxq !!! buy buy"
    rows = [(i, (good if i % 4 else bad).format(i)) for i in range(400)] + [(None, "no id here"), (399, good.format("again"))]
    docs = spark.createDataFrame(rows, "id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(400) if i % 4 and i < 120] + [(0, 0)], "id long, label int")
    seen, estimate = [], quality_model.estimate_prior
    monkeypatch.setattr(quality_model, "estimate_prior", lambda s, p, more=None: seen.append((int((~p).sum()), int(more.sum()))) or estimate(s, p, more))
    quality_model.fit(docs, labels)
    sampled = sum(n for n, _ in seen)
    assert len(seen) == 2 and all(sampled + m == 401 - 91 for _, m in seen)
    p, u = np.random.RandomState(1).rand(2, 500) ** [[0.5], [1.0]]
    counts = np.bincount(np.searchsorted(quality_model.cutoffs(p), u[100:], "right"), minlength=52)
    split = estimate(np.r_[p, u[:100]], np.r_[np.ones(500, bool), np.zeros(100, bool)], counts)
    assert abs(split - estimate(np.r_[p, u], np.r_[np.ones(500, bool), np.zeros(500, bool)])) < 1e-12


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_vectors_go_through_real_trees(sf):
    """Trees of more than one node on both sides, with net, covering and nesting as promised; the exact result with fewer products than pairs."""
    import numpy as np
    import pyarrow.parquet as pq

    table = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").to_pydict()
    ids, x = np.array(table["vec_id"]), np.floor(1024 * np.array(table["embedding"], np.float64))
    own, q = ids[ids % 100 == 0], x[ids % 100 == 0]
    trees = topk.CoverTree(q), topk.CoverTree(x)
    assert all(len(t.nodes) > 1 for t in trees)
    for t in trees:
        distance = lambda i, j, t=t: np.sqrt(((t.x[i] - t.x[j]) ** 2).sum(axis=-1))
        assert sorted(t.order) == list(range(len(t.x)))
        for node in t.nodes[:50]:
            points = t.order[node["low"] : node["high"]]
            assert node["centre"] in points and distance(points, node["centre"]).max() <= node["radius"]
            nets = t.nodes["centre"][node["first"] : node["last"]]
            if len(nets):
                assert node["centre"] in nets and sorted(p for n in t.nodes[node["first"] : node["last"]] for p in t.order[n["low"] : n["high"]]) == sorted(points)
                assert min(distance(nets[1:], nets[0]), default=np.inf) > node["radius"] / 2 * (1 - 1e-6)
    best = topk.Best(own, 10)
    bounds, products = topk.dual_tree(*trees, ids, topk.exact_products(q, x), best)
    assert bounds > len(q) and products <= len(q) * len(x) and (sf == "sf0.01" or products < 0.5 * len(q) * len(x))
    full = np.where(ids[None, :] == own[:, None], -np.inf, q @ x.T)
    for i in range(len(q)):
        assert best.found[i].tolist() == ids[np.lexsort((ids, -full[i]))[:10]].tolist()


def test_trees_travel_and_hold_repeated_points():
    import numpy as np

    x = np.repeat(np.arange(12.0).reshape(4, 3), 30, axis=0)
    t = topk.CoverTree(x)
    again = topk.CoverTree(x, t.packed())
    assert (again.order == t.order).all() and (again.nodes == t.nodes).all() and len(t.nodes) > 4
    best = topk.Best(np.arange(120), 3)
    topk.dual_tree(again, again, np.arange(120), topk.exact_products(x, x), best)
    assert best.found[0].tolist() == [90, 91, 92] and best.found[119].tolist() == [90, 91, 92] and best.found[90].tolist() == [91, 92, 93]
    lone = topk.CoverTree(x[:1])
    assert len(lone.nodes) == 1 and lone.nodes["radius"][0] == 0


def test_top_k_clashing_columns_and_huge_components(spark):
    from pyspark.sql import functions as F

    vectors = [(0, [1e300, 0.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [1e12, 2.0]), (4, [0.25, 1e-9]), (5, [0.5, 0.0]), (6, [1e12, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for name in ("id", "v", "width", "score", "rank", "x", "query_block", "task"):
        df = df.withColumn(name, F.lit("clash"))
    got = {}
    for r in topk.top_k(df, df.where("vec_id in (0, 4)"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    most = topk.LARGEST
    assert got[0] == [(1, most), (3, most), (4, most), (5, most), (6, most), (2, -most)]
    assert got[4] == [(0, most), (1, most), (3, 256 * 1024 * 10**12), (6, 256 * 1024 * 10**12), (5, 256 * 512), (2, -most)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def archives(folder):
    import pathlib

    return {p.name: list(warc.scan(p.open("rb"), keep=True)) for p in sorted(pathlib.Path(folder).glob("part-*.warc.gz"))}


def test_warc_references_resolve_and_archives_roll(spark, tmp_path):
    """Each revisit names a record that exists, holds the same payload, and is of the page that it refers to; archives end after `roll` bytes."""
    pages = spark.createDataFrame(PAGES + [(100 + i, None, f"<p>{i % 7}</p>" + "x" * 3000) for i in range(60)], "page_id long, url string, html string").repartition(3)
    out = warc.round_trip(pages, f"file://{tmp_path}/w", roll=2_000).collect()
    found = archives(tmp_path / "w")
    assert len(out) == pages.count() == sum(map(len, found.values())) and len(found) > 10
    records = [r for rows in found.values() for r in rows]
    ids = [f["warc-record-id"] for f, _, _ in records]
    assert len(set(ids)) == len(ids)
    by_id = {f["warc-record-id"]: f for f, _, _ in records}
    revisits = [f for f, _, _ in records if f["warc-type"] == "revisit"]
    assert len(revisits) > 50
    for f in revisits:
        target = by_id[f["warc-refers-to"]]
        assert target["warc-type"] == "response" and target["warc-payload-digest"] == f["warc-payload-digest"]
    assert {r.refers_to for r in out if r.record_type == "revisit"} == {7, *range(153, 160), 4}


def test_warc_leftovers_of_failed_attempts_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w")
    (tmp_path / "w" / "part-000000-999-00000.warc.gz").write_bytes(b"broken off")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == len(PAGES)
    name = next(n for n in (tmp_path / "w").glob("part-*.warc.gz") if "999-00000" not in n.name)
    name.write_bytes(warc.record("response", 1, "", None, b"one", None))
    with pytest.raises(Exception, match="records, not|CorruptArchive"):
        warc.read(spark, f"file://{tmp_path}/w").collect()


def test_warc_lengths_are_checked():
    response, revisit = (gzip.decompress(warc.record(kind, 1, "", None, b"ab", to)) for kind, to in (("response", None), ("revisit", 2)))
    for good in (response, revisit):
        assert [n for _, _, n in warc.scan(io.BytesIO(gzip.compress(good)))] == [2]
        with pytest.raises(warc.CorruptArchive, match="length"):
            list(warc.scan(io.BytesIO(gzip.compress(good.replace(b"X-Payload-Length: 2", b"X-Payload-Length: 9")))))
    for bad in (response.replace(b"\r\nContent-Length: 2\r\n", b"\r\nContent-Length: 3\r\n"), response + b"more", response.replace(b"Content-Length", b"Content-Width", 1), b"WARC/1.1 " + b"x" * 200_000):
        with pytest.raises(warc.CorruptArchive):
            list(warc.scan(io.BytesIO(gzip.compress(bad))))


def test_warc_records_are_read_bit_by_bit():
    """A record that unpacks to much more than a reader takes at once: neither archive nor record is held whole."""

    class Slow(io.BytesIO):
        def read(self, n=-1):
            assert 0 < n <= warc.READ_BYTES
            return super().read(n)

    import tracemalloc

    whole = warc.record("response", 1, "", None, b"a" * 80_000_000, None) * 2
    tracemalloc.start()
    assert [n for _, _, n in warc.scan(Slow(whole))] == [80_000_000] * 2
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_warc_hot_payloads_and_clashing_columns(spark, tmp_path):
    """Hot payloads (here: all that repeat) are dealt evenly, null ids among them; columns with names of the operator's own are left alone."""
    from pyspark.sql import functions as F

    rows = [(i if i % 3 else None, "u", "hot") for i in range(3000)] + [(5000 + i, None, f"cold {i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for name in ("id", "uri", "payload", "key", "last", "hot", "deal", "n", "refers_to"):
        df = df.withColumn(name, F.lit("clash"))
    got = Counter((r.page_id is None, r.record_type, r.refers_to) for r in warc.round_trip(df, f"file://{tmp_path}/w").collect())
    assert got == Counter({(True, "response", None): 1000, (False, "revisit", 2999): 1999, (False, "response", None): 21} | {(False, "revisit", 5001 + 2 * k): 1 for k in range(20)})
    sizes = [len(r) for r in archives(tmp_path / "w").values()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * len(rows)


def test_repeated_ids_bring_no_more_rows_to_the_driver(spark, monkeypatch):
    """One id on most rows: a sampled id sends one row, whatever the bound of the sample is."""
    from pyspark.sql import DataFrame

    rows = [(1 if i % 30 else i, f"sentence {i} of words. You fool {i}." if i % 30 == 0 and i % 60 else f"sentence {i} of words.") for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 60))) for i in range(0, 3000, 30)] + [(1, 0)], "id long, label int")
    seen, collect = [], DataFrame.collect
    kind = type(docs)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(len(got := collect(self))) or got)
    toxicity.fit(docs, labels)
    assert 0 < max(seen) <= 101 + 50
    seen.clear()
    monkeypatch.setattr(quality_model, "SAMPLE", 40)
    quality_model.fit(docs, labels.where("id % 120 = 90"))
    assert 0 < max(seen) <= 80


def test_noisy_or_gradient_by_plain_loops(spark):
    """The likelihood that fit() reaches is no worse than nearby ones, reckoned sentence by sentence; scores follow from the weights."""
    import numpy as np

    rng = random.Random(3)
    words = ["rotten", "vermin", "river", "stone", "house", "green", "bridge", "cloud"]
    rows = []
    for i in range(240):
        bad = i % 3 == 0
        said = [" ".join(rng.sample(words[2:], 4)) for _ in range(rng.randint(1, 3))] + ([" ".join(rng.sample(words[:2], rng.randint(1, 2)) + rng.sample(words[2:], 2))] if bad else [])
        rng.shuffle(said)
        rows.append((i, ". ".join(said) + ".", int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, label int"))
    weight = dict(zip(model.known.tolist(), model.weights.tolist()))

    def chances(text, weight, intercept):
        out = []
        for sentence in text.split(". "):
            s = toxicity.Sentences([sentence.strip(".").encode()])
            z = intercept + sum(weight.get(f, 0.0) for f in set(s.features()[1].tolist()))
            out.append(1 / (1 + math.exp(-z)))
        return out

    def loss(weight, intercept):
        total = 0.0
        for _, text, y in rows:
            clear = math.prod(1 - p for p in chances(text, weight, intercept))
            total -= math.log(max(1 - clear if y else clear, 1e-12))
        return total / len(rows)

    scored = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text, _ in rows[:40]:
        assert scored[i] == pytest.approx(1 - math.prod(1 - p for p in chances(text, weight, model.intercept)), abs=1e-9)
    held = {r: 1.0 / sum(toxic for _, text, toxic in rows if r in toxicity.Sentences([text.encode()]).features()[1].tolist()) for r in weight}
    aim = lambda w: loss(w, model.intercept) + 0.5 * toxicity.DECAY * sum(held[f] * v * v for f, v in w.items())
    here = aim(weight)
    assert here < aim(dict.fromkeys(weight, 1.0)) and all(here <= aim({**weight, f: weight[f] + step}) + 1e-3 for f in list(weight)[:6] for step in (-1.0, 1.0))
    assert np.isfinite(here)


def test_non_negative_risk_by_plain_loops():
    """The network that _train() returns has a lower non-negative risk, reckoned by loops, than one trained on the plain loss; its prior shows in the scores."""
    import numpy as np

    rng = np.random.RandomState(5)
    good, bad = rng.normal(1.0, 0.6, (300, 2)), rng.normal(-1.0, 0.6, (300, 2))
    x, positive = np.concatenate([good[:150], good[150:], bad]), np.arange(600) < 150
    prior = 150 / 450

    def risk(layers):
        model = quality_model.Model(np.zeros(2), np.ones(2), layers, prior)
        plus = minus_p = minus_u = 0.0
        for row, labelled in zip(x, positive):
            s = float(model(row[None])[0])
            if labelled:
                plus, minus_p = plus - math.log(max(s, 1e-12)) / 150, minus_p - math.log(max(1 - s, 1e-12)) / 150
            else:
                minus_u -= math.log(max(1 - s, 1e-12)) / 450
        return prior * plus + max(0.0, minus_u - prior * minus_p)

    pu, plain = quality_model._train(x, positive, prior), quality_model._train(x, positive, None)
    assert risk(pu) < risk(plain) and risk(pu) < 0.25
    scores = quality_model.Model(np.zeros(2), np.ones(2), pu, prior)(x)
    assert (scores[150:300] > 0.5).mean() > 0.9 and (scores[300:] < 0.5).mean() > 0.9
