"""The near-title join: its choice of pieces, and what it finds against brute force."""

import difflib
import itertools
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import identity, near
from tests.helpers import papers


def test_pieces_are_disjoint_and_cost_least():
    rng = np.random.RandomState(1)
    for _ in range(150):
        q, m = rng.randint(1, 4), rng.randint(1, 4)
        starts = rng.randint((m - 1) * q + 1, (m - 1) * q + 6)
        costs = rng.randint(1, 9, (3, starts)).astype(float)
        for row, got in zip(costs, near.rarest(costs, q, m)):
            fine = [x for x in itertools.combinations(range(starts), m) if all(b - a >= q for a, b in zip(x, x[1:]))]
            assert tuple(got) in fine and row[got].sum() == min(row[list(x)].sum() for x in fine)


def test_titles_of_any_length_have_room_for_their_pieces():
    for n in range(1, 5_000):
        k, q = int(n * near.EDITS + 1e-6), near.GRAM if n >= near.SHORT else near.SHORT_GRAM
        assert k == 0 or q * (k + 1) <= n
        if n > near.CHOSEN and n % 97 == 0:
            got = near.rarest_of_parts(np.arange(n - q + 1, dtype=float)[::-1], q, k + 1)
            assert len(got) == k + 1 and (np.diff(got) >= q).all() and got[-1] <= n - q


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("common", [20_000, 10])
def test_candidates_lose_no_near_pair(spark, common, monkeypatch):
    """Long titles, many that share their words, edits all over; also where most grams count as common."""
    monkeypatch.setattr(near, "COMMON", common)
    rng = random.Random(common)
    words = ["of", "the", "study", "networks", "citation", "a", "in", "deep", "graph", "überblick", "漢字", "x1"]
    names = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 9, 14]))) for _ in range(60)] + ["the of " * 80 + "end", "word " * 90]
    for t in list(names):
        for _ in range(4):
            for _ in range(rng.randint(1, max(1, len(t) // 12))):
                at, kind = rng.randrange(len(t)), rng.randrange(3)
                t = t[:at] + ("" if kind == 0 else rng.choice("abe xé")) + t[at + (kind != 1) :]
                if not t:
                    break
            names.append(t)
    names = sorted({n for n in names if n})
    rng.shuffle(names)
    df = spark.createDataFrame([(i, n, i if i % 2 else None, n.count("x1")) for i, n in enumerate(names)], "id long, name string, limit long, key int").repartition(3)
    got = {(r.left_id, r.right_id) for r in near.candidates(df, df, ["key"]).collect()}
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i != j and (i % 2 == 0 or j < i) and a.count("x1") == b.count("x1") and int(len(a) * near.EDITS + 1e-6) and max(ratio(a, b), ratio(b, a)) >= near.SIMILAR}
    assert len(want) > 100 and want <= got
    kept = {(r.left_id, r.right_id) for r in near.near_pairs(df, df, ["key"]).collect()}
    assert want <= kept <= got and near.candidates(df.limit(0), df, ["key"]).count() == 0 and near.candidates(df, df.limit(0), ["key"]).count() == 0


def test_grams_and_pairs_are_not_broadcast(spark):
    """Small stored tables become large by their grams and pairs, which don't pass through the driver."""
    names = [(i, f"a study of citation networks for forecasting {chr(97 + i)}", i) for i in range(12)]
    df = spark.createDataFrame(names, "id long, name string, limit long").withColumn("key", F.lit(1))
    sides = near.Prepared(df, df, ["key"], both=True)
    pieces, leaders = near.met_by_pieces(sides), near.met_by_leaders(sides)
    rows = identity.keyed(papers(spark, *({"title": name, "year": 2000} for _, name, _ in names)))
    for got in (pieces, leaders, near.verified(pieces, df, df), identity.fuzzy_edges(rows)):
        assert got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pairs_grow_with_what_is_near(spark):
    """Titles that share most of their words, but are not near, hardly meet."""
    rng = random.Random(4)
    words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}" for _ in range(400)]
    names = [(i, " of the ".join(rng.choice(words) for _ in range(7)), i) for i in range(2_000)]
    df = spark.createDataFrame(names, "id long, name string, limit long").withColumn("key", F.lit(1))
    assert near.candidates(df, df, ["key"]).count() < 0.005 * 2_000 * 1_999 / 2


def test_only_pairs_with_enough_in_common_have_their_ratio_taken(spark):
    """Few edits are not enough, where they replace characters: each of those misses two."""
    base = "a study of citation networks and their uses for forecasting the work of a year"
    far, close = "".join("x" if i % 10 == 4 else c for i, c in enumerate(base)), base.replace("study", "studie")
    names = [(0, base), (1, far), (2, close)]
    df, met = spark.createDataFrame(names, "id long, name string"), spark.createDataFrame([(0, 1), (0, 2), (2, 0)], "left_id long, right_id long")
    assert met.join(df.toDF("left_id", "a"), "left_id").join(df.toDF("right_id", "b"), "right_id").where(near.few_missing(F.col("a"), F.col("b"))).count() == 3
    assert {(r.left_id, r.right_id) for r in near.verified(met, df, df).collect()} == {(0, 2), (2, 0)}
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def alike(a, b):
        asked.add(a is not None)
        return None if a is None else a > b

    assert [(r.left_id, r.right_id) for r in near.verified(met, df, df, alike).collect()] == [(2, 0)] and asked.value == 2


def test_characters_in_common_equal_brute_force():
    rng = random.Random(8)
    for _ in range(500):
        a, b, c = ("".join(rng.choice("abé漢 ") for _ in range(rng.randint(0, most))) for most in (30, 30, 90))
        a, b = (a + c, b + c) if rng.random() < 0.3 else (c + a, c + b) if rng.random() < 0.3 else (a, b)
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert near.in_common(a, b) == row[-1]


@pytest.mark.parametrize("block", [64, 2])
def test_large_blocks_give_the_same_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(identity, "LARGE_BLOCK", block)
    rng = random.Random(9)
    base = "proceedings of the annual meeting on networks and "
    rows = []
    for i in range(150):
        t = base + " ".join(rng.choice(["citation", "citations", "graph", "graphs", "text", "study"]) for _ in range(3))
        rows.append({"title": t, "year": rng.choice([None, 2000, 2001, 2005])})
    df = identity.keyed(papers(spark, *rows))
    got = {(r.name_a, r.year_a, r.name_b, r.year_b) for r in identity.fuzzy_pairs(df).collect()}
    held = {}
    for i, r in enumerate(rows):
        low, high = held.get((r["title"], r["year"]), (i, i))
        held[r["title"], r["year"]] = (min(low, i), max(high, i))
    fit = lambda x, y: x is None or y is None or abs(x - y) <= 1
    want = {(*a, *b) for a, (low, _) in held.items() for b, (_, high) in held.items() if a[0] != b[0] and low < high and fit(a[1], b[1]) and ratio(a[0], b[0]) >= near.SIMILAR}
    assert got == want and want


def test_blocks_meet_in_cells_each_pair_once(spark, monkeypatch):
    """No grams: a pair of a block costs one test, and no cell holds the block."""
    monkeypatch.setattr(near, "CELL", 8)
    df = spark.range(100).selectExpr("id", "id % 2 as k", "50L as held", "id div 2 as v")
    pairs = near.met_in_blocks(df, ["k"], F.col("a_v") != F.col("b_v") + 1)
    want = {frozenset((a, b)) for a in range(100) for b in range(a + 2, 100, 2)}
    got = [(r.left_id, r.right_id) for r in near.met_in_blocks(df, ["k"], F.lit(True)).collect()]
    assert len(got) == len(want) and {frozenset(p) for p in got} == want and pairs.where("left_id = right_id").isEmpty()
    monkeypatch.setattr(identity, "LARGE_BLOCK", 2)
    monkeypatch.setattr(near, "grams", lambda name: 1 / 0)
    t = "proceedings of the annual meeting on networks and graph"
    rows = identity.keyed(papers(spark, *({"title": t + x} for x in ("s", "", " w", "y z"))))
    assert {(r.name_a, r.name_b) for r in identity.fuzzy_pairs(rows).collect()} >= {(t + "s", t), (t, t + " w")}


def test_groups_leave_out_pairs_of_one_component(spark, monkeypatch):
    """The same components as by all links, but pairs of a large group of near titles are not gone through."""
    monkeypatch.setattr(identity, "LARGE_BLOCK", 8)
    rng = random.Random(5)
    base = "proceedings of the annual meeting on networks and their many uses in the practice of "
    letters = [base + f"{a}{b} end" for a in "bcdfghklm" for b in "aeiou"]
    apart = ["proceedings of the annual " + " ".join(rng.choice(["citation", "graph", "text", "study", "overview"]) for _ in range(4)) for _ in range(40)]
    rows = [{"title": t, "year": rng.choice([None, 1990, 2000, 2001, 2003, 2010])} for t in (letters + apart) * 2]
    keyed = identity.keyed(papers(spark, *rows))
    links = identity.fuzzy_edges(keyed).union(identity.key_edges(keyed))
    want = {frozenset((r.node, r.component)) for r in identity.connected_components(links).collect()}
    all_pairs, seen, near_ones = identity.fuzzy_pairs(keyed).select("name_a", "name_b").distinct().count(), [], identity._Titles.near

    def counted(self, met):
        seen.append((out := near_ones(self, met)).select("name_a", "name_b").distinct().count())
        return out

    monkeypatch.setattr(identity._Titles, "near", counted)
    got = {frozenset((r.node, r.component)) for r in identity.components(keyed).collect()}
    assert got == want and len(seen) == 2 and sum(seen) < all_pairs / 2


def test_runs_where_the_package_is_not_on_the_workers_path(tmp_path):
    """From another folder, with the package on the driver's path alone."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parent.parent)!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
import __spark_entry__
sys.path.pop(0)
q = __spark_entry__.queries()
for name in ("norm_title", "apply_screen", "dedup_groups", "match_titles", "unescape_pages"):
    assert q[name](spark, "/root/testdata/sf0.001").count(), name
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": __import__("os").environ["PATH"], "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", "")}, timeout=600)


def test_cells_leave_out_pairs_of_one_class(spark, monkeypatch):
    monkeypatch.setattr(identity, "LARGE_BLOCK", 2)
    t = "proceedings of the annual meeting on networks and graph"
    titles = identity._Titles(identity.keyed(papers(spark, *({"title": t + x} for x in ("", "s", " w")))))
    classes = titles.large.select("id", F.when(F.col("name") != t + " w", F.lit(1)).cast("long").alias("class"))
    assert {frozenset((r.name_x, r.name_y)) for r in titles.met_in_cells(classes).collect()} == {frozenset((t, t + " w")), frozenset((t + "s", t + " w"))}
