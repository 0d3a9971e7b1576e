import difflib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import graph, lookup
from paperloom.plans import catalogue
from tests.helpers import papers, values


def network(spark, edges, counts):
    e = spark.createDataFrame(edges, "parent_id string, child_id string, pos int" + (", source_rank int" if len(edges[0]) == 4 else ""))
    c = spark.createDataFrame(list(counts.items()), "id string, citation_count long")
    return e, c


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_most_cited_references(spark):
    e, c = network(spark, [("p", f"r{i}", i) for i in range(5)], {**{f"r{i}": i for i in range(4)}, "r4": None, "p": 9})
    got = graph.snowball_round(starts(spark, "p"), e, c, 1, direction="backward", max_references=2).orderBy(F.desc("citation_count")).collect()
    assert [(r.id, r.found_via, r["round"]) for r in got] == [("r3", ["backward:p"], 1), ("r2", ["backward:p"], 1)]
    assert graph.snowball_round(starts(spark, "p"), e, c, 1, direction="backward", max_references=0).count() == 5  # 0 is all


def test_all_citing_papers_beyond_the_safety_net(spark, monkeypatch):
    monkeypatch.setattr(graph, "ALL_CITATIONS", 3)
    e, c = network(spark, [(f"a{i}", "p", i) for i in range(5)], {**{f"a{i}": i for i in range(5)}, "p": 9})
    counts = [graph.snowball_round(starts(spark, "p"), e, c, 1, direction="forward", max_citations=most).count() for most in (None, math.inf)]
    assert counts == [3, 5]


def test_two_rounds_leave_no_neighbour_out(spark, tmp_path):
    """Five parts of one order and four orders of one part: more than one and two, which were kept once."""
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, '1-URGENT' AS o_orderpriority, 10.5 * i AS o_totalprice FROM range(1, 5) t(i)")
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'part' AS p_name, CAST(i AS INTEGER) AS p_size FROM range(1, 6) t(i)")
    con.execute("CREATE TABLE lineitem AS SELECT o.i AS l_orderkey, p.i AS l_partkey, CAST(p.i AS INTEGER) AS l_linenumber FROM range(1, 5) o(i), range(1, 6) p(i) WHERE o.i = 1 OR p.i = 5")
    for name in ("orders", "part", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES["snowball_two_rounds"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([(2, f"p{p}", "o1") for p in range(1, 6)] + [(2, "p5", f"o{o}") for o in (2, 3, 4)])
    assert sorted(got) == sorted(con.execute(catalogue.SQL["snowball_two_rounds"]).fetchall())


def test_both_directions_and_limits(spark):
    e, c = network(spark, [("p", "r", 0), ("a", "p", 0), ("b", "p", 1)], {"p": 1, "r": 1, "a": 5, "b": 7})
    both = graph.snowball_round(starts(spark, "p"), e, c, 3, max_citations=1).collect()
    assert {(r.id, r.found_via[0], r["round"]) for r in both} == {("r", "backward:p", 3), ("b", "forward:p", 3)}
    none = graph.snowball_round(starts(spark, "p"), e, c, 3, max_citations=0).collect()
    assert {r.id for r in none} == {"r"}
    with pytest.raises(ValueError):
        graph.snowball_round(starts(spark, "p"), e, c, 1, direction="forward", max_citations=0)
    with pytest.raises(ValueError):
        graph.snowball_round(starts(spark, "p"), e, c, 1, direction="sideways")


def test_fallback_per_parent(spark):
    edges = [("p", "r1", 0, 1), ("p", "r2", 1, 1), ("q", "r1", 0, 0), ("q", "r2", 1, 1)]
    e, c = network(spark, edges, {"p": 0, "q": 0, "r1": 1, "r2": 2})
    got = graph.snowball_round(starts(spark, "p", "q"), e, c, 1, direction="backward").collect()
    assert {(r.start_id, r.id) for r in got} == {("p", "r1"), ("p", "r2"), ("q", "r1")}


def test_stats_and_hits(spark):
    e, c = network(spark, [("p", "r", 0), ("q", "r", 0), ("q", "r", 1)], {"p": 0, "q": 0, "r": 1})
    found = graph.snowball_round(starts(spark, "p", "q", "alone"), e, c, 1)
    assert graph.round_stats(starts(spark, "p", "q", "alone"), found).first().asDict() == {"frontier": 3, "references": 3, "citations": 0, "unresolved": 1}
    assert {r.child_id: r.hits for r in graph.hit_counts(e).collect()} == {"r": 2}


def test_frontier(spark):
    rows = papers(spark, {}, {"status": "exclude"}, {"excluded_reason": "x"}, {"round": 1}, {"status": "core"})
    assert graph.next_round(rows) == 2
    assert [r.seq for r in graph.eligible(rows, 1).orderBy("seq").collect()] == [0, 4]
    assert [r.seq for r in graph.eligible(rows, 1, only_included=True).collect()] == [4]
    graph.guard(spark.range(300))
    graph.guard(spark.range(400), force=True)
    with pytest.raises(ValueError):
        graph.guard(spark.range(301))


def test_per_parent_limit_is_cut_before_the_shuffle(spark):
    e, c = network(spark, [("p", "r", 0)], {"r": 1})
    plan = graph.top_per_parent(e.join(c, F.col("child_id") == F.col("id")), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan


def references(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "seq long, item string")


def test_resolve(spark):
    first = papers(spark, {"title": "First one in the first source", "doi": "10.1234/a"}, {"title": "A preprint of some length here", "arxiv_id": "2401.01234"})
    second = papers(spark, {"title": "Known to the second only, this", "doi": "10.1234/b"}, {"title": "By its own id, another record", "s2_id": "a" * 40})
    items = ["https://doi.org/10.1234/A", "10.1234/a", "arXiv:2401.01234v2", "10.1234/b", "a" * 40, "10.1234/none", "first one in the FIRST source!", "No such title anywhere at all"]
    found, errors = lookup.resolve(references(spark, *items), first, second, "manual")
    assert sorted((r.request_seq, r.title[:8]) for r in found.collect()) == [(0, "First on"), (2, "A prepri"), (3, "Known to"), (4, "By its o"), (6, "First on")]
    assert all(r.found_via == ["manual"] for r in found.collect())
    assert {(r.seq, r.why.split(":")[0]) for r in errors.collect()} == {(5, "not found"), (7, "no confirmed match for this title")}


def test_title_match_prefers_sources_in_order(spark):
    long = "deep learning for citation forecasting in networks"
    c = papers(spark, {"title": long + " x9"}, {"title": long}, {"title": long.replace("deep", "deep ")}).withColumn("source_rank", F.when(F.col("seq") == 1, 1).otherwise(0))
    asked = spark.createDataFrame([(1, long.title()), (2, "!!")], "request_seq long, asked string")
    got = lookup.match_titles(asked, c).collect()
    assert [(r.request_seq, r.seq) for r in got] == [(1, 0)]  # near enough, and first


def test_near_titles_equal_brute_force(spark):
    """Edits anywhere, the first 20 characters too: what the fixed prefix block left out."""
    rng = random.Random(5)
    base = ["the study of citation networks for forecasting new work", "a survey of learning", "graphs", "deep models 3 in part ii of very long titles " * 4, "überblick über die netze der zitate und ihre vorhersage"]
    names = list(base)
    for t in base * 60:
        for _ in range(rng.randint(1, max(2, len(t) // 9))):
            at, kind = rng.randrange(len(t)), rng.randrange(3)
            t = t[:at] + ("" if kind == 0 else rng.choice("abe 3é")) + t[at + (kind != 1):]
        names.append(t)
    wanted = ["a study of citation networks for forecasting new work", *rng.sample(names, 120)]
    c = papers(spark, *({"title": t} for t in names)).withColumn("source_rank", (F.col("seq") % 3).cast("int"))
    asked = spark.createDataFrame(list(enumerate(wanted)), "request_seq long, asked string")
    normal = dict(zip(names + wanted, values(spark, "string", names + wanted, text.norm_title), strict=True))

    def same(a, b):
        numbers = [re.findall(r"\b(?:\d+|i{1,3}|iv|vi{0,3}|ix|x)\b", x) for x in (a, b)]
        return a == b or (numbers[0] == numbers[1] and difflib.SequenceMatcher(None, a, b).ratio() >= 0.93)

    order = sorted(range(len(names)), key=lambda i: (i % 3, i))
    firsts = {k: next((i for i in order if same(normal[names[i]], normal[w])), None) for k, w in enumerate(wanted) if normal[w]}
    got = {r.request_seq: r.seq for r in lookup.match_titles(asked, c).collect()}
    assert got == {k: i for k, i in firsts.items() if i is not None} and 0 in got
    assert any(normal[names[i]][:20] != normal[wanted[k]][:20] for k, i in got.items())


def test_completion(spark):
    rows = papers(spark, {"doi": "10.1/a"}, {"doi": "10.1/b", "abstract": "own", "citation_count": 3}, {"doi": "10.1/c", "abstract": ""}, {"abstract": None})
    meta = spark.createDataFrame([("10.1/a", "new", 7, 2001), ("10.1/b", "other", 9, 2002), (None, "x", 1, 1)], "doi string, abstract string, citation_count long, year int")
    once = lookup.complete(rows, meta, "doi", "s2").orderBy("seq")
    assert [(r.abstract, r.citation_count, r.year, r.extra.meta_checked if r.extra else None) for r in once.collect()] == [("new", 7, 2001, ["s2"]), ("own", 3, None, None), ("", None, None, ["s2"]), (None, None, None, None)]
    later = spark.createDataFrame([("10.1/c", "late", 1)], "doi string, abstract string, citation_count long")
    assert lookup.complete(once, later, "doi", "s2").where("seq = 2").first().abstract == ""  # checked before
    assert lookup.complete(once, later, "doi", "s2", force=True).where("seq = 2").first().abstract == "late"
    again = lookup.complete(once, later, "doi", "openalex").where("seq = 2").first()
    assert (again.abstract, again.extra.meta_checked) == ("late", ["openalex", "s2"])


def test_aligned(spark):
    asked = spark.createDataFrame([(0, "b"), (1, "none"), (2, "a")], "seq long, key string")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    assert [r.v for r in lookup.aligned(asked, table, "key").orderBy("seq").collect()] == [2, None, 1]
