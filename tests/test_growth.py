"""What a query's work grows with: plans and partitions that stay in proportion to the input."""

from __future__ import annotations

import html
import random

import duckdb
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import graph, near, text_index
from paperloom.plans import catalogue
from paperloom.sources import sheets
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_snowball_reads_edges_once(spark):
    """Neighbours are joined and dealt out once, whether sources are tried in turn or there is one."""
    rows = [("p", "a", 0, 1), ("p", "b", 1, 0), ("p", "c", 2, 0), ("q", "a", 0, 1)]
    corpus = spark.createDataFrame([("a", 9), ("b", 1), ("c", 2)], "id string, citation_count long")
    starts = spark.createDataFrame([("p",), ("q",)], "id string")
    ranked = spark.createDataFrame(rows, "parent_id string, child_id string, pos int, source_rank int")
    for edges, want in ((ranked, {("p", "c"), ("q", "a")}), (ranked.drop("source_rank"), {("p", "a"), ("q", "a")})):
        found = graph.snowball_round(starts, edges, corpus, 1, direction="backward", max_references=1)
        assert plan(found).count("Join") == 2 and "source_rank" in found.columns
        assert {(r.start_id, r.id) for r in found.collect()} == want


def test_unescape_sends_references_alone(spark):
    texts = ["", "no &", "&amp;", "a &lt;b&gt; &amp;amp; &notit; &not; &copy 2 &#65;&#x41 &#0; &#x110000; &#xD800; &#128;", "&&amp;&", "&unknown; x &ampersand; &" + "y" * 40, None, "é &eacute;\n&nbsp;&NotEqualTilde;𝒳&Xscr;&\r;", "plain"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2).select("k", text.unescape(F.col("t")).alias("u"))
    assert {r.k: r.u for r in df.collect()} == {k: None if t is None else html.unescape(t) for k, t in enumerate(texts)}
    assert "_unescape(CASE WHEN Contains(t" in plan(df) and "THEN regexp_extract_all(t" in plan(df)


def test_island_ends(spark):
    """The runs of islands(), without an aggregate that holds them."""
    rng = random.Random(3)
    rows = [(rng.randint(0, 30), i, rng.choice(["a", "b", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, at int, v string")
    want = sheets.islands(df, "g", ["at"], "v").groupBy("g", "v", "island").agg(F.min("at").alias("low"), F.max("at").alias("high")).drop("island")
    got = sheets.island_ends(df, "g", ["at"], "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Aggregate" not in plan(catalogue.QUERIES["runs_islands"](spark, SF)) and "Aggregate" not in plan(got)


def test_fuzzy_candidates_count_bytes(spark, tmp_path):
    """Edits of letters that are several bytes count as the query's SQL counts them."""
    start = "gekeit die chlich ist als unguach zu enie"
    texts = [start + "aaaaaa", start + "ßßßßßß", start + "aaaaab", start + "ßßßßßä", None]
    rows = [(i, t, "de", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(catalogue.SQL["fuzzy_candidates"]).fetchall()
    assert want and sorted(map(tuple, catalogue.QUERIES["fuzzy_candidates"](spark, str(tmp_path)).collect())) == sorted(want)


def test_fuzzy_candidates_of_all_starts(spark, tmp_path, monkeypatch):
    """Titles that differ near their start count, too; large blocks are cut into cells; starts of texts are squeezed like whole ones."""
    monkeypatch.setattr(near, "CELL", 4)
    rng = random.Random(4)
    whole = "a study of citation networks and of their many uses in practice and theory"
    edited = lambda t, n: "".join("" if r < n / 200 else rng.choice("aé ") if r < n / 100 else c for c, r in ((c, rng.random()) for c in t))
    bases = [whole, whole[:40] + " ergänzung äöü größe straße", whole[:20] + "xvi 3 iv part two", "  " * 500 + whole + "\t" * 90 + "end", whole[:79] + " " * 700 + "z", whole + " 4"]
    texts = [edited(rng.choice(bases), rng.choice([0, 5, 12])) for _ in range(150)] + bases + [None, ""]
    spark.createDataFrame([(i, t, "de", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(catalogue.SQL["fuzzy_candidates"]).fetchall()
    got = sorted(map(tuple, catalogue.QUERIES["fuzzy_candidates"](spark, str(tmp_path)).collect()))
    assert got == sorted(want) and {a[:20] == b[:20] for a, b in want} == {True, False}


def test_postings_without_a_row_for_each_word(spark, tmp_path):
    texts = ["b a b", "", "x", "a a a"]
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "seq long, said array<string>")
    got = df.select("seq", F.inline(text_index.grouped_positions(F.col("said"))))
    assert sorted(map(tuple, got.collect())) == [(0, "a", [1]), (0, "b", [0, 2]), (2, "x", [0]), (3, "a", [0, 1, 2])]
    assert "Aggregate" not in plan(got)
