import json

from pyspark.sql import functions as F

from paperloom.operators import report, screening
from tests.helpers import papers


def lines(spark, *texts):
    return spark.createDataFrame([("f", i, n, t) for i, block in enumerate(texts) for n, t in enumerate(block, 1)], "file string, file_no int, line int, value string")


def test_pending_and_batches(spark):
    rows = papers(spark, {}, {"status": "core"}, {"excluded_reason": "x"}, {"status": "skim", "summary": "s"}, {"status": "exclude"})
    pick = lambda *a, **k: [r.seq for r in screening.pending(rows, *a, **k).orderBy("seq").collect()]
    assert pick("screen") == [0] and pick("screen", force=True) == [0, 1, 3, 4] and pick("enrich") == [1] and pick("enrich", force=True) == [1, 3]
    many = spark.range(0, 7000, 3).withColumnRenamed("id", "seq").repartition(6)
    got = {r.seq: (r.batch, r.line) for r in screening.batch_numbers(many, 25, 4).collect()}
    assert got == {seq: (4 + k // 25, k % 25) for k, seq in enumerate(range(0, 7000, 3))}
    assert screening.batch_numbers(spark.range(0).withColumnRenamed("id", "seq")).count() == 0


def test_compact(spark):
    row = papers(spark, {"doi": "10.1/a", "abstract": "w " * 3000, "venue": "", "status": "core"})
    got = json.loads(row.select(screening.compact("screen").alias("j")).first().j)
    assert set(got) == {"id", "title", "abstract"} and len(got["abstract"]) <= 2500 and got["abstract"].endswith("…")
    assert json.loads(row.select(screening.compact("enrich").alias("j")).first().j)["link"] == "https://doi.org/10.1/a"


def test_result_files_are_forgiven(spark):
    good, bad = screening.results(lines(spark, ["﻿[", '{"id": "a", "reason": ["x", 2], "relevance": "0.5", "summary": 7},', "not json", "", "]", "3"]))
    row = good.first()
    assert (good.count(), row.id, row.reason, row.relevance, row.summary) == (1, "a", "x; 2", "0.5", "7")
    assert [(r.file, r.line) for r in bad.collect()] == [("f", 3)]


def test_screening_upsert(spark):
    manual = {"manual": ["status"], "meta_checked": None, "rest": None}
    rows = papers(spark, {"doi": "10.1/a", "arxiv_id": "2401.00001", "short_summary": "old"}, {"s2_id": "s", "status": "core", "status_reason": "mine", "extra": manual}, {"s2_id": "t", "status": "core"})
    said = [
        ['{"id": "arxiv:2401.00001", "status": "Maybe", "reason": "r", "relevance": 3}', '{"id": "s2:s", "status": "exclude", "reason": "no"}', '{"id": "nobody", "status": "core"}'],
        ['{"id": "doi:10.1/a", "status": "rejected", "relevance": "x"}', '{"id": "s2:t", "status": "perhaps"}'],
    ]
    good, _ = screening.results(lines(spark, *said))
    out = {r.seq: r for r in screening.apply_results(rows, good, "screen").collect()}
    assert (out[0].status, out[0].status_reason, out[0].relevance, out[0].short_summary) == ("exclude", None, None, "old")
    assert (out[1].status, out[1].status_reason) == ("core", "mine") and out[2].status == "core"
    assert [r.id for r in screening.unknown_ids(rows, good).collect()] == ["nobody"]
    assert [(r.id, r.problem) for r in screening.problems(rows, good, "screen", []).collect()] == [("s2:t", "invalid status")]


def test_enrichment_is_field_by_field(spark):
    rows = papers(spark, {"s2_id": "s", "status": "core", "priority": "low", "code": "yes"})
    said = [['{"id": "s2:s", "summary": "one", "first_level": "A", "priority": "HIGH"}'], ['{"id": "s2:s", "summary": "two", "first_level": "", "priority": "urgent"}', '{"id": "s2:s", "first_level": "B"}']]
    good, _ = screening.results(lines(spark, *said))
    out = screening.apply_results(rows, good, "enrich").first()
    assert (out.summary, out.first_level, out.priority, out.code) == ("two", "A", "high", "yes")
    got = {(r.id, r.problem) for r in screening.problems(rows, good, "enrich", ["B"]).collect()}
    assert got == {("s2:s", "result has no summary"), ("s2:s", "invalid priority"), ("s2:s", "category is not in the taxonomy")}


def test_missing_and_new_files(spark):
    rows = papers(spark, {"s2_id": "s"}, {"s2_id": "t"}, {"s2_id": "u", "status": "core"})
    batches = spark.createDataFrame([("b1", "s2:s"), ("b1", "s2:t"), ("b1", "s2:u"), ("b1", "gone")], "batch string, id string")
    good, _ = screening.results(lines(spark, ['{"id": "s2:t", "status": "core"}']))
    assert [(r.batch, r.id) for r in screening.missing_results(rows, batches, good, "screen").collect()] == [("b1", "s2:s")]
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "name string, size long, modified long")
    done = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "name string, size long, modified long")
    assert [r.name for r in screening.new_files(files, done).collect()] == ["b"] and screening.new_files(files, done, replay=True).count() == 2


def test_counts(spark):
    raw = papers(spark, {"doi": "10.1/a", "found_via": ["seed:q1"]}, {"doi": "10.1/a", "found_via": ["seed:q2"]}, {"doi": "10.1/a", "found_via": ["search:arxiv:q1"]}, {"doi": "10.1/b"}, {"doi": "10.1/c", "found_via": ["odd"]})
    rows = papers(spark, {"doi": "10.1/a", "status": "core", "summary": "x", "year": 2001, "venue": "V", "first_level": "A", "second_level": "a"}, {"doi": "10.1/b", "status": "skim", "year": 2001, "venue": "W", "first_level": "A"}, {"excluded_reason": "language: de"}, {"excluded_reason": "language: fr"}, {"excluded_reason": "language: fr"}, {})
    s = report.stats(rows, raw)
    assert s["identified"] == {"seed": 1, "arxiv": 1, "manual": 1, "odd": 1} and s["identified_total"] == 4 and s["duplicates"] == 0
    assert (s["unique"], s["filtered_out"], s["screened"], s["awaiting_screening"], s["core"], s["skim"], s["enriched"]) == (6, 3, 2, 1, 1, 1, 1)
    assert list(s["filter_reasons"].items()) == [("language: fr", 2), ("language: de", 1)]
    flow = report.flow_rows(s)
    assert flow[:4] == [("Seed search", 1), ("Database search: arXiv", 1), ("Added manually", 1), ("odd", 1)] and flow[-3:] == [("Included", 2), ("    core", 1), ("    skim", 1)]
    levels = {(r.level, r.category, r.subcategory): (r.core, r.skim, r.total) for r in report.by_category(rows).collect()}
    assert levels == {(0, None, None): (1, 1, 2), (1, "A", None): (1, 1, 2), (2, "A", "a"): (1, 0, 1), (2, "A", ""): (0, 1, 1)}
    assert [(r.year, r.n) for r in report.by_year(rows).collect()] == [(2001, 2)] and [r.venue for r in report.top_venues(rows).collect()] == ["V", "W"]


def test_next_step():
    s = {"unique": 0, "identified": {}, "awaiting_screening": 0, "core": 0, "skim": 0, "enriched": 0}
    config = {"seed": {"queries": [], "papers": []}, "search": {"queries": ["a"]}, "taxonomy": []}
    assert report.next_step(s, config).startswith("Add seed queries")
    assert report.next_step(s | {"unique": 1}, config) == "Run: search"
    assert report.next_step(s | {"unique": 1, "identified": {"arxiv": 1}}, config) == "Run: snowball (then filter)"
    done = s | {"unique": 1, "identified": {"arxiv": 1, "forward": 1}}
    assert "await screening" in report.next_step(done | {"awaiting_screening": 2}, config)
    assert report.next_step(done | {"core": 1}, config).startswith("Define the taxonomy")
    assert report.next_step(done, config) == "Run: export"


def test_reports_are_one_aggregation(spark):
    plan = report.funnel(papers(spark, {}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and F.lit(1) is not None


def test_flow_of_tables_and_of_counts_agree(spark):
    raw = papers(spark, {"doi": "10.1/a", "found_via": ["seed:q1"]}, {"doi": "10.1/b"}, {"doi": "10.1/c", "found_via": ["odd"]}, {"doi": "10.1/d", "found_via": ["even"]})
    rows = papers(spark, *({"excluded_reason": f"reason {k}"} for k in range(10) for _ in range(k + 1)), {"status": "core"}, {"status": "skim"}, {})
    flow = report.flow(rows, raw).orderBy("row_no").collect()
    assert [(r.label, r.n) for r in flow] == report.flow_rows(report.stats(rows, raw)) and [r.row_no for r in flow] == list(range(1, len(flow) + 1))
    assert [r.label for r in flow][:4] == ["Seed search", "Added manually", "even", "odd"] and sum(r.label.startswith("    reason") for r in flow) == 8
    assert [(r.label, r.n) for r in report.flow(rows.limit(0), raw.limit(0)).orderBy("row_no").collect()] == [(label, 0) for label, *_ in report.TOTAL_LABELS]


def test_configuration_in_words():
    from paperloom.operators import layout
    from paperloom.sources import config

    assert layout.prose([{"id": "RQ1", "text": "Why?"}, {"text": "How?"}, "plain", 3]) == "RQ1 – Why?\nHow?\nplain\n3"
    f = config.merged(config.DEFAULTS, {"filters": {"year_min": 2001, "min_citations": 5, "require_abstract": True, "exclude_types": [], "require_any": ["a", "b"]}})["filters"]
    said = layout.filters_text(f).splitlines()
    assert [x.rpartition(": ")[2] for x in said] == ["2001", "en", "5", "2", "yes", "a, b"] and layout.filters_text({"citation_grace_years": 2}) == ""
    tab = layout.method_tab(config.merged(config.DEFAULTS, {"topic": "T", "snowball": {"max_citations": 0, "max_references": None}}), {"identified": {}, "filter_reasons": {}} | dict.fromkeys((n for _, _, names in report.TOTAL_LABELS for n in names), 0), "2026-01-01")
    told = {r[0]: r[1] for r in tab.rows}
    assert told["Topic"] == "T" and "Papers must" not in told and "Most references of a paper: no limit" in told["Citation steps"] and "Most citing papers of a paper: 0" in told["Citation steps"]
    assert all(len(r) == 2 for r in tab.rows)


def test_renderers_walk_the_tree():
    from paperloom.functions import boolean

    assert boolean.to_openalex('a, OR ("b, c*" d*) NOT NOT e') == 'a OR ("b  c" AND d) AND NOT NOT e'
    assert boolean.to_semantic_scholar("NOT a b OR NOT (c OR d*)") == "-a + b | -(c | d*)" and boolean.to_semantic_scholar("a NOT NOT b") == "a b"
    assert boolean.to_arxiv('NOT a b "c d" OR e*') == 'all:b AND all:"c d" ANDNOT all:a OR all:e'
    # What can't be parsed whole is read past; only evaluation refuses it.
    assert [f("(a OR b") for f in (boolean.to_openalex, boolean.to_plain)] == ["(a OR b)", "a b"] and boolean.to_openalex("AND a) OR") == "a"
    assert boolean.to_plain("a) b OR (c") == "a b c" and [f("") for f in (boolean.to_plain, boolean.to_openalex, boolean.to_arxiv, boolean.to_semantic_scholar)] == [""] * 4
    assert boolean.keywords("'What' is (the) \"state\" of -- NOT this, and that?!") == "state -- that"
