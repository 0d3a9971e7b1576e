import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.plans.review import Review
from paperloom.plans.schema import conform
from tests.helpers import papers

LONG = "{} of citation networks and their forecasting"


def corpora(spark):
    make = lambda start, *rows: conform(papers(spark, *rows).withColumn("seq", F.col("seq") + start))
    one = make(0, {"title": LONG.format("A study"), "doi": "10.1234/a", "year": 2020, "language": "en", "citation_count": 5, "abstract": "graph networks"}, {"title": LONG.format("A survey"), "doi": "10.1234/b", "year": 2021, "language": "de", "abstract": "citation graphs"})
    two = make(10, {"title": LONG.format("A study"), "doi": "10.1234/a", "year": 2020, "citation_count": 9, "venue": "KDD"}, {"title": LONG.format("Other work"), "s2_id": "s" * 3, "year": 2019, "abstract": "graph trees"})
    return {"openalex": one, "semantic_scholar": two}


def test_a_review_from_start_to_end(spark, tmp_path):
    r = Review.create(spark, "Citation networks", str(tmp_path), today="2026-01-02")
    assert r.folder.name == "2026-01-02-citation-networks" and r.status()["next"].startswith("Add seed queries")
    with pytest.raises(FileExistsError):
        Review.create(spark, "Citation networks", str(tmp_path), today="2026-01-02")
    config = r.folder / "config.yaml"
    config.write_text("topic: Citation networks\nseed: {queries: [what is a study of citation networks]}\nsearch: {queries: ['citation OR graph*']}\nscreening: {batch_size: 2}\ntaxonomy: [A, B]\ninclusion_criteria: [about graphs]\n")
    r = Review.latest(spark, str(tmp_path))
    sources = corpora(spark)
    assert r.seed(sources) == 1 and r.search(sources) == 2
    assert r.papers().count() == 3 and r.papers().where("doi = '10.1234/a'").first().citation_count == 9
    edges = spark.createDataFrame([("doi:10.1234/a", "w1", 0), ("w2", "doi:10.1234/a", 0)], "parent_id string, child_id string, pos int")
    neighbours = papers(spark, {"title": LONG.format("Reference one"), "openalex_id": "W1", "year": 2018, "language": "en"}, {"title": LONG.format("Citing two"), "openalex_id": "W2", "year": 2022, "language": "en"}).drop("found_via", "round", "seq", "extra")
    neighbours = neighbours.withColumn("id", F.lower("openalex_id"))
    stats = r.snowball(edges, neighbours)
    assert (stats["references"], stats["citations"], stats["added"]) == (1, 1, 2)
    added, errors = r.add(["10.1234/none", LONG.format("Other work")], sources)
    assert added == 0 and len(errors) == 1
    assert r.filter(year_now=2026) == {"language": 1}
    paths = r.batches("screen")
    assert [Path(p).name for p in paths] == ["batch_001.jsonl", "batch_002.jsonl"]
    rows = [json.loads(x) for p in paths for x in Path(p).read_text().splitlines()]
    meta, items = [x["_meta"] for x in rows if "_meta" in x], [x for x in rows if "_meta" not in x]
    assert meta[0]["count"] == 2 and meta[0]["inclusion_criteria"] == ["about graphs"] and len(items) == 4
    Path(paths[0]).with_name("batch_001.result.jsonl").write_text("".join(json.dumps({"id": x["id"], "status": "include", "reason": "fits", "relevance": 0.9}) + "\n" for x in items[:2]) + "broken\n")
    out = r.apply("screen")
    assert (out["files"], out["applied"], out["bad_lines"], {k: len(v) for k, v in out["missing"].items()}) == (1, 2, ["batch_001.result.jsonl:3"], {"batch_002.jsonl": 2})
    assert r.apply("screen")["files"] == 0 and r.apply("screen", replay=True)["files"] == 1
    assert r.set(items[0]["id"], status="skim") == 1 and r.set("nobody", status="core") == 0
    with pytest.raises(ValueError):
        r.set(items[0]["id"], status="perhaps")
    with pytest.raises(ValueError):
        r.set(items[0]["id"], title="x")
    assert r.apply("screen", replay=True)["applied"] == 2
    shown = r.show(["status=skim"], ["id", "status", "reason"])
    assert shown == [(items[0]["id"], "skim", "set manually")]
    assert len(r.batches("enrich")) == 1
    Path(r.folder / "enrich" / "batch_001.result.jsonl").write_text(json.dumps({"id": items[1]["id"], "summary": "s", "first_level": "C", "priority": "high"}))
    assert r.apply("enrich")["problems"] == [f"{items[1]['id']}: category is not in the taxonomy"]
    s = r.status()
    assert (s["unique"], s["filtered_out"], s["core"], s["skim"], s["enriched"], s["awaiting_screening"]) == (5, 1, 1, 1, 1, 2)
    assert Path(r.export()).stat().st_size > 2000 and len(r.sheet_plan("sid")) >= 5
    log = [json.loads(x) for x in (r.folder / "runlog.jsonl").read_text().splitlines()]
    assert [e["stage"] for e in log][:4] == ["seed", "search", "snowball", "add"] and r.doctor()["papers"] == 5
    assert len(list((r.folder / "papers").glob("v*"))) == 2


def test_run_all(spark, tmp_path):
    r = Review.create(spark, "All", str(tmp_path), today="2026-01-02")
    (r.folder / "config.yaml").write_text("search: {queries: ['citation']}\nfilters: {languages: }\n")
    edges = spark.createDataFrame([("doi:10.1234/a", "w1", 0)], "parent_id string, child_id string, pos int")
    near = spark.createDataFrame([("w1", LONG.format("Reference one"), "W1")], "id string, title string, openalex_id string").withColumn("citation_count", F.lit(1).cast("long"))
    out = Review(spark, str(r.folder), today="2026-01-02").run_all(corpora(spark), edges, near)
    assert out["unique"] == 4 and out["identified"]["backward"] == 1 and "await screening" in out["next"]


def test_completion_and_empty_review(spark, tmp_path):
    r = Review.create(spark, "Empty", str(tmp_path), today="2026-01-02")
    assert r.papers().count() == 0 and r.filter(2026) == {} and r.batches("screen") == [] and r.apply("screen")["files"] == 0 and r.show() == []
    r.save(papers(spark, {"doi": "10.1234/a"}, {"arxiv_id": "2401.00001"}))
    r.complete({"openalex": papers(spark, {"doi": "10.48550/arxiv.2401.00001", "abstract": "found", "citation_count": 2})})
    assert r.papers().orderBy("seq").collect()[1].abstract == "found"


def test_titles_of_the_third_source_are_found(spark, tmp_path):
    r = Review.create(spark, "Third", str(tmp_path), today="2026-01-02")
    third = conform(papers(spark, {"title": LONG.format("Held by the third only"), "arxiv_id": "2401.00003"}, {"title": LONG.format("A study"), "arxiv_id": "2401.00004"}))
    added, errors = r.add([LONG.format("Held by the third only"), LONG.format("A study"), "Nowhere at all"], corpora(spark) | {"arxiv": third})
    assert added == 2 and errors == ["Nowhere at all: no confirmed match for this title"]
    assert r.papers().where("doi = '10.1234/a' and venue = 'KDD'").count() == 1


def test_tables_apart_and_concurrent_saves(spark, tmp_path):
    """Tables elsewhere by URI; of two who read one version the second can't save."""
    from paperloom.sources.commits import Conflict

    r = Review.create(spark, "Apart", str(tmp_path / "here"), today="2026-01-02", tables=f"file://{tmp_path}/there")
    (r.folder / "config.yaml").write_text("search: {queries: ['citation']}\n")
    r = Review.latest(spark, str(tmp_path / "here"))
    assert r.search(corpora(spark)) > 0 and r.raw().count() > 0
    assert not (r.folder / "papers").exists() and list((tmp_path / "there" / r.folder.name / "papers").glob("v*/_SUCCESS"))
    path = Path(r.batches("screen")[0])
    ids = [json.loads(x)["id"] for x in path.read_text().splitlines()[1:]]
    path.with_name("batch_001.result.jsonl").write_text("".join(json.dumps({"id": i, "status": "core"}) + "\n" for i in ids))
    assert r.apply("screen")["applied"] == len(ids) == r.status()["core"]
    one, two = Review(spark, str(r.folder)), Review(spark, str(r.folder))
    first, second = one.papers(), two.papers()
    one.save(first.limit(1))
    with pytest.raises(Conflict):
        two.save(second)
    assert two.papers().count() == 1 and two.save(two.papers()).count() == 1
