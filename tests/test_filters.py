import pytest

from paperloom.operators import filters
from tests.helpers import papers


def reasons(spark, f, *records):
    rows = filters.apply_filters(papers(spark, *records), f, 2026)
    return [r.excluded_reason for r in rows.orderBy("seq").collect()]


def test_years_languages_types(spark):
    assert reasons(spark, {"year_min": 2010, "year_max": 2020}, {"year": 2009}, {"year": 2021}, {"year": 2015}, {}, {"year": 0}) == ["published before 2010", "published after 2020", None, None, None]
    assert reasons(spark, {"languages": ["EN"]}, {"language": "De"}, {"language": "en"}, {}, {"language": ""}) == ["language: De", None, None, None]
    assert reasons(spark, {"exclude_types": ["letter"]}, {"type": "Newsletter"}, {"type": "article, Letter"}, {"type": "article"}, {}) == ["publication type: Newsletter", "publication type: article, Letter", None, None]


def test_citations_and_grace(spark):
    f = {"min_citations": 5, "citation_grace_years": 2}
    assert reasons(spark, f, {"citation_count": 4, "year": 2020}, {"citation_count": 4, "year": 2025}, {"year": 2020}, {"citation_count": 0}, {"citation_count": 5}) == ["fewer than 5 citations", None, None, "fewer than 5 citations", None]


def test_venues_abstracts_keywords(spark):
    assert reasons(spark, {"venue_exclude": ["Fake"]}, {"venue": "The fake Journal"}, {"venue": "Good"}, {}) == ["venue: The fake Journal", None, None]
    assert reasons(spark, {"require_abstract": True}, {"abstract": ""}, {}, {"abstract": "x"}) == ["no abstract", "no abstract", None]
    f = {"exclude_any": ["survey", "review*"], "require_any": ["citation network", "graph*"]}
    assert reasons(spark, f, {"abstract": "two surveys"}, {"abstract": "we reviewed surveys"}, {"title": "Trees"}, {"title": "Graphical"}) == ["mentions 'survey'", "mentions 'survey'", "none of the required keywords", None]


def test_hits_and_protection(spark):
    two = ["backward:doi:a", "forward:doi:b"]
    assert reasons(spark, {"min_hits": 2}, {"round": 1, "found_via": two[:1]}, {"round": 1, "found_via": two}, {"round": 0}) == ["linked from fewer than 2 papers", None, None]
    assert reasons(spark, {"year_min": 2030}, {"year": 2000, "found_via": ["seed:known"]}, {"year": 2000, "found_via": ["search:x:q1", "manual"]}, {"year": 2000, "found_via": ["seed:q1"]}) == [None, None, "published before 2030"]


def test_first_rule_names_the_reason(spark):
    f = {"year_min": 2010, "languages": ["en"], "require_abstract": True}
    assert reasons(spark, f, {"year": 2000, "language": "de"}, {"language": "de"}) == ["published before 2010", "language: de"]


def test_counts_and_repetition(spark):
    f = {"languages": ["en"], "year_min": 2010}
    rows = filters.apply_filters(papers(spark, {"language": "de"}, {"language": "fr"}, {"year": 2000}, {}), f, 2026)
    assert {r.reason: r.n for r in filters.reason_counts(rows).collect()} == {"language": 2, "published before 2010": 1}
    assert filters.apply_filters(rows, {}, 2026).where("excluded_reason is not null").count() == 0


def test_where(spark):
    rows = papers(spark, {"status": "core", "round": 1, "found_via": ["search:arxiv:q1"]}, {"status": "Exclude", "year": 2000}, {"status": "skim", "excluded_reason": "x"})
    pick = lambda *c: [r.seq for r in filters.where(rows, list(c)).orderBy("seq").collect()]
    assert pick("included=yes") == [0] and pick("excluded=true") == [2] and pick("found=arxiv") == [0] and pick("round=1") == [0]
    assert pick("status=exclude") == [1] and pick("year=none") == [0, 2] and pick("year=2000", "status=EXCLUDE") == [1]
    with pytest.raises(ValueError):
        pick("nothing=1")


def test_filters_reach_the_scan(spark, tmp_path):
    """A projection of two columns reads what the rules need and no more, in one stage."""
    papers(spark, {}, {}).write.parquet(f"{tmp_path}/p")
    rows = filters.apply_filters(spark.read.parquet(f"{tmp_path}/p"), {"year_min": 2000}, 2026).select("seq", "excluded_reason")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "abstract" not in plan and "ReadSchema: struct<seq:bigint,year:int,found_via:array<string>>" in plan
