"""Connectors against scripted answers: odd keys, broken bodies, long waits, totals, pushed filters, choice of services."""

import http.client
import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import layout
from paperloom.sources import services
from paperloom.sources.http import Client, HttpError
from tests.helpers import papers
from tests.test_sources_sheets import FEED, Answers, client


def test_keys_are_quoted():
    doi = "10.1002/(SICI)1096<AID-S#8>3.0.CO;2-Q?x"
    c, _ = client({"id": "W1"}, {"data": []})
    services.OpenAlex(c, key="k").work(f"doi:{doi}")
    services.SemanticScholar(c, key="k").neighbours(f"DOI:{doi}", "citations")
    assert "/works/doi:10.1002/%28SICI%291096%3CAID-S%238%3E3.0.CO%3B2-Q%3Fx?select=" in c.transport.asked[0]
    assert "/paper/DOI:10.1002/%28SICI%291096%3CAID-S%238%3E3.0.CO%3B2-Q%3Fx/citations?" in c.transport.asked[1]


def test_bodies_that_break_off_are_asked_for_again():
    calls = []

    def transport(request, timeout):
        calls.append(1)
        if len(calls) == 1:
            raise http.client.IncompleteRead(b"half")
        return 200, {}, "whole"

    waits = []
    assert Client(transport=transport, sleep=waits.append, clock=lambda: 0.0).text("http://g.test/x") == "whole" and waits == [1.0]


def test_waits():
    c, waits = client((429, {"Retry-After": "86400"}, "quota"))
    with pytest.raises(HttpError) as e:
        c.text("http://h.test/x")
    assert e.value.persistent and waits == []
    c, waits = client((429, {}, "Please retry in 9 s."), "ok")
    assert c.text("http://i.test/x") == "ok" and waits == [10.0]
    c, waits = client((429, {}, "use an API key"), (429, {}, "use an API key"))
    with pytest.raises(HttpError) as e:
        c.text("http://j.test/x")
    assert e.value.persistent and len(waits) == 1


def test_a_full_disk_loses_no_answer(tmp_path):
    (tmp_path / "file").write_text("")
    c, _ = client("answer", cache=str(tmp_path / "file" / "cache"))
    assert c.text("http://k.test/x") == "answer"


def test_totals():
    c, _ = client({"results": [{"id": 1}], "meta": {"count": 812, "next_cursor": "n"}}, {"data": [{"title": "x"}], "total": 44}, FEED.format(total=7))
    own = {"openalex": services.OpenAlex(c, key="k"), "arxiv": services.Arxiv(c)}
    totals = {}
    rows, errors = services.search_all({"openalex": own["openalex"]}, {"q1": "a"}, 1, totals)
    services.search_all({"semantic_scholar": services.SemanticScholar(c, key="k")}, {"q1": "a"}, 1, totals)
    services.search_all({"arxiv": own["arxiv"]}, {"q1": "a"}, 1, totals)
    assert totals == {"openalex:q1": {"kept": 1, "total": 812}, "semantic_scholar:q1": {"kept": 1, "total": 44}, "arxiv:q1": {"kept": 1, "total": 7}} and len(rows) == 1 and not errors


def test_choice_of_services_and_what_they_answered_for():
    frontier = [{"id": "p", "openalex_id": "W1", "doi": None, "arxiv_id": None, "s2_id": "s"}]
    c, _ = client({"data": [{"citedPaper": {"title": "a"}}]}, {"data": []})
    rows, report = services.expand(frontier, None, services.SemanticScholar(c, key="k"), backend="semantic_scholar")
    assert [r[:3] for r in rows] == [("p", "backward", "semantic_scholar")] and report["backend"] == {"semantic_scholar": 1} and report["failed"] == []
    c, _ = client({"id": "x/W1", "referenced_works": ["x/W2"]}, {"results": [{"id": "x/W2"}]}, {"results": []})
    rows, report = services.expand(frontier, services.OpenAlex(c, key="k"), None, backend="openalex")
    assert len(rows) == 1 and report["backend"] == {"openalex": 1}


def test_filters_are_pushed_to_services(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "asked.txt")

    class Fake:
        total = None

        def search(self, query, limit, year_min=None, year_max=None):
            import json

            with open(log, "a") as f:
                f.write(json.dumps([query, limit, year_min, year_max]) + "\n")
            for k in range(4):
                self.total = 9
                yield {"title": f"{query} {k}", "year": 2000 + k}

    monkeypatch.setattr(services, "SERVICES", {"one": Fake, "two": Fake})
    spark.dataSource.register(services.LiteratureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("literature").options(services="one,two", queries=json.dumps({"q1": "graphs", "q2": "trees"}), limit="4").load()
    assert df.rdd.getNumPartitions() == 4 and df.count() == 16
    open(log, "w").close()
    some = df.where("service = 'two' and query in ('q2', 'q9') and year >= 2002 and year < 2010")
    assert [(r.service, r.query, r.seq, r.year, r.total, json.loads(r.value)["title"]) for r in some.orderBy("seq").collect()] == [("two", "q2", k, 2000 + k, 9, f"trees {k}") for k in (2, 3)]
    asked = [json.loads(x) for x in open(log)]
    assert asked and all(a == ["trees", 4, 2002, 2009] for a in asked)
    assert df.where("service = 'three'").count() == 0
    single = spark.read.format("literature").options(service="one", query="maps").load()
    assert single.where(F.col("year") == 2001).count() == 1


def test_sort_by_hits(spark):
    rows = papers(spark, {"found_via": ["a"]}, {"found_via": ["backward:doi:10.1/x", "backward:doi:10.1/y"]}, {"found_via": ["backward:doi:10.1/x"]})
    assert [r.seq for r in layout.sort_by(rows, "hits").collect()][0] == 1
