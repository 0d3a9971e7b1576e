import json
import zipfile
from xml.etree import ElementTree

import pytest

from paperloom.operators import layout
from paperloom.sources import config, records, sheets
from paperloom.sources.http import Client, HttpError, NotFound
from paperloom.sources.services import Arxiv, Breaker, OpenAlex, SemanticScholar, expand, search_all, seed_all
from tests.helpers import papers

WORK = {
    "id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/A", "title": "A <i>work</i>", "publication_year": 2020, "cited_by_count": 7, "language": "en", "type": "article",
    "primary_location": {"source": {"display_name": "Journal"}, "landing_page_url": "http://x"}, "authorships": [{"author": {"display_name": "Ann"}}],
    "abstract_inverted_index": {"world": [1], "Hello": [0, 2]}, "locations": [{"landing_page_url": "http://y"}, {"pdf_url": "https://arxiv.org/pdf/2401.01234v2"}],
    "open_access": {"oa_url": "http://oa"}, "referenced_works": ["https://openalex.org/W2"],
}
S2 = {
    "paperId": "p", "title": "Two", "year": 2021, "citationCount": 3, "externalIds": {"DOI": "10.1/B", "ArXiv": "2401.00002"}, "venue": "v", "publicationVenue": None, "journal": {"name": "j"},
    "authors": [{"name": "Bob"}, {"name": None}], "abstract": None, "url": "u", "openAccessPdf": {"url": ""}, "publicationTypes": ["Review", "JournalArticle"],
}
FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/"><o:totalResults>{total}</o:totalResults>
<entry><id>http://arxiv.org/abs/2401.01234v2</id><published>2024-01-02T00:00:00Z</published><title>A
 title</title><summary> Text. </summary><author><name>Ann</name></author><author><name>Bob</name></author>
<arxiv:doi>10.1/C</arxiv:doi><link title="pdf" href="http://pdf"/></entry></feed>"""


def texts(spark, *items):
    return spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(items)], "seq long, value string")


def test_decoders(spark):
    w = records.decode_openalex(texts(spark, WORK, {"id": "W9"}, {"display_name": "Named", "locations": None})).orderBy("seq").collect()
    assert len(w) == 2 and (w[0].title, w[0].doi, w[0].arxiv_id, w[0].openalex_id, w[0].venue, w[0].pdf_url) == ("A work", "10.1/a", "2401.01234", "W1", "Journal", "http://oa")
    assert (w[0].abstract, w[0].authors, w[0].references, w[1].title) == ("Hello world Hello", ["Ann"], ["W2"], "Named")
    s = records.decode_semantic_scholar(texts(spark, S2, {"title": ""})).collect()
    assert len(s) == 1 and (s[0].venue, s[0].doi, s[0].arxiv_id, s[0].authors, s[0].pdf_url, s[0].type) == ("v", "10.1/b", "2401.00002", ["Bob"], None, "Review, JournalArticle")


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED.format(total=1))
    row = records.decode_arxiv(records.feed_entries(spark, str(tmp_path))).first()
    assert (row.title, row.year, row.venue, row.doi, row.arxiv_id, row.pdf_url, row.authors, row.abstract) == ("A title", 2024, "arXiv", "10.1/c", "2401.01234", "http://pdf", ["Ann", "Bob"], "Text.")
    error = "<entry><id>http://arxiv.org/api/errors#x</id><title>Error</title><summary>bad query</summary></entry>"
    with pytest.raises(Exception, match="bad query"):
        records.decode_arxiv(texts(spark, error)).collect()


def test_json_lines(spark, tmp_path):
    rows = ['﻿{"_meta": {"stage": "x"}}', '{"id": "ignored", "title": "One", "doi": "10.1/A", "year": "2020", "odd": {"k": 1}, "extra": {"manual": ["status"]}}', "", '{"title": "Two", "authors": ["A"], "round": 2, "relevance": 0.5}']
    (tmp_path / "p.jsonl").write_text("\n".join(rows), encoding="utf-8")
    got = records.read_papers(spark, f"{tmp_path}/p.jsonl").orderBy("seq").collect()
    assert [(r.title, r.doi, r.year, r["round"]) for r in got] == [("One", "10.1/a", 2020, 0), ("Two", None, None, 2)]
    assert got[0].extra.manual == ["status"] and json.loads(got[0].extra.rest["odd"]) == {"k": 1}
    assert records.read_meta(f"{tmp_path}/p.jsonl") == {"stage": "x"}
    back = records.read_papers(spark, f"{tmp_path}/p.jsonl")
    records.write_papers(back, f"{tmp_path}/out")
    again = records.read_papers(spark, f"{tmp_path}/out")
    assert sorted((r.title, r.authors, r.relevance) for r in again.collect()) == [("One", [], None), ("Two", ["A"], 0.5)]
    (tmp_path / "bad.jsonl").write_text('{"title": "One"}\n{broken\n')
    with pytest.raises(Exception):  # noqa: B017
        records.read_papers(spark, f"{tmp_path}/bad.jsonl").collect()


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("topic: t\nfilters:\n  languages: de\n  require_any:\n  year_min: 2001\nseed:\ntaxonomy:\n- name: A\n  children: [x, ' ']\n- B\n")
    c = config.load(f"{tmp_path}/c.yaml")
    assert c["filters"]["languages"] == ["de"] and c["filters"]["require_any"] == [] and c["seed"]["per_query"] == 20 and c["filters"]["year_min"] == 2001
    assert config.taxonomy(c) == {"A": ["x"], "B": []}
    (tmp_path / "new.yaml").write_text(config.render('a "topic"', "2026-01-01"))
    assert config.load(f"{tmp_path}/new.yaml")["topic"] == 'a "topic"'
    (tmp_path / "bad.yaml").write_text("- a\n")
    with pytest.raises(ValueError):
        config.load(f"{tmp_path}/bad.yaml")


class Answers:
    """A scripted service."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, request, timeout):
        self.asked.append(request.full_url)
        a = self.answers.pop(0)
        return a if isinstance(a, tuple) else (200, {}, a if isinstance(a, str) else json.dumps(a))


def client(*answers, **options):
    waits = []
    return Client(transport=Answers(*answers), sleep=waits.append, clock=lambda: 0.0, **options), waits


def test_http_retries_and_secrets(tmp_path):
    c, waits = client((429, {"Retry-After": "7"}, ""), (500, {}, ""), "ok")
    assert c.text("http://a.test/x") == "ok" and waits == [7.0, 2.0]
    c, _ = client((404, {}, ""))
    with pytest.raises(NotFound):
        c.text("http://b.test/x")
    c, _ = client((401, {}, "key=abc"))
    with pytest.raises(HttpError) as e:
        c.text("http://c.test/x", {"api_key": "secret"})
    assert e.value.persistent and "abc" not in str(e.value) and "secret" not in str(e.value)
    c, _ = client("once", cache=str(tmp_path))
    assert c.text("http://d.test/x") == c.text("http://d.test/x") == "once"
    c, _ = client("short", "whole", cache=str(tmp_path))
    assert c.text("http://e.test/x", keep=lambda t: t == "whole") == "short" and c.text("http://e.test/x") == "whole"
    c, waits = client("a", "b")
    c.text("http://f.test/1", interval=3)
    c.text("http://f.test/2", interval=3)
    assert waits == [3.0]


def test_services():
    c, _ = client({"results": [{"id": 1}, {"id": 2}], "meta": {"next_cursor": "n"}}, {"results": [{"id": 3}], "meta": {}})
    assert [w["id"] for w in OpenAlex(c, key="k").search("a OR b", 3, 2001)] == [1, 2, 3] and "from_publication_date%3A2001-01-01" in c.transport.asked[0]
    c, _ = client([{"title": "x"}, None])
    assert list(SemanticScholar(c, key="k").lookup(["DOI:1", "DOI:2", "DOI:3"])) == [{"title": "x"}, None, None]
    c, _ = client({"data": [{"citedPaper": {"title": "a"}}], "next": 1000}, {"data": [{"citedPaper": {"title": "b"}}]})
    assert [p["title"] for p in SemanticScholar(c, key="k").neighbours("p", "references", 2000)] == ["a", "b"]
    c, _ = client((404, {}, ""))
    assert SemanticScholar(c, key="k").neighbours("p", "citations") is None
    c, _ = client("garbage", FEED.format(total=1))
    assert len(list(Arxiv(c).search("graph", 5))) == 1


class Fake:
    """A service with fixed answers; an error in place of one is raised."""

    def __init__(self, **answers):
        self.answers = answers

    def __getattr__(self, name):
        def answer(*a, **k):
            got = self.answers.get(name, [])
            if isinstance(got, Exception):
                raise got
            return got

        if name == "search_relevance":
            raise AttributeError(name)
        return answer


def test_services_together():
    down, empty, up = Fake(search=HttpError(500, "x")), Fake(), Fake(search=[{"title": "a"}, "<entry/>"])
    rows, errors = search_all({"one": down, "two": up}, {"q1": "x", "q2": "y"})
    assert [r[:3] for r in rows] == [("two", "q1", 0), ("two", "q1", 1), ("two", "q2", 0), ("two", "q2", 1)] and len(errors) == 2
    rows, errors = seed_all({"one": down, "two": empty, "three": up, "four": up}, {"q1": "what is x"})
    assert {r[0] for r in rows} == {"three"} and len(errors) == 1


def test_expansion_over_services():
    work = {"id": "https://openalex.org/W1", "referenced_works": ["W2"]}
    first = Fake(resolve=work, by_id=[{"id": "W2"}], cited_by=[])
    second = Fake(neighbours=[{"title": "c"}])
    rows, report = expand([{"id": "p", "doi": "10.1/a"}], first, second)
    assert [r[:4] for r in rows] == [("p", "backward", "openalex", 0), ("p", "forward", "semantic_scholar", 0)] and report["errors"] == []
    rows, report = expand([{"id": str(i), "doi": "d"} for i in range(5)], Fake(resolve=HttpError(500, "x")), Fake(neighbours=None))
    assert rows == [] and len(report["errors"]) == 3 and report["failed"] == ["0", "1", "2"] and report["unresolved"] == ["3", "4"]


def test_breaker():
    b = Breaker()
    for _ in range(2):
        b.failed(HttpError(500, "x"))
    b.ok()
    b.failed(HttpError(500, "x"))
    assert b.open
    b.failed(HttpError(None, "daily quota is used up"))
    assert not b.open


def sample(spark):
    return papers(
        spark,
        {"title": "=Low", "status": "core", "first_level": "A", "second_level": "a2", "citation_count": 1, "priority": "low", "doi": "10.1/a", "found_via": ["seed:q1"], "year": 2001, "venue": "V"},
        {"title": "High", "status": "core", "first_level": "A", "second_level": "a1", "priority": "high", "found_via": ["search:arxiv:q1", "search:openalex:q1"]},
        {"title": "None", "status": "skim", "first_level": "A", "found_via": ["backward:doi:10.1/a", "forward:doi:x"], "round": 1},
        {"title": "Off", "status": "skim", "first_level": "Z"},
        {"title": "Loose", "status": "core"},
        {"title": "Out", "status": "exclude", "status_reason": "no\x01", "first_level": "A"},
        {"title": "Gone", "excluded_reason": "language: de"},
    )


CONFIG = config.merged(config.DEFAULTS, {"topic": "T", "taxonomy": [{"name": "B"}, {"name": "A", "children": ["a1", "a2"]}], "seed": {"queries": ["what is it"]}})


def test_sheet_rows(spark):
    rows = layout.papers_rows(sample(spark), CONFIG).orderBy("row_no").collect()
    assert [r.heading or r.c_title for r in rows] == ["▌ A — 3 papers", "None", "▸ a1 (1)", "High", "▸ a2 (1)", "=Low", "▌ Z — 1 paper", "Off", "▌ Uncategorized — 1 paper", "Loose"]
    flat = layout.papers_rows(papers(spark, {"title": "b", "status": "skim"}, {"title": "a", "status": "core"}), CONFIG).orderBy("row_no").collect()
    assert [r.c_title for r in flat] == ["a", "b"]
    with pytest.raises(ValueError):
        layout.select_columns(["title", "nothing"])


def build(spark):
    from paperloom.operators import report

    rows = sample(spark)
    s = report.stats(rows, rows)
    return layout.build(rows, CONFIG, s, "2026-01-01"), layout.phase_tabs(rows, CONFIG, s)


def test_workbook(spark, tmp_path):
    tabs, phases = build(spark)
    assert [t.name for t in tabs + phases] == ["Papers", "Overview", "Method", "1 Seed search", "2 Database search", "3 Snowballing", "4 Filtering", "5 Screening"]
    snow = phases[2]
    shown = snow.rows[snow.table_row + 1]
    assert shown[4:9] == ["reference of, cites", 2, 1, "=Low\ndoi:x", "included (skim)"]
    sheets.write_xlsx(tabs + phases, f"{tmp_path}/r.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/r.xlsx") as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    for xml in parts.values():
        ElementTree.fromstring(xml)
    papers_xml = parts["xl/worksheets/sheet1.xml"]
    assert "=Low</t>" in papers_xml and "<f>" not in papers_xml and "conditionalFormatting" in papers_xml and "outlineLevel='2'" in papers_xml
    assert "https://doi.org/10.1/a" in parts["xl/worksheets/_rels/sheet1.xml.rels"] and "\x01" not in "".join(parts.values())


def test_sheet_plan(spark, tmp_path):
    tabs, _ = build(spark)
    steps = sheets.sheet_plan(tabs, "sid", most=300)
    names = [s["name"] for s in steps]
    assert names[0] == "setup" and names[-1] == "rules" and sum(n.startswith("values_0") for n in names) > 1
    values = [r for s in steps if s["name"].startswith("values_0") for t in s["tools"] for r in t["arguments"]["data"][0]["values"]]
    assert len(values) == len(tabs[0].rows) and any(r[0] == "'=Low" for r in values)
    (tmp_path / "99_old.json").write_text("{}")
    paths = sheets.write_plan(steps, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(p.rpartition("/")[2] for p in paths)
    assert [sheets.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and sheets.runs([1, 1, 2]) == [(0, 2, 1), (2, 3, 2)]


def test_numbering_is_distributed(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 1000).withColumn("v", (F.col("id") * 7919) % 1000).repartition(7)
    assert [r.v for r in layout.numbered(df, [F.desc("v")]).orderBy("row_no").collect()] == list(range(999, -1, -1))
    assert layout.numbered(df.limit(0), [F.col("v")]).count() == 0
