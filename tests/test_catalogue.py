"""Every registered query against its SQL on the smallest tables, and the shape of plans."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from paperloom.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect(config={"threads": 2, "memory_limit": "2GB"})
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def tidy(rows, columns, order):
    place = [columns.index(c) for c in order]
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in place)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in catalogue.SQL:
        got = duck.execute(catalogue.SQL[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == sorted(df.columns)
        assert tidy(rows, df.columns, df.columns) == tidy(got.fetchall(), columns, df.columns)


def test_url_references_of_later_pages(spark, tmp_path):
    """Page numbers of five and more digits, which the smallest tables don't have."""
    ids = [*range(12), *range(8994, 9012), *range(98_994, 99_012), *range(10**12, 10**12 + 6)]
    rows = [(i, None if i % 12 == 4 else f"https://site{i}.example.com/a?b=c", "") for i in ids]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    df = catalogue.QUERIES["url_references"](spark, str(tmp_path))
    got = c.execute(catalogue.SQL["url_references"])
    assert tidy(df.collect(), df.columns, ["page_id", "found"]) == tidy(got.fetchall(), [d[0] for d in got.description], ["page_id", "found"])


def test_no_cartesian_products(spark):
    for name, f in catalogue.QUERIES.items():
        assert "Cartesian" not in f(spark, SF)._jdf.queryExecution().executedPlan().toString(), name


def test_the_rest_works_without_the_optional_parts(tmp_path):
    """The package and its entry points without the llm folders and the corpus pipeline."""
    import shutil

    root = Path(__file__).parent.parent
    shutil.copytree(root / "paperloom", tmp_path / "paperloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
    assert not any("paperloom.llm" in p.read_text() for p in (root / "paperloom").rglob("*.py") if "llm" not in p.parts)


def test_match_titles_has_all_papers_as_candidates(spark):
    """Against brute force: the first near or equal title of the even half, else of the odd one."""
    import difflib

    from pyspark.sql import functions as F

    from paperloom.functions import text
    from paperloom.operators import identity
    from paperloom.plans.views import documents_as_papers

    name = text.norm_title(F.col("title"))
    rows = documents_as_papers(spark, SF).select("seq", name.alias("name"), identity.numbering(name).alias("numbers")).where("name <> ''").collect()
    rows.sort(key=lambda r: (r.seq % 2, r.seq))
    same = lambda a, b: a.name == b.name or (a.numbers == b.numbers and difflib.SequenceMatcher(None, a.name, b.name).ratio() >= 0.93)
    expected = {b.seq: next(a.seq for a in rows if same(a, b)) for b in rows}
    assert {r.request_seq: r.seq for r in catalogue.QUERIES["match_titles"](spark, SF).collect()} == expected
    assert any(s % 2 for s in expected.values())


def test_pages_are_unescaped_whole(spark, duck):
    import html

    expected = {k: html.unescape(v) for k, v in duck.execute("SELECT page_id, html FROM pages").fetchall()}
    raw = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    assert {r.page_id: r.plain for r in catalogue.QUERIES["unescape_pages"](spark, SF).collect()} == expected
    assert any(expected[k] != raw[k] for k in raw)


def test_papers_sheet_rows_hold_papers_and_cells(spark, duck):
    """Order as in grouped_layout and headings as in papers_sheet, both of which have SQL; cells against SQL."""
    run = lambda name: catalogue.QUERIES[name](spark, SF)
    rows = run("papers_sheet_rows").orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(1, len(rows) + 1))
    ids = {r.seq: r.id for r in run("paper_id").collect()}
    order = [r.seq for r in run("grouped_layout").orderBy("row_no").collect()]
    leaves = [r for r in rows if r.kind == "paper"]
    assert order and [r.c_id for r in leaves] == [ids[s] for s in order]
    sql = catalogue._with(catalogue.PAPERS_SQL, then="SELECT seq, title, CAST(year AS VARCHAR), CAST(citation_count AS VARCHAR), coalesce(venue, ''), status, coalesce(first_level, ''), coalesce(second_level, '') FROM papers")
    cells = {r[0]: r[1:] for r in duck.execute(sql).fetchall()}
    assert [(r.c_title, r.c_year, r.c_citations, r.c_venue, r.c_status, r.c_category, r.c_subcategory) for r in leaves] == [cells[s] for s in order]
    assert sorted((r.kind, r.heading) for r in rows if r.kind != "paper") == sorted((r.kind, r.heading) for r in run("papers_sheet").collect())
    group = subgroup = None
    for r in rows:
        if r.kind == "group":
            group, subgroup = r.heading, None
        elif r.kind == "subgroup":
            subgroup = r.heading
        else:
            assert group.startswith(f"▌ {r.c_category or 'Uncategorized'} — ") and (subgroup or "▸  (").startswith(f"▸ {r.c_subcategory} (")
