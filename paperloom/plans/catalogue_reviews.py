"""A registered query that makes a whole review, command by command, and the SQL that says what its counts must be."""

from __future__ import annotations

import json
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from paperloom.operators.components import scratch
from paperloom.plans.catalogue_terms import term_sql
from paperloom.plans.registry import query
from paperloom.plans.review import Review
from paperloom.plans.schema import conform
from paperloom.plans.views import table

CONFIG = """topic: Reviews of notes
seed: {queries: [what is the thing], per_query: 20}
search: {queries: [idiot OR moron], per_query: 100, sources: [openalex, semantic_scholar]}
snowball: {direction: backward, max_references: 5}
filters: {year_min: 2005, languages: [en]}
screening: {batch_size: 25}
inclusion_criteria: [about notes]
taxonomy: [{name: odd}, {name: even}]
"""

_SQL = f"""WITH base AS (SELECT doc_id AS seq, coalesce(lang, 'en') AS lang, 2000 + doc_id % 26 AS year, n_chars % 200 AS c, 'Notes on ' || md5(CAST(doc_id AS VARCHAR)) || ' in graphs ' || coalesce(text, '') AS body FROM documents),
asked AS (SELECT * FROM base WHERE year >= 2005),
seeds AS (SELECT seq FROM (SELECT seq, seq % 2 AS source, min(seq % 2) OVER () AS best, row_number() OVER (PARTITION BY seq % 2 ORDER BY c DESC, seq) AS k FROM asked WHERE {term_sql("thing")}) WHERE source = best AND k <= 20),
found AS (SELECT seq, seq % 2 AS source FROM (SELECT *, CAST({term_sql("idiot")} AS INTEGER) + CAST({term_sql("moron")} AS INTEGER) AS score FROM asked) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY seq % 2 ORDER BY score DESC, c DESC, seq) <= 100),
papers AS (SELECT seq, lang FROM base WHERE seq IN (SELECT seq FROM seeds UNION SELECT seq FROM found)), start AS (SELECT seq FROM papers WHERE lang = 'en'), near AS (SELECT DISTINCT seq % 50 AS k FROM start),
judged AS (SELECT seq AS n FROM start UNION ALL SELECT k FROM near), v AS (SELECT count(*) AS todo, count(*) FILTER (n % 3 = 0) AS core, count(*) FILTER (n % 3 = 1) AS skim, count(*) FILTER (n % 3 = 2) AS out FROM judged),
t AS (SELECT (SELECT count(*) FROM papers) + (SELECT count(*) FROM near) AS uniq, (SELECT count(*) FROM seeds) + (SELECT count(*) FROM found) + (SELECT count(*) FROM near) AS found, (SELECT count(*) FROM papers WHERE lang <> 'en') AS filtered, v.* FROM v)
SELECT unnest(['identified', 'duplicates', 'unique', 'filtered out', 'screened', 'awaiting screening', 'excluded at screening', 'core', 'skim', 'enriched', 'batches', 'results applied', 'rounds', 'sheets', 'log entries']) AS what,
unnest([found, found - uniq, uniq, filtered, todo, 0, out, core, skim, core, (todo + 24) // 25, todo, 1, 8, 9]) AS n FROM t"""


@query("review_run", _SQL)
def review_run(spark, sf_dir):
    """Init, seed, search, filter, snowball, filter, batches, apply, enrichment of core papers, status and export, in a folder of the shared one."""
    # The driver alone reads and writes configuration, batches and results; tables are in the shared folder.
    home = tempfile.TemporaryDirectory(prefix="review-")
    review = Review.create(spark, "Reviews of notes", home.name, today="2026-01-02", tables=scratch(spark, "review"))
    (review.folder / "config.yaml").write_text(CONFIG, encoding="utf-8")
    review = Review.latest(spark, home.name)
    review.today = "2026-01-02"
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    fields = {
        "title": F.concat(F.lit("Notes on "), F.md5(number.cast("binary")), F.lit(" in graphs")), "abstract": F.coalesce("text", F.lit("")), "doi": F.concat(F.lit("10.5555/r"), number),
        "year": F.lit(2000) + F.col("doc_id") % 26, "citation_count": F.col("n_chars") % 200, "language": F.coalesce("lang", F.lit("en")),
    }
    records = conform(docs.select(F.col("doc_id").alias("seq"), *(c.alias(n) for n, c in fields.items())))
    sources = {"openalex": records.where("seq % 2 = 0"), "semantic_scholar": records.where("seq % 2 = 1")}
    edges = docs.select(F.concat(F.lit("doi:10.5555/r"), number).alias("parent_id"), F.concat(F.lit("k"), (F.col("doc_id") % 50).cast("string")).alias("child_id"), F.lit(0).alias("pos"))
    k = F.col("id").cast("string")
    near = spark.range(50).select(F.concat(F.lit("k"), k).alias("id"), F.concat(F.lit("Cited "), F.md5(k.cast("binary")), F.lit(" before")).alias("title"), F.concat(F.lit("K"), k).alias("openalex_id"), F.lit("en").alias("language"), F.lit(2010).alias("year"), F.col("id").alias("citation_count"))
    review.seed(sources)
    review.search(sources)
    review.filter()
    review.snowball(edges, near, force=True)
    review.filter()
    paths = review.batches("screen")
    for stage in ("screen", "enrich"):
        for batch in paths:
            _judge(Path(batch), stage)
        done = review.apply(stage)["applied"]
        if stage == "screen":
            applied, screened, paths = done, paths, review.batches("enrich")
    s = review.status()
    sheets = len(review.tabs())
    log = len((review.folder / "runlog.jsonl").read_text().splitlines())
    if not zipfile.is_zipfile(review.export()):
        raise ValueError("the workbook is none")
    rows = [
        ("identified", s["identified_total"]), ("duplicates", s["duplicates"]), ("unique", s["unique"]), ("filtered out", s["filtered_out"]), ("screened", s["screened"]), ("awaiting screening", s["awaiting_screening"]),
        ("excluded at screening", s["excluded_at_screening"]), ("core", s["core"]), ("skim", s["skim"]), ("enriched", s["enriched"]), ("batches", len(screened)), ("results applied", applied),
        ("rounds", review.papers().agg(F.max("round")).first()[0]), ("sheets", sheets), ("log entries", log),
    ]
    home.cleanup()
    return spark.createDataFrame(rows, "what string, n long")


def _judge(batch: Path, stage: str) -> None:
    """Writes the results of a judge who goes by the number in a paper's id, and enriches core papers alone."""
    papers = [json.loads(x) for x in batch.read_text(encoding="utf-8").splitlines()][1:]
    said = []
    for p in papers:
        n = int(p["id"].rpartition("r" if p["id"].startswith("doi:") else "K")[2])
        if stage == "screen":
            said.append({"id": p["id"], "status": ("Included", "maybe", "reject")[n % 3], "reason": f"number {n}", "relevance": 0.5})
        elif p["status"] == "core":
            said.append({"id": p["id"], "summary": f"about {n}", "first_level": "odd" if n % 2 else "even"})
    batch.with_name(batch.stem + ".result.jsonl").write_text("".join(json.dumps(x) + "\n" for x in said), encoding="utf-8")
