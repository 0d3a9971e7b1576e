"""What the literature services answer, as records: the connectors run on the driver, as their limits are for each client."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import boolean, paper
from paperloom.operators import lookup
from paperloom.plans.schema import PAPER, conform
from paperloom.sources import records, services

DECODERS = {"openalex": records.decode_openalex, "semantic_scholar": records.decode_semantic_scholar, "arxiv": records.decode_arxiv}


def decoded(spark: SparkSession, answers: list[tuple[str, str, str]]) -> DataFrame:
    """Records of (service, provenance, value) answers, in their order."""
    parts = []
    for service, decode in DECODERS.items():
        own = [(i, tag, value) for i, (s, tag, value) in enumerate(answers) if s == service]
        if own:
            rows = spark.createDataFrame(own, "seq long, query string, value string")
            parts.append(decode(rows).withColumn("found_via", F.array("query")).select(*conform(spark.createDataFrame([], PAPER)).columns))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], PAPER)


def searched(spark: SparkSession, connectors: dict, queries: dict[str, str], limit: int, **years) -> tuple[DataFrame, list[str], dict]:
    """Each query on each service: (records, errors, totals)."""
    totals: dict = {}
    rows, errors = services.search_all(connectors, queries, limit, totals, **years)
    return decoded(spark, [(s, f"search:{s}:{q}", value) for s, q, _, value in rows]), errors, totals


def seeded(spark: SparkSession, connectors: dict, queries: dict[str, str], limit: int, **years) -> tuple[DataFrame, list[str], dict]:
    """Natural-language queries, for each the first service with an answer: (records, errors, totals)."""
    totals: dict = {}
    rows, errors = services.seed_all(connectors, queries, limit, totals, **years)
    return decoded(spark, [(s, f"seed:{q}", value) for s, q, _, value in rows]), errors, totals


def neighbours(spark: SparkSession, connectors: dict, frontier: DataFrame, *, direction: str = "both", most_citing: int = 50, backend: str = "auto") -> tuple[DataFrame, DataFrame, dict]:
    """(edges, corpus, report) of a frontier, as graph.snowball_round() takes them; a frontier is bounded by graph.guard()."""
    asked = [r.asDict() for r in frontier.select("id", "openalex_id", "doi", "arxiv_id", "s2_id").collect()]
    rows, report = services.expand(asked, connectors["openalex"], connectors["semantic_scholar"], backward=direction != "forward", most_citing=most_citing if direction != "backward" else 0, backend=backend)
    found = decoded(spark, [(service, f"{way}:{parent}", value) for parent, way, service, _, value in rows]).withColumn("id", paper.paper_id())
    tag = F.get("found_via", F.lit(0))
    other, way = F.regexp_extract(tag, r"(?s)^[^:]*:(.*)$", 1), F.split_part(tag, F.lit(":"), F.lit(1))
    back = way == "backward"
    edges = found.select(F.when(back, other).otherwise(F.col("id")).alias("parent_id"), F.when(back, F.col("id")).otherwise(other).alias("child_id"), F.col("seq").alias("pos"))
    return edges, found.drop("found_via", "round", "seq", "extra").dropDuplicates(["id"]), report


def looked_up(spark: SparkSession, connectors: dict, items: list[str]) -> dict[str, DataFrame]:
    """Corpora that hold what the services know of references: DOIs and arXiv ids by DOI, ids of the second service, titles by match."""
    asked = lookup.wanted(spark.createDataFrame(list(enumerate(items)), "seq long, item string")).orderBy("seq").collect()
    keys, titles = [r["lookup"] for r in asked if r["kind"] != "title"], [r["item"] for r in asked if r["kind"] == "title"]
    first, second = connectors["openalex"], connectors["semantic_scholar"]
    ask = {
        "openalex": lambda: list(first.by_doi([r["doi_key"] for r in asked if r["doi_key"]])) + [w for t in titles for w in first.search(boolean.keywords(t), 5)],
        "semantic_scholar": lambda: [p for p in second.lookup(keys) if p] * bool(keys) + [p for t in titles if (p := second.match_title(t))],
        "arxiv": lambda: [e for t in titles for e in connectors["arxiv"].search(f'"{t}"', 5)],
    }
    out = {}
    for name, f in ask.items():
        try:
            found = f()
        except services.HttpError:
            found = []
        out[name] = decoded(spark, [(name, "lookup", services.text_of(x)) for x in found])
    return out


def metadata(spark: SparkSession, connectors: dict, papers: DataFrame) -> dict[str, DataFrame]:
    """Tables for Review.complete(): what both services know of the papers that miss an abstract or a citation count."""
    missing = papers.where(paper.missing_metadata()).select(paper.lookup_key().alias("key"), paper.lookup_doi().alias("doi"))
    keys = [r["key"] for r in missing.where("key is not null").distinct().collect()]
    dois = [r["doi"] for r in missing.where("doi is not null").distinct().collect()]
    ask = {"s2": ("semantic_scholar", lambda: [p for p in connectors["semantic_scholar"].lookup(keys) if p] if keys else []), "openalex": ("openalex", lambda: list(connectors["openalex"].by_doi(dois)))}
    out = {}
    for name, (service, f) in ask.items():
        try:
            out[name] = decoded(spark, [(service, "lookup", services.text_of(x)) for x in f()])
        except services.HttpError:
            continue
    return out
