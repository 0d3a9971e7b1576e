"""Citation-graph expansion: one round of backward and forward steps from a frontier."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import paper

ALL_CITATIONS = 2000
FRONTIER_LIMIT = 300


def top_per_parent(neighbours: DataFrame, most: int | None, parent: str = "parent_id") -> DataFrame:
    """The most cited neighbours of each parent, ties in their order (pos, then id); unknown counts are 0; None keeps all.

    The window's row_number filter lets Spark cut groups before the shuffle (WindowGroupLimit), so a parent with very many
    neighbours sends few of them.
    """
    if most is None:
        return neighbours
    order = Window.partitionBy(parent).orderBy(F.coalesce("citation_count", F.lit(0)).desc(), "pos", "id")
    return neighbours.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")


def first_source(found: DataFrame, *keys: str) -> DataFrame:
    """Of rows with source_rank those of the first source that answered at all for their keys.

    A window, so that what found is made of is not reckoned and dealt out a second time.
    """
    order = Window.partitionBy(*keys).orderBy("source_rank")
    return found.withColumn("_source", F.rank().over(order)).where(F.col("_source") == 1).drop("_source")


def next_round(papers: DataFrame) -> int:
    return papers.agg(F.coalesce(F.max("round"), F.lit(0))).first()[0] + 1


def eligible(papers: DataFrame, round_no: int, only_included: bool = False) -> DataFrame:
    """Papers that a round starts from: those of the round before that passed the filters and were not screened out.

    With only_included those that screening included.
    """
    out = papers.where((F.col("round") == round_no - 1) & F.col("excluded_reason").isNull())
    return out.where(paper.included()) if only_included else out.where(F.coalesce(F.col("status") != "exclude", F.lit(True)))


def beyond(frontier: DataFrame, most: int = FRONTIER_LIMIT) -> DataFrame:
    """One row: whether a frontier holds more than `most` papers (refused); only as many are counted."""
    return frontier.limit(most + 1).agg((F.count("*") > most).alias("refused"))


def guard(frontier: DataFrame, force: bool = False, most: int = FRONTIER_LIMIT) -> None:
    """Refuses frontiers of more than `most` papers."""
    if not force and beyond(frontier, most).first()["refused"]:
        raise ValueError(f"the frontier holds more than {most} papers; filter first, or use force")


def snowball_round(frontier: DataFrame, edges: DataFrame, corpus: DataFrame, round_no: int, *, direction: str = "both", max_references: int | None = 200, max_citations: float | None = 50) -> DataFrame:
    """The neighbours of a frontier as records with provenance and round; one join for each direction.

    frontier has id; edges has parent_id, child_id, pos and, if several sources are tried in turn, source_rank; corpus has id
    and the paper fields. Backward follows a paper's references, forward the papers that refer to it. Per direction the first
    source that gave any neighbour of a parent is used. max_references 0 or None is all; max_citations 0 is none, None means
    ALL_CITATIONS, math.inf all.
    """
    if direction not in ("backward", "forward", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    rank = ["source_rank"] if "source_rank" in edges.columns else []
    cited = ALL_CITATIONS if max_citations is None else max_citations if max_citations == math.inf else int(max_citations)
    starts = frontier.select(F.col("id").alias("start_id")).distinct()

    def step(own: str, other: str, word: str, most: int | None) -> DataFrame:
        near = edges.select(F.col(own).alias("start_id"), F.col(other).alias("id"), "pos", *rank).join(starts, "start_id").join(corpus, "id")
        near = first_source(near, "start_id") if rank else near  # a single source needs no choice
        near = top_per_parent(near, most, "start_id").withColumns({"direction": F.lit(word), "source_rank": F.col(*rank) if rank else F.lit(0)})
        return near.withColumn("found_via", F.array(F.concat(F.lit(f"{word}:"), F.col("start_id")))).withColumn("round", F.lit(round_no))

    parts = []
    if direction in ("backward", "both"):
        parts.append(step("parent_id", "child_id", "backward", int(max_references) if max_references else None))
    if direction in ("forward", "both") and cited > 0:
        parts.append(step("child_id", "parent_id", "forward", None if cited == math.inf else cited))
    if not parts:
        raise ValueError("nothing to follow: forward only, with no citations allowed")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def round_stats(frontier: DataFrame, found: DataFrame) -> DataFrame:
    """One row: size of the frontier, references, citations, and how many papers led nowhere."""
    counts = found.groupBy("start_id").agg(F.count_if(F.col("direction") == "backward").alias("refs"), F.count_if(F.col("direction") == "forward").alias("cites"))
    joined = frontier.select(F.col("id").alias("start_id")).distinct().join(counts, "start_id", "left")
    return joined.agg(F.count("*").alias("frontier"), F.coalesce(F.sum("refs"), F.lit(0)).alias("references"), F.coalesce(F.sum("cites"), F.lit(0)).alias("citations"), F.count_if(F.col("refs").isNull()).alias("unresolved"))


def hit_counts(edges: DataFrame) -> DataFrame:
    """(child_id, hits): how many distinct papers lead to each."""
    return edges.groupBy("child_id").agg(F.count_distinct("parent_id").alias("hits"))
