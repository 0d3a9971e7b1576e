"""Batches for external judges, and their results brought back: each result file is applied once, manual edits are protected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import paper, text
from paperloom.plans.schema import PRIORITIES, STATUSES

#: What judges also say for a status.
SYNONYMS = {"include": "core", "included": "core", "maybe": "skim", "uncertain": "skim", "excluded": "exclude", "reject": "exclude", "rejected": "exclude"}
RESULT = "id string, status string, reason string, relevance string, short_summary string, summary string, rq_relation string, first_level string, second_level string, priority string, code string"
STAGES = ("screen", "enrich")


def _stage(stage: str) -> None:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; stages are {', '.join(STAGES)}")


def pending_test(stage: str) -> Column:
    _stage(stage)
    return F.col("status").isNull() if stage == "screen" else paper.included() & (F.coalesce("summary", F.lit("")) == "")


def pending(papers: DataFrame, stage: str, force: bool = False) -> DataFrame:
    """Papers that a stage has still to judge; with force those judged before as well."""
    _stage(stage)
    scope = F.col("excluded_reason").isNull() if stage == "screen" else paper.included()
    return papers.where(scope) if force else papers.where(scope & pending_test(stage))


def batch_numbers(papers: DataFrame, size: int = 25, start: int = 1, blocks: int = 2048) -> DataFrame:
    """papers with batch and line: consecutive batches of `size` in order of seq.

    Places come from counts of ranges of seq and a row_number within each range, so that no task sorts all papers.
    """
    bounds = papers.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    if bounds["low"] is None:
        return papers.withColumns({"batch": F.lit(None).cast("long"), "line": F.lit(None).cast("long")})
    width = max(1, -(-(bounds["high"] - bounds["low"] + 1) // blocks))
    ranged = papers.withColumn("_range", F.floor((F.col("seq") - bounds["low"]) / width))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # `blocks` rows at most
    before, total = {}, 0
    for k in sorted(counts):
        before[k], total = total, total + counts[k]
    offset = papers.sparkSession.createDataFrame(list(before.items()), "_range long, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("seq")) - 1 + F.col("_before")
    numbered = ranged.join(F.broadcast(offset), "_range").withColumn("_place", place)
    return numbered.withColumns({"batch": (F.lit(start) + F.floor(F.col("_place") / size)).cast("long"), "line": (F.col("_place") % size).cast("long")}).drop("_range", "_before", "_place")


def compact(stage: str) -> Column:
    """A paper as a judge sees it: one JSON object without blank fields."""
    _stage(stage)
    shown = {"id": paper.paper_id(), "title": F.col("title"), "year": F.col("year"), "venue": F.col("venue"), "citations": F.col("citation_count"), "abstract": F.when(F.col("abstract") != "", text.shorten(F.col("abstract"), 2500))}
    if stage == "enrich":
        shown |= {"status": F.col("status"), "reason": F.col("status_reason"), "short_summary": F.col("short_summary"), "link": paper.link(), "pdf": F.col("pdf_url")}
    return F.to_json(F.struct(*((text.blank_to_null(c) if k not in ("year", "citations") else c).alias(k) for k, c in shown.items())))


def results(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of result files; lines has file, file_no, line and value.

    Byte order marks, trailing commas and the brackets of a list are forgiven; values that are lists or numbers become text.
    """
    clean = F.rtrim(F.trim(F.regexp_replace("value", r"^\uFEFF", "")), F.lit(","))
    rows = lines.withColumn("value", F.trim(clean)).where(~F.col("value").isin("", "[", "]"))
    raw = rows.withColumn("_row", F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant("_row").startswith("OBJECT"), F.lit(False))
    fields = [f.strip().split(" ")[0] for f in RESULT.split(",")]

    def value(name: str) -> Column:
        one = F.try_variant_get("_row", f"$.{name}", "string")
        many = F.array_join(F.try_variant_get("_row", f"$.{name}", "array<string>"), "; ", "null")
        return F.trim(F.coalesce(many, one)).alias(name)

    good = raw.where(is_object).select("file", "file_no", "line", *(value(n) for n in fields))
    bad = raw.where(F.col("_row").isNull()).select("file", "line")
    return good, bad


def aliases(papers: DataFrame) -> DataFrame:
    """(key, seq): each id that names a paper; a paper's present id goes before identifiers that others also hold."""
    own = papers.select(paper.paper_id().alias("key"), "seq", F.lit(0).alias("rank"))
    former = papers.select(F.explode(paper.identifier_keys()).alias("key"), "seq", F.lit(1).alias("rank"))
    return own.union(former).groupBy("key").agg(F.min(F.struct("rank", "seq"))["seq"].alias("seq"))


def usable(stage: str) -> Column:
    """Whether a result row can be applied."""
    _stage(stage)
    return status_of().isNotNull() if stage == "screen" else F.coalesce("summary", F.lit("")) != ""


def status_of() -> Column:
    said = F.lower(F.trim("status"))
    for word, status in SYNONYMS.items():
        said = F.when(said == word, status).otherwise(said)
    return F.when(said.isin(*STATUSES), said)


def apply_results(papers: DataFrame, rows: DataFrame, stage: str) -> DataFrame:
    """papers with the results of a stage: an upsert, the last file and line winning field by field.

    Fields set by hand stay, and a status set by hand keeps its reason. A screening row sets status, reason and relevance even
    to null and the short summary only if it has one; an enrichment row sets only what it says. Unusable rows change nothing.
    """
    _stage(stage)
    named = rows.where(usable(stage)).join(aliases(papers), rows["id"] == F.col("key"))
    order = F.struct("file_no", "line")
    last = lambda name, value, needed=None: F.max_by(value, F.when(needed, order) if needed is not None else order).alias(f"_r_{name}")
    said = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    if stage == "screen":
        per_paper = named.groupBy("seq").agg(
            last("status", status_of()), last("status_reason", text.blank_to_null(F.col("reason"))), last("relevance", text.clamped(F.col("relevance"))),
            F.max(F.when(said("short_summary"), F.struct(order.alias("o"), F.col("short_summary").alias("v"))))["v"].alias("_r_short_summary"),
        )
        keep_old = ("short_summary",)
    else:
        fields = ("summary", "rq_relation", "first_level", "second_level", "code", "short_summary")
        latest = lambda name, value, ok: F.max(F.when(ok, F.struct(order.alias("o"), value.alias("v"))))["v"].alias(f"_r_{name}")
        priority = F.lower(F.trim("priority"))
        per_paper = named.groupBy("seq").agg(*(latest(n, F.col(n), said(n)) for n in fields), latest("priority", priority, priority.isin(*PRIORITIES)))
        keep_old = (*fields, "priority")
    names = [c[3:] for c in per_paper.columns if c.startswith("_r_")]
    manual = F.coalesce("extra.manual", F.array().cast("array<string>"))
    joined = papers.join(per_paper.withColumn("_hit", F.lit(True)), "seq", "left")

    def new(name: str) -> Column:
        value = F.coalesce(F.col(f"_r_{name}"), F.col(name)) if name in keep_old else F.col(f"_r_{name}")
        protected = F.array_contains(manual, name) | (F.array_contains(manual, "status") if name == "status_reason" else F.lit(False))
        return F.when(F.coalesce("_hit", F.lit(False)) & ~protected, value).otherwise(F.col(name))

    return joined.withColumns({n: new(n) for n in names}).select(*papers.columns)


def unknown_ids(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """Result rows that name no paper."""
    return rows.join(aliases(papers), rows["id"] == F.col("key"), "left_anti")


def problems(papers: DataFrame, rows: DataFrame, stage: str, categories: list[str]) -> DataFrame:
    """(id, problem): unusable rows, invalid priorities, and categories outside the taxonomy."""
    named = rows.join(aliases(papers).withColumnRenamed("seq", "_seq"), rows["id"] == F.col("key"))
    out = named.where(~usable(stage)).select("id", F.lit("invalid status" if stage == "screen" else "result has no summary").alias("problem"))
    if stage == "enrich":
        priority = F.lower(F.trim("priority"))
        out = out.union(named.where(usable(stage) & (priority != "") & ~priority.isin(*PRIORITIES)).select("id", F.lit("invalid priority").alias("problem")))
        if categories:
            out = out.union(named.where(usable(stage) & (F.col("first_level") != "") & ~F.col("first_level").isin(categories)).select("id", F.lit("category is not in the taxonomy").alias("problem")))
    return out


def missing_results(papers: DataFrame, batches: DataFrame, rows: DataFrame, stage: str) -> DataFrame:
    """Batch rows (batch, id) whose papers no usable result names and which are still pending, after results were applied."""
    keys = aliases(papers)
    done = rows.where(usable(stage)).join(keys, rows["id"] == F.col("key")).select("seq").distinct()
    open_ = papers.where(pending_test(stage)).select("seq")
    return batches.join(keys, batches["id"] == keys["key"]).join(open_, "seq").join(done, "seq", "left_anti").select("batch", "id")


def new_files(files: DataFrame, applied: DataFrame, replay: bool = False) -> DataFrame:
    """Result files (name, size, modified) that were not applied in this very state; all of them on a replay."""
    return files if replay else files.join(applied, ["name", "size", "modified"], "left_anti")
