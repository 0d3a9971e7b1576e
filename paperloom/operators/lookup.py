"""Look-ups: user references to records, titles to records, gaps in records filled from metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import paper, text
from paperloom.operators.components import discard, stored
from paperloom.operators.identity import numbering, sequence_ratio
from paperloom.operators.near import first_near, SIMILAR

#: Fields that metadata fills where they are blank.
COMPLETED = ("abstract", "citation_count", "doi", "arxiv_id", "s2_id", "openalex_id", "venue", "year", "pdf_url", "language")


def _blank(c: Column, kind: str) -> Column:
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def wanted(references: DataFrame) -> DataFrame:
    """references (seq, item) with kind, value and the keys they are looked up by; of equal DOIs the first one stands for all.

    An arXiv id is looked up by the DOI that arXiv gives it.
    """
    rows = references.withColumns({"kind": text.reference_kind(F.col("item")), "value": text.reference_value(F.col("item"))})
    doi = F.when(F.col("kind") == "doi", F.lower("value")).when(F.col("kind") == "arxiv", F.concat(F.lit("10.48550/arxiv."), F.lower("value")))
    key = F.concat(F.element_at(F.create_map(F.lit("doi"), F.lit("DOI:"), F.lit("arxiv"), F.lit("ARXIV:"), F.lit("s2"), F.lit("")), F.col("kind")), F.col("value"))
    rows = rows.withColumns({"doi_key": doi, "lookup": key})
    once = Window.partitionBy("doi_key").orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(once)).where(F.col("doi_key").isNull() | (F.col("_n") == 1)).drop("_n")


def resolve(references: DataFrame, first: DataFrame, second: DataFrame, tag: str, *others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records found, errors) for references (seq, item).

    DOIs and arXiv ids are looked up in `first` by DOI; what is left, and ids of the second source, in `second`; titles are
    matched with match_titles() in `second`, `first` and then the `others`. Found records carry item, request_seq and found_via [tag]; errors have seq, item, why.
    """
    asked = wanted(references)
    by_doi = first.withColumn("doi_key", paper.lookup_doi()).where("doi_key is not null").dropDuplicates(["doi_key"])
    ids = asked.where("kind <> 'title'").select(F.col("seq").alias("request_seq"), "item", "kind", "value", "doi_key", "lookup")
    hit = ids.join(by_doi, "doi_key").drop("doi_key", "kind", "value", "lookup")
    left = ids.join(by_doi.select("doi_key"), "doi_key", "left_anti")
    # A record answers to each of its identifiers.
    keys = F.array_compact(F.array(F.concat(F.lit("DOI:"), F.col("doi")), F.concat(F.lit("ARXIV:"), F.lower("arxiv_id")), F.col("s2_id")))
    by_key = second.withColumn("_key", F.explode(keys)).dropDuplicates(["_key"])
    normal = F.when(F.col("kind") == "arxiv", F.concat(F.lit("ARXIV:"), F.lower("value"))).otherwise(F.col("lookup"))
    late = left.withColumn("_key", normal)
    hit2 = late.join(by_key, "_key").drop("doi_key", "kind", "value", "lookup", "_key")
    missing = late.join(by_key.select("_key"), "_key", "left_anti").select(F.col("request_seq").alias("seq"), "item", F.concat(F.lit("not found: "), F.col("lookup")).alias("why"))
    titles = asked.where("kind = 'title'").select(F.col("seq").alias("request_seq"), "item")
    candidates = first.withColumn("source_rank", F.lit(1)).unionByName(second.withColumn("source_rank", F.lit(0)))
    for rank, other in enumerate(others, 2):
        candidates = candidates.unionByName(other.withColumn("source_rank", F.lit(rank)))
    matched = match_titles(titles.withColumnRenamed("item", "asked"), candidates).withColumnRenamed("asked", "item").drop("source_rank")
    unmatched = titles.join(matched.select("request_seq"), "request_seq", "left_anti").select(F.col("request_seq").alias("seq"), "item", F.lit("no confirmed match for this title").alias("why"))
    found = hit.unionByName(hit2).unionByName(matched).withColumn("found_via", F.array(F.lit(tag)))
    return found, missing.union(unmatched)


def match_titles(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first candidate (by source_rank, seq) whose title equals or nearly equals each asked one; asked has request_seq and asked.

    Distinct titles are compared. Near ones meet by the rarest pieces of the asked title (near.candidates()), but for those
    that come after an equal title.
    """
    at = F.struct("source_rank", "seq")
    said = candidates.select("title", at.alias("at"), F.lit(False).alias("wanted")).union(asked.select("asked", F.lit(None).cast(candidates.select(at.alias("at")).schema["at"].dataType), F.lit(True)))
    distinct = stored(said.groupBy("title").agg(F.min("at").alias("at"), F.max("wanted").alias("wanted")))  # normal forms are reckoned once a title
    forms = stored(distinct.withColumn("name", text.norm_title(F.col("title"))).where("name <> ''"))
    numbers = F.array_join(numbering(F.col("name")), " ").alias("numbers")
    # Ids follow the order of candidates, so the first of some is the one with the least.
    titles = stored(forms.where("at is not null").groupBy("name").agg(F.min("at").alias("at")).select("name", "at.*").orderBy("source_rank", "seq").withColumn("id", F.monotonically_increasing_id()))
    own = titles.select("name", F.col("id").alias("limit"))
    names = stored(forms.where("wanted").select("name").distinct().join(own, "name", "left").select("name", "limit", numbers, F.monotonically_increasing_id().alias("id")))
    near = first_near(names, titles.select("id", "name", numbers), ["numbers"], lambda a, b: sequence_ratio(a, b) >= SIMILAR).toDF("id", "best")
    found = names.join(near, "id", "left").select("name", F.coalesce("best", "limit").alias("id")).where("id is not null")
    best = stored(forms.where("wanted").select("title", "name").join(found, "name").join(titles.select("id", "source_rank", "seq"), "id").select(F.col("title").alias("asked"), "source_rank", "seq"))
    discard(distinct, forms, titles, names)
    return asked.join(best, "asked").join(candidates, ["source_rank", "seq"]).select(*asked.columns, *candidates.columns)


def aligned(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every request (seq, key) with its record, or nulls: a batch look-up whose answers keep the order of the questions."""
    return requests.join(table.dropDuplicates([key]), key, "left")


def complete(papers: DataFrame, metadata: DataFrame, key: str, source: str, *, force: bool = False) -> DataFrame:
    """papers with blank fields filled from metadata by key, and the source noted as checked.

    key names a column that both tables have. Only papers that miss an abstract or a citation count, have a key and were not
    checked with this source before (unless forced) are looked up; all of these are noted, whether the source knew them or not.
    """
    known = F.array_contains(F.coalesce("extra.meta_checked", F.array().cast("array<string>")), source)
    target = paper.missing_metadata() & F.col(key).isNotNull() & (F.lit(force) | ~known)
    own = metadata.where(F.col(key).isNotNull()).dropDuplicates([key])
    names = [c for c in COMPLETED if c in metadata.columns and c != key]
    joined = papers.withColumn("_target", target).join(own.select(key, *(F.col(c).alias(f"_new_{c}") for c in names)), key, "left")
    kinds = dict(papers.dtypes)
    filled = {c: F.when(F.col("_target") & _blank(F.col(c), kinds[c]) & ~_blank(F.col(f"_new_{c}"), dict(own.dtypes)[c]), F.col(f"_new_{c}").cast(kinds[c])).otherwise(F.col(c)) for c in names}
    noted = F.array_sort(F.array_union(F.coalesce("extra.meta_checked", F.array().cast("array<string>")), F.array(F.lit(source))))
    extra = F.when(F.col("_target"), F.struct(F.col("extra.manual").alias("manual"), noted.alias("meta_checked"), F.col("extra.rest").alias("rest"))).otherwise(F.col("extra"))
    return joined.withColumns(filled | {"extra": extra}).select(*papers.columns)
