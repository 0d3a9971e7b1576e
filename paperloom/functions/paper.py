"""What is derived from a paper record: ids, keys, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text

LINKED = r"^(?:backward|forward):"


def _filled(name: str) -> Column:
    return text.blank_to_null(F.col(name))


def _title_id() -> Column:
    key = text.norm_title(F.col("title"))
    key = F.when(key != "", key).otherwise(F.trim(F.lower("title")))
    return F.concat(F.lit("title:"), F.substring(F.sha1(key.cast("binary")), 1, 12))


def _ids() -> list[Column]:
    return [F.concat(F.lit("doi:"), _filled("doi")), F.concat(F.lit("arxiv:"), F.lower(_filled("arxiv_id"))), F.concat(F.lit("openalex:"), _filled("openalex_id")), F.concat(F.lit("s2:"), _filled("s2_id"))]


def paper_id() -> Column:
    """The first identifier a record has, else a hash of its title."""
    return F.coalesce(*_ids(), _title_id())


def identifier_keys() -> Column:
    """All identifiers of a record, in order of precedence."""
    return F.array_compact(F.array(*_ids()))


def title_key(least: int = 20) -> Column:
    """A key for the title; short titles are too common to have one."""
    title = text.norm_title(F.col("title"))
    return F.when(F.length(title) >= least, F.concat(F.lit("title:"), title))


def link() -> Column:
    at = lambda address, name: F.concat(F.lit(address), _filled(name))
    return F.coalesce(at("https://doi.org/", "doi"), at("https://arxiv.org/abs/", "arxiv_id"), _filled("url"), at("https://openalex.org/", "openalex_id"), at("https://www.semanticscholar.org/paper/", "s2_id"))


def parents() -> Column:
    """Ids of the papers that led here, in order; an id itself holds colons, so only the first one separates."""
    return F.array_distinct(F.transform(F.filter("found_via", lambda v: v.rlike(LINKED)), lambda v: F.regexp_extract(v, r"(?s)^[^:]*:(.*)$", 1)))


def hits() -> Column:
    return F.size(parents())


def found_kinds() -> Column:
    """Kinds of provenance in order: the database of searches, else the first part."""
    part = lambda v: F.split_part(v, F.lit(":"), F.lit(1))
    return F.array_distinct(F.transform("found_via", lambda v: F.when(part(v) == "search", F.split_part(v, F.lit(":"), F.lit(2))).otherwise(part(v))))


def first_kind() -> Column:
    return F.coalesce(F.get(found_kinds(), F.lit(0)), F.lit("manual"))


def included() -> Column:
    return F.col("excluded_reason").isNull() & F.coalesce(F.col("status").isin("core", "skim"), F.lit(False))


def missing_metadata() -> Column:
    return _filled("abstract").isNull() | F.col("citation_count").isNull()


def lookup_doi() -> Column:
    """The DOI under which a record can be looked up; arXiv papers have one of their own."""
    return F.coalesce(_filled("doi"), F.concat(F.lit("10.48550/arxiv."), F.lower(_filled("arxiv_id"))))


def lookup_key() -> Column:
    """The key for batch look-ups by any identifier."""
    return F.coalesce(_filled("s2_id"), F.concat(F.lit("DOI:"), _filled("doi")), F.concat(F.lit("ARXIV:"), _filled("arxiv_id")))


def normalized(papers: DataFrame) -> DataFrame:
    """Records cleaned at ingest: markup and entities out of texts, identifiers in normal form, arXiv's own DOIs as arXiv ids.

    Done once where records enter; unescaping twice would change texts that were escaped twice.
    """
    clean = lambda name, markup=True: text.squeeze(text.strip_markup(text.unescape(F.col(name))) if markup else text.unescape(F.col(name)))
    doi = text.norm_doi(F.col("doi"))
    own = text.arxiv_of_doi(doi)
    return papers.withColumns({
        "title": F.coalesce(clean("title"), F.lit("")),
        "venue": text.blank_to_null(clean("venue", False)),
        "abstract": text.blank_to_null(clean("abstract")),
        "doi": F.when(own.isNull(), doi),
        "arxiv_id": text.norm_arxiv(F.coalesce(_filled("arxiv_id"), own)),
        "openalex_id": F.upper(F.element_at(F.split(F.rtrim(F.col("openalex_id"), F.lit("/")), "/"), -1)),
        "authors": F.filter("authors", lambda a: a.isNotNull() & (a != "")),
    })
