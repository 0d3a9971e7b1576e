"""The paper record as a Spark schema, and helpers to bring any DataFrame into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("core", "skim", "exclude")
PRIORITIES = ("high", "medium", "low")

_S, _A = T.StringType(), T.ArrayType(T.StringType())
#: manual: fields set by hand; meta_checked: sources that have answered for the record; rest: unknown fields as JSON by name.
EXTRA = T.StructType([T.StructField("manual", _A), T.StructField("meta_checked", _A), T.StructField("rest", T.MapType(_S, _S))])
FIELDS: dict[str, T.DataType] = {
    "title": _S, "authors": _A, "year": T.IntegerType(), "venue": _S, "doi": _S, "arxiv_id": _S, "openalex_id": _S, "s2_id": _S,
    "url": _S, "pdf_url": _S, "abstract": _S, "citation_count": T.LongType(), "language": _S, "type": _S, "found_via": _A,
    "round": T.IntegerType(), "excluded_reason": _S, "status": _S, "status_reason": _S, "relevance": T.DoubleType(),
    "short_summary": _S, "summary": _S, "rq_relation": _S, "first_level": _S, "second_level": _S, "priority": _S, "code": _S,
    "extra": EXTRA,
}
#: seq is a record's place in the list of papers; ties and "first" always go by it.
PAPER = T.StructType([T.StructField("seq", T.LongType()), *(T.StructField(n, t) for n, t in FIELDS.items())])
#: Fields that a merge fills from the first record that has them.
FILLED = (
    "title", "year", "venue", "doi", "arxiv_id", "openalex_id", "s2_id", "url", "pdf_url", "language", "type", "excluded_reason",
    "status", "status_reason", "relevance", "short_summary", "summary", "rq_relation", "first_level", "second_level", "priority", "code",
)
#: Fields that may be set by hand.
EDITABLE = ("status", "status_reason", "relevance", "short_summary", "summary", "first_level", "second_level", "priority", "code")


def conform(df: DataFrame, *, seq: str | None = None) -> DataFrame:
    """df with exactly the columns of PAPER: absent ones are null, found_via, authors and round are never null.

    A column that clashes in name but not in type is cast. seq names the column that orders records, "seq" if None.
    """
    have = set(df.columns)
    out = [F.col(seq or "seq").cast("long").alias("seq")]
    for name, kind in FIELDS.items():
        column = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if name in ("authors", "found_via"):
            column = F.coalesce(column, F.array().cast(kind))
        elif name == "round":
            column = F.coalesce(column, F.lit(0))
        elif name == "title":
            column = F.coalesce(column, F.lit(""))
        out.append(column.alias(name))
    return df.select(*out)
