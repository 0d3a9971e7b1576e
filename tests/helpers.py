"""Builders for small tables of papers."""

from __future__ import annotations

from paperloom.plans.schema import PAPER

TITLE = "A study of citation networks for forecasting"


def papers(spark, *records: dict):
    """Records with defaults, in order of seq."""
    full = []
    for i, r in enumerate(records):
        row = {"seq": i, "title": TITLE, "authors": [], "found_via": [], "round": 0, "extra": None} | r
        full.append(tuple(row.get(f.name) for f in PAPER.fields))
    return spark.createDataFrame(full, PAPER)


def values(spark, kind: str, items: list, f) -> list:
    """f of a column of items, in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(items)), f"k int, v {kind}")
    return [r.out for r in df.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]
