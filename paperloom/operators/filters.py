"""Ordered exclusion rules that explain themselves: the first rule a paper fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import boolean, paper

#: Papers that a user supplied are never filtered out.
PROTECTED = ("seed:known", "manual")


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def exclusion_reason(f: dict, year_now: int) -> Column:
    """Why a paper fails the filters f, null if it passes: one chain of conditions in rule order.

    Unknown years, languages, types, citation counts and venues pass their rules. year_now is a parameter, so that a result
    can be computed again.
    """
    text = F.concat(F.col("title"), F.lit(" "), F.coalesce("abstract", F.lit("")))
    year = F.nullif("year", F.lit(0))
    rules: list[tuple[Column, Column]] = [(F.arrays_overlap("found_via", F.array(*(F.lit(p) for p in PROTECTED))), F.lit(None).cast("string"))]
    if f.get("year_min"):
        rules.append((year < int(f["year_min"]), F.lit(f"published before {f['year_min']}")))
    if f.get("year_max"):
        rules.append((year > int(f["year_max"]), F.lit(f"published after {f['year_max']}")))
    if f.get("languages"):
        known = F.nullif("language", F.lit(""))
        rules.append((~F.lower(known).isin([str(x).lower() for x in f["languages"]]), _say("language: ", known)))
    for kind in f.get("exclude_types") or []:
        rules.append((F.contains(F.lower("type"), F.lit(str(kind).lower())) & (F.col("type") != ""), _say("publication type: ", F.col("type"))))
    if f.get("require_abstract"):
        rules.append((F.coalesce("abstract", F.lit("")) == "", F.lit("no abstract")))
    if least := int(f.get("min_citations") or 0):
        young = F.coalesce(F.lit(year_now) - year < int(f.get("citation_grace_years") or 0), F.lit(False))
        rules.append(((F.col("citation_count") < least) & ~young, F.lit(f"fewer than {least} citations")))
    for part in f.get("venue_exclude") or []:
        rules.append((F.contains(F.lower("venue"), F.lit(str(part).lower())) & (F.col("venue") != ""), _say("venue: ", F.col("venue"))))
    for term in boolean.usable(f.get("exclude_any")):
        rules.append((boolean.mentions(text, term), F.lit(f"mentions '{term}'")))
    if needed := boolean.usable(f.get("require_any")):
        some = F.lit(False)
        for term in needed:
            some = some | boolean.mentions(text, term)
        rules.append((~some, F.lit("none of the required keywords")))
    if least := int(f.get("min_hits") or 0):
        rules.append(((F.col("round") > 0) & (paper.hits() < least), F.lit(f"linked from fewer than {least} papers")))
    chain = F.when(*rules[0])
    for condition, reason in rules[1:]:
        chain = chain.when(condition, reason)
    return chain


def apply_filters(papers: DataFrame, f: dict, year_now: int) -> DataFrame:
    """papers with excluded_reason computed anew; a projection, so it can be repeated at will."""
    return papers.withColumn("excluded_reason", exclusion_reason(f, year_now))


def reason_counts(papers: DataFrame) -> DataFrame:
    """(reason, n): languages, types and venues count under their rule's name."""
    rule = F.regexp_replace("excluded_reason", "(?s)^(language|publication type|venue):.*$", "$1")
    return papers.where("excluded_reason is not null").groupBy(rule.alias("reason")).agg(F.count("*").alias("n"))


def where(papers: DataFrame, conditions: list[str]) -> DataFrame:
    """Papers that meet all of the conditions k=v: included, excluded, found, round, or any column, compared without case.

    A value of none (or nothing) asks for null; included and excluded take yes or no.
    """
    for condition in conditions:
        key, _, value = condition.partition("=")
        key, value = key.strip(), value.strip()
        yes = value.lower() in ("true", "yes", "1")
        if key == "included":
            test = paper.included() == F.lit(yes)
        elif key == "excluded":
            test = F.col("excluded_reason").isNotNull() == F.lit(yes)
        elif key in ("found", "found_via"):
            test = F.array_contains(paper.found_kinds(), value)
        else:
            name = {"citations": "citation_count", "reason": "status_reason"}.get(key, key)
            if name not in papers.columns:
                raise ValueError(f"unknown field {key!r}; fields are {', '.join(papers.columns)}")
            column = F.col(name).cast("string")
            test = F.coalesce(column, F.lit("")) == "" if value.lower() in ("", "none", "null") else F.lower(column) == value.lower()
        papers = papers.where(test)
    return papers
