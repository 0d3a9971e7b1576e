"""Quality rules with risk-controlled thresholds, in DataFrame functions throughout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.batches import cut

BLANKS = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Rejects where value is above a cutoff; grid holds the cutoffs that are tried, strictest first."""

    name: str
    value: str
    grid: tuple[int, ...]


#: Values are whole numbers, so that every engine agrees on them.
RULES = (
    Rule("symbols", "1000 * n_symbols DIV greatest(word_chars, 1)", tuple(range(5, 105, 5))),
    Rule("dup_lines", "1000 * n_dup_lines DIV greatest(n_lines, 1)", tuple(range(50, 1000, 50))),
    Rule("repeats", "1000 * n_repeat_words DIV greatest(n_words, 1)", tuple(range(10, 210, 10))),
    Rule("word_length", "10 * word_chars DIV greatest(n_words, 1)", tuple(range(60, 260, 10))),
)
#: The most strata whose cutoffs are sent to all tasks; beyond it they are joined by a shuffle.
BROADCAST_STRATA = 10_000


def measured(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed, all of whole texts.

    Windows of five words are compared by a hash of 64 bits; only texts in which one occurs twice sort their windows, by 96
    bits. A null text has no words.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    keep = docs.columns
    rows = docs.select(
        *keep,
        F.array_remove(F.split(text, BLANKS), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    word = lambda i, k: F.get("_words", i + F.lit(k))
    five = lambda i: [word(i, k) for k in range(5)]
    starts = F.when(n >= 5, F.sequence(F.lit(0), n - 5)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(
        *keep,
        "_words",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(*five(i))).alias("_hashes"),
    )
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    entry = lambda i: F.struct(F.get("_hashes", i).alias("h"), F.hash(*five(i)).alias("g"), i.alias("i"))
    none = F.array().cast("array<struct<h:bigint,g:int,i:int>>")
    kept = [*keep, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    rows = rows.select(*kept, F.when(again, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_hashes") - 1), entry))).otherwise(none).alias("_sorted"))
    like = lambda a, b: a.isNotNull() & b.isNotNull() & (a["h"] == b["h"]) & (a["g"] == b["g"])
    at = lambda j: F.get("_sorted", j)
    shared = F.filter("_sorted", lambda x, j: like(x, at(j + 1)) | F.when(j > 0, like(x, at(j - 1))).otherwise(False))
    rows = rows.select(*kept, F.array_sort(F.transform(shared, lambda x: x["i"])).alias("_at"))
    # Each window adds the words up to the next one, five at most.
    gain = F.transform("_at", lambda i, j: F.least(F.lit(5), F.coalesce(F.get("_at", j + 1) - i, F.lit(5))))
    rows = rows.select(*kept, F.aggregate(gain, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def log_binomial_tail(k: Column, n: Column, share: float) -> Column:
    """ln P(X <= k) for X binomial with n draws of the given share, exact but for rounding."""
    odds = F.log(F.lit(share / (1 - share)))
    first = n * F.log(F.lit(1 - share))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    draws = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(draws, F.struct(first.alias("term"), first.alias("total")), step, lambda a: a["total"])


def thresholds(holdout: DataFrame, *, risk: float, error: float) -> DataFrame:
    """(stratum, one column for each rule): the cutoff that each rule may use in a stratum, null where it may not be used.

    holdout has stratum, good (boolean) and the measures of rows that pass the base rules. In a stratum each rule may reject
    a share of good rows of risk / rules at most, so that all of them together stay within risk. A cutoff is certified if
    the exact (Clopper-Pearson) upper bound of its false-rejection rate is within that share, which is the case where
    P(X <= rejected) <= level. The level is error over the number of (stratum, rule) families; within a family cutoffs are
    tested in a fixed sequence, loosest first, and the first that fails ends it, which needs no further correction. With
    probability 1 - error all certified cutoffs keep their promise. Of these the one that rejects most rows that are not
    good is used, the loosest in a tie.
    """

    def above(r: Rule) -> Column:
        value = F.expr(r.value)
        return F.size(F.filter(F.array(*(F.lit(g) for g in r.grid)), lambda cutoff: cutoff < value))

    families = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(len(r.grid)).alias("cutoffs"), above(r).alias("above")) for r in RULES))
    counted = holdout.select("stratum", "good", F.explode(families).alias("f")).groupBy("stratum", "f.rule", "f.cutoffs", "f.above")
    counted = cut(counted.agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")))
    # A row above `above` cutoffs is rejected by the cutoffs 0 .. above - 1.
    of = Window.partitionBy("stratum", "rule")
    spread = counted.groupBy("stratum", "rule", "cutoffs").agg(F.collect_list(F.struct("above", "good", "bad")).alias("cells"), F.sum("good").alias("n")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cutoffs") - 1)))
    total = lambda name: F.aggregate(F.filter("cells", lambda x: x["above"] > F.col("c")), F.lit(0).cast("long"), lambda a, x: a + x[name])
    tried = spread.select("stratum", "rule", "c", "n", total("good").alias("k"), total("bad").alias("gain"))
    share = risk / len(RULES)
    level = F.log(F.lit(error / len(RULES) / max(1, counted.select("stratum").distinct().count())))
    tried = tried.withColumn("fine", (F.col("n") > 0) & F.when(F.col("k") < F.col("n") * share, log_binomial_tail(F.col("k"), F.col("n"), share) <= level).otherwise(False))
    tried = tried.withColumn("certified", F.min("fine").over(of.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)))
    best = tried.where("certified and gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "c"))["c"].alias("c"))
    cutoff = lambda r: F.max(F.when(F.col("rule") == r.name, F.element_at(F.array(*(F.lit(g) for g in r.grid)), F.col("c") + 1)))
    return best.groupBy("stratum").agg(*(cutoff(r).alias(f"cutoff_{r.name}") for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, *, risk: float = 0.02, error: float = 0.05, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang", label_column: str = "quality") -> DataFrame:
    """A row for each row of docs: id, the measures, base_failed, stratum, the cutoffs of its stratum, and kept.

    kept is false where base_failed, or where a certified rule of the row's stratum rejects it. Rows with a label are the
    holdout (no rule is fitted otherwise); label 1 is good. In a stratum with too few good labels no cutoff can be certified
    and only the base rules hold. A null stratum is the stratum ''; a label row without id or label takes no part; an id
    with several labels is good only if all say so. Null ids are judged but are no holdout. Repeated rows get equal
    verdicts; a repeated row that has a label counts each time.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(stratum_column).cast("string"), F.lit("")).alias("stratum"), F.col(text_column).alias("text"))
    rows = cut(measured(rows).drop("text"))
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg((F.min(label_column) == 1).alias("good"))
    holdout = rows.where("not base_failed").join(known, "id")
    cutoffs = cut(thresholds(holdout, risk=risk, error=error))
    few = cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    judged = rows.join(F.broadcast(cutoffs) if few else cutoffs, "stratum", "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.expr(r.value) > F.col(f"cutoff_{r.name}"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected).withColumnRenamed("id", id_column)
