"""Near-title joins: pairs of titles that may be near-identical, found by their rarest grams.

Two titles of ratio SIMILAR differ by at most so many characters that are missing from one or the other. Each of these
spoils at most one of some disjoint pieces of a title, so of one piece more than that, one stands unchanged in the other
title, at nearly the same place. Any disjoint pieces will do: those are taken that are rarest over all titles.

Joins of grams and of pairs are merge joins: stored tables are many times smaller than what they hold, and their titles than
their grams, so that the optimizer would broadcast what doesn't fit into the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.operators.components import discard, stored

SIMILAR = 0.93
#: Characters that may be missing, for each of a title's: its partner has at most (2 - SIMILAR) / SIMILAR times as many.
EDITS = 2 * (1 - SIMILAR) / SIMILAR
#: Length of a gram; of titles shorter than SHORT, which need more pieces than they have room for, that of a short one.
GRAM, SHORT_GRAM, SHORT = 5, 3, 21
#: Half places, counted from a title's middle, that share a part of the key, so that a common gram is many keys and meets only
#: what stands near it.
PLACES = 16
#: Grams that are at least one in so many of all are common: there can't be more of them than this, so they fit in memory.
COMMON = 20_000
#: Right titles of a piece that each left one with it is compared with first.
LEADERS = 8
#: Titles of a block that meet in one cell, on either side.
CELL = 512
#: Titles up to this length get the best choice of pieces, longer ones the rarest piece of each of as many equal parts.
CHOSEN = 400


def missing_at_most(total: Column) -> Column:
    """The most characters that two titles of ratio SIMILAR and of this summed length may miss of each other."""
    return F.floor(F.lit(1 - SIMILAR) * total + F.lit(1e-6)).cast("int")


def spoiled_at_most(length: Column) -> Column:
    """The most pieces of a title of this length that a near one can spoil."""
    return F.floor(length * F.lit(EDITS) + F.lit(1e-6)).cast("int")


def gram_size(length: Column) -> Column:
    return F.when(length >= SHORT, GRAM).otherwise(SHORT_GRAM)


def grams(name: Column) -> Column:
    """(place, gram) of all substrings of the sizes that the pieces of titles of near lengths have."""
    n = F.length(name)
    low, high = F.floor(n * F.lit(SIMILAR / (2 - SIMILAR))), F.ceil(n * F.lit((2 - SIMILAR) / SIMILAR))
    sizes = F.array_distinct(F.array(gram_size(low), gram_size(high)))
    at = lambda q: F.transform(F.sequence(F.lit(1), n - q + 1), lambda p: F.struct(p.alias("place"), F.substring(name, p, q).alias("gram")))
    return F.flatten(F.transform(sizes, lambda q: F.when(q <= n, at(q)).otherwise(F.array().cast("array<struct<place:int,gram:string>>"))))


def rarest(costs: np.ndarray, size: int, count: int) -> np.ndarray:
    """For each row, the starts of `count` disjoint pieces of `size` whose costs, one for each start, add up to the least."""
    rows, starts = costs.shape
    best = np.full((count + 1, starts + size, rows), np.inf)  # of so many pieces among the first starts
    best[0] = 0
    for p in range(starts):
        best[1:, p + size] = np.minimum(best[1:, p + size - 1], best[:-1, p] + costs[:, p])
    out = np.zeros((rows, count), np.int64)
    at = np.full(rows, starts - 1)
    row = np.arange(rows)
    for j in range(count, 0, -1):
        while True:
            left_out = best[j, at + size - 1, row] == best[j, at + size, row]
            if not left_out.any():
                break
            at = at - left_out
        out[:, j - 1] = at
        at = at - size
    return out


def rarest_of_parts(costs: np.ndarray, size: int, count: int) -> np.ndarray:
    """The same for one long row: the piece of least cost in each of `count` equal parts."""
    edges = (np.arange(count + 1) * (len(costs) + size - 1)) // count
    return np.array([a + int(np.argmin(costs[a : z - size + 1])) for a, z in zip(edges, edges[1:])], np.int64)


def _pieces_udf(common: dict[str, int], floor: int, spoiled=lambda n: int(n * EDITS + 1e-6)):
    """Places (from 1) of the pieces of each title, as a function of a column of titles: one more than `spoiled` of its length."""

    def places(names: pa.Array) -> pa.Array:
        out: list = [[] for _ in range(len(names))]
        alike: dict[int, list[int]] = {}
        texts = names.to_pylist()
        for i, t in enumerate(texts):
            if t and (k := spoiled(len(t))):
                q = GRAM if len(t) >= SHORT else SHORT_GRAM
                if len(t) > CHOSEN:
                    costs = np.array([common.get(t[p : p + q], floor) for p in range(len(t) - q + 1)], np.float64)
                    out[i] = (rarest_of_parts(costs, q, k + 1) + 1).tolist()
                else:
                    alike.setdefault(len(t), []).append(i)
        for n, which in alike.items():
            q, k = GRAM if n >= SHORT else SHORT_GRAM, spoiled(n)
            step = max(1, 2_000_000 // (n * (k + 2)))
            for low in range(0, len(which), step):
                some = which[low : low + step]
                costs = np.array([[common.get(texts[i][p : p + q], floor) for p in range(n - q + 1)] for i in some], np.float64)
                for i, found in zip(some, (rarest(costs, q, k + 1) + 1).tolist()):
                    out[i] = found
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(places, T.ArrayType(T.IntegerType()))


#: Letters whose counts are compared before titles are, in two parts as a long has room for sixteen counts.
LETTERS = ("abcdefghijklmno", "pqrstuvwxyz ")


def letter_counts(title: Column, name: str) -> list[Column]:
    """Columns name0, name1: counts of letters in four bits each, coded so that at least as many bits differ as counts differ less than by eight."""
    codes = F.array(*(F.lit(x).cast("long") for x in (0, 1, 3, 7, 15, 14, 12, 8)))
    count = lambda c: F.length(title) - F.length(F.replace(title, c, F.lit("")))
    bits = lambda letters: F.aggregate(F.array(*(F.lit(x) for x in letters)), F.lit(0).cast("long"), lambda b, c: b * 16 + F.get(codes, count(c) % 8))
    return [bits(x).alias(f"{name}{i}") for i, x in enumerate(LETTERS)]


def edits_at_most(total: Column) -> Column:
    """The most edits that the prefilter of near titles allows two titles of this summed length."""
    return F.floor(F.lit(1 - SIMILAR) * total).cast("int") + 1


def met_by_edits(titles: DataFrame) -> DataFrame:
    """(left_id, right_id), stored: pairs of titles of different blocks that may have as few edits between them as edits_at_most() of their lengths.

    titles has id, numbers, block (a number), n, the length that counts, raw, what is edited, at least as long and at least SHORT,
    and letter counts l0, l1 of it. An edit spoils one piece at most, so of one piece more of the longer title than it may have edits, one
    stands in the other.
    """
    at_most = lambda n: int(2 * (1 - SIMILAR) * n + 1e-6) + 1
    size = F.length("raw")
    every = F.transform(F.sequence(F.lit(1), size - GRAM + 1), lambda p: F.struct(p.alias("place"), F.substring(F.col("raw"), p, GRAM).alias("gram")))
    plain = titles.select("id", "block", "n", "raw", "l0", "l1", F.xxhash64("numbers").alias("k"))
    total = plain.select(F.sum(size - GRAM + 1)).first()[0] or 0
    floor = max(8, total // COMMON + 1)
    counted = plain.select(F.explode(every["gram"]).alias("gram")).groupBy("gram").count()
    common = {r.gram: r["count"] for r in counted.where(F.col("count") >= floor).collect()}  # COMMON at most
    ready = stored(plain.withColumn("places", _pieces_udf(common, floor, at_most)(F.col("raw"))))
    code = lambda gram, bucket: F.xxhash64(gram, bucket, "k")
    own = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("id", "block", "n", "at", "l0", "l1")]
    middle = lambda place: (2 * F.col(place) - size).alias("at")
    reach = edits_at_most(2 * F.col("n")) + 1
    pieces = ready.select("*", F.explode("places").alias("place")).select("*", middle("place"), F.substring(F.col("raw"), F.col("place"), F.lit(GRAM)).alias("gram"))
    a = pieces.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - reach) / PLACES), F.floor((F.col("at") + reach) / PLACES)))).select(code(F.col("gram"), F.col("bucket")).alias("code"), *own("a"))
    b = ready.select("*", F.explode(every).alias("g")).select("*", middle("g.place")).select(code(F.col("g.gram"), F.floor(F.col("at") / PLACES)).alias("code"), *own("b"))
    most = edits_at_most(F.col("a_n") + F.col("b_n"))
    apart = F.col("a_n") - F.col("b_n")
    first = (apart > 0) | ((apart == 0) & (F.col("a_id") > F.col("b_id")))
    near_lengths = 2 * F.col("b_n") >= F.lit(SIMILAR) * (F.col("a_n") + F.col("b_n"))
    fits = (F.col("a_block") != F.col("b_block")) & first & near_lengths & (F.abs(F.col("b_at") - F.col("a_at")) <= most) & letters_fit(2 * most)
    met = stored(a.join(b.hint("merge"), "code").where(fits).select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id")).distinct())
    discard(ready)
    return met


class Prepared:
    """Both sides of a join, with what is reckoned once a title: its length, letters, keys and pieces."""

    def __init__(self, left: DataFrame, right: DataFrame, keys: list[str], *, both: bool = False):
        """left has id, name, limit and the keys, right has id, name and the keys; names are distinct, normalized titles of each
        side. Pieces of the right side are chosen only if both are asked for."""
        # Stored, or else what is reckoned once a title would be reckoned once a gram.
        ready = lambda df, *more: stored(df.select("id", *more, "name", F.length("name").cast("int").alias("n"), *letter_counts(F.col("name"), "l"), F.xxhash64(F.lit(0), *keys).alias("k")))
        plain = ready(right)
        total = plain.select(F.sum(F.size(grams(F.col("name"))))).first()[0] or 0
        counted = plain.select(F.explode(grams(F.col("name"))["gram"]).alias("gram")).groupBy("gram").count()
        floor = max(8, total // COMMON + 1)
        common = {r.gram: r["count"] for r in counted.where(F.col("count") >= floor).collect()}  # COMMON at most
        pieces = _pieces_udf(common, floor)(F.col("name")).alias("places")
        self.left = ready(left.select("*", pieces), "limit", "places")
        self.right = plain
        if both:
            self.right = ready(right.select("*", pieces), "places")
            discard(plain)

    def discard(self) -> None:
        discard(self.left, self.right)


def letters_fit(most: Column) -> Column:
    """Whether the letters of rows a_ and b_ of titles with l0, l1 leave it open that so many characters are missing from one or the other."""
    return _letters_fit("a_l0", "a_l1", "b_l0", "b_l1", most)


def _gram_at(place: str = "place") -> Column:
    return F.expr(f"substring(name, {place}, case when n >= {SHORT} then {GRAM} else {SHORT_GRAM} end)")


def _letters_fit(a0: str, a1: str, b0: str, b1: str, most: Column) -> Column:
    return F.bit_count(F.col(a0).bitwiseXOR(F.col(b0))) + F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) <= most


def met_by_pieces(sides: Prepared, limits: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id) of pairs that may be near-identical: no near-identical pair of equal keys is left out.

    classes (id, class) of both sides' titles, where given, leave out pairs of one class; a null class is like no other.

    Only right ids below a left row's limit count, all if it is null; limits (id, limit) stand for those of the left side.
    Pairs meet by a piece of the left title, near its place; their lengths, letters and order are tested where they meet, so
    that pairs come out of the join, each as often as they share a piece, that mostly are near indeed. Places count from the
    middle: what is missing before a piece moves it by half a place there, and what is missing behind it by half the other way.
    """
    code = lambda gram, bucket: F.xxhash64(gram, bucket, "k")
    left = sides.left if limits is None else sides.left.drop("limit").join(limits, "id")
    classed = lambda df: df.withColumn("class", F.lit(None).cast("long")) if classes is None else df.join(classes, "id")
    pieces = classed(left).select("id", "limit", "name", "n", "l0", "l1", "k", "class", F.explode("places").alias("place"))
    reach, middle = spoiled_at_most(F.col("n")), lambda place: 2 * F.col(place) - F.col("n")
    buckets = F.sequence(F.floor((F.col("at") - reach) / PLACES), F.floor((F.col("at") + reach) / PLACES))
    pieces = pieces.withColumns({"gram": _gram_at(), "at": middle("place")}).withColumn("bucket", F.explode(buckets))
    a = pieces.select(code(F.col("gram"), F.col("bucket")).alias("code"), *(F.col(c).alias(f"a_{c}") for c in ("id", "limit", "n", "at", "l0", "l1", "class")))
    every = classed(sides.right).select("id", "n", "l0", "l1", "k", "class", F.explode(grams(F.col("name"))).alias("g")).withColumn("at", middle("g.place"))
    b = every.select(code(F.col("g.gram"), F.floor(F.col("at") / PLACES)).alias("code"), *(F.col(c).alias(f"b_{c}") for c in ("id", "n", "at", "l0", "l1", "class")))
    most = missing_at_most(F.col("a_n") + F.col("b_n"))
    fits = (F.abs(F.col("b_n") - F.col("a_n")) <= most) & (F.abs(F.col("b_at") - F.col("a_at")) <= most) & _letters_fit("a_l0", "a_l1", "b_l0", "b_l1", most) & (F.col("a_limit").isNull() | (F.col("b_id") < F.col("a_limit"))) & F.coalesce(F.col("a_class") != F.col("b_class"), F.lit(True))
    return a.join(b.hint("merge"), "code").where(fits).select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id")).distinct()


def met_by_leaders(sides: Prepared, marks: tuple[DataFrame, DataFrame] | None = None, most: int = LEADERS) -> DataFrame:
    """(left_id, right_id) of pairs of a left title and the first right ones that have a piece with it: at most `most` for each piece.

    marks, where given, are those of the left and of the right titles, (id, mark) each: the first ones of each piece and mark
    meet those that have both.
    """
    pieces = lambda df, *more: df.select("id", *more, "name", "n", "l0", "l1", "k", F.explode("places").alias("place")).select("id", *more, "n", "l0", "l1", F.xxhash64(_gram_at(), "k").alias("code"))
    if marks:
        plain = pieces
        pieces = lambda df, *more: plain(df, *more).join(marks[0 if more else 1].hint("merge"), "id").withColumn("code", F.xxhash64("code", "mark"))
    first = pieces(sides.right).withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("nth") <= most)
    first = first.select("code", F.col("id").alias("right_id"), *(F.col(c).alias(f"b_{c}") for c in ("n", "l0", "l1")))
    missing = missing_at_most(F.col("n") + F.col("b_n"))
    fits = (F.abs(F.col("n") - F.col("b_n")) <= missing) & _letters_fit("l0", "l1", "b_l0", "b_l1", missing) & (F.col("limit").isNull() | (F.col("right_id") < F.col("limit")))
    return pieces(sides.left, "limit").join(first.hint("merge"), "code").where(fits).select(F.col("id").alias("left_id"), "right_id").distinct()


def candidates(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """met_by_pieces() of two sides, stored."""
    sides = Prepared(left, right, keys)
    out = stored(met_by_pieces(sides))
    sides.discard()
    return out


def met_in_blocks(titles: DataFrame, keys: list[str], fits: Column) -> DataFrame:
    """(left_id, right_id): each pair of titles of equal keys, once, for which fits holds, a condition on columns a_... and b_... of titles.

    titles has id, the keys and held, the number of titles of its keys. A block is cut into parts of some CELL titles, and each two
    of them meet in a cell of their own: no pair is left out, a large block is dealt out evenly, and no task holds more than a cell.
    """
    of = F.ceil(F.col("held") / CELL).cast("int")
    cut = titles.withColumn("of", of).withColumn("part", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    own = lambda side: [F.col(c).alias(f"{side}_{c}") for c in titles.columns if c not in (*keys, "held")]
    a = cut.select(*keys, *own("a"), F.col("part").alias("low"), F.explode(F.sequence(F.col("part"), F.col("of") - 1)).alias("high"))
    b = cut.select(*keys, *own("b"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("low"), F.col("part").alias("high"))
    met = a.join(b.hint("merge"), [*keys, "low", "high"]).where(((F.col("low") < F.col("high")) | (F.col("a_id") < F.col("b_id"))) & fits)
    return met.select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"))


def few_missing(a: Column, b: Column) -> Column:
    """Whether at most as many edits lie between two titles as ratio SIMILAR allows; counting ends where there are more."""
    return F.call_function("levenshtein", a, b, missing_at_most(F.length(a) + F.length(b))) >= 0


def _led_alike(a: str, b: str) -> int:
    """How many first characters of two texts are the same."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def in_common(a: str, b: str) -> int:
    """The most characters that two texts share in one order; bits of `free` are a's places that no character of b is matched with."""
    first = _led_alike(a, b)
    a, b = a[first:], b[first:]
    last = _led_alike(a[::-1], b[::-1])
    a, b = a[: len(a) - last], b[: len(b) - last]
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every = free = (1 << len(a)) - 1
    for c in b:
        if hit := free & where.get(c, 0):
            free = (free + hit) | (free - hit)
    return first + last + len(a) - (free & every).bit_count()


@F.udf(T.BooleanType(), useArrow=True)
def enough_in_common(a: str | None, b: str | None) -> bool | None:
    """Whether two titles miss at most as many characters of each other as ratio SIMILAR allows."""
    return None if a is None or b is None else len(a) + len(b) - 2 * in_common(a, b) <= int((1 - SIMILAR) * (len(a) + len(b)) + 1e-6)


def verified(met: DataFrame, left: DataFrame, right: DataFrame, alike=None) -> DataFrame:
    """The pairs that miss few characters of each other, with their names; of these, where given, those for which alike(right name, left name).

    That is no more than ratio SIMILAR allows, so a pair that stays has its ratio taken. Edits would not do, as one that
    replaces a character counts once, but misses two.
    """
    names = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name")).hint("merge")
    named = met.join(names(left, "left"), "left_id").join(names(right, "right"), "right_id")
    enough = enough_in_common("left_name", "right_name")
    if alike is not None:  # one inside the other, or else both would be asked of all pairs at once
        enough = alike(F.when(enough, F.col("right_name")), F.col("left_name"))
    return named.where(enough).select("left_id", "left_name", "right_id", "right_name")


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """candidates() that miss few characters of each other, with their names: (left_id, left_name, right_id, right_name)."""
    met = candidates(left, right, keys)
    out = stored(verified(met, left, right))
    discard(met)
    return out


def first_near(left: DataFrame, right: DataFrame, keys: list[str], alike) -> DataFrame:
    """(left_id, right_id): the near-identical right title of the least id below each left row's limit, where there is one.

    alike(right name, left name) decides, which a null name is to fail. Titles of a large group of near ones find one of its first members by the leaders
    of their pieces; after that only what comes before it is looked at, so the pairs of such a group are not gone through.
    """
    sides = Prepared(left, right, keys, both=True)
    least = lambda met: stored(verified(met, sides.left, sides.right, alike).groupBy("left_id").agg(F.min("right_id").alias("right_id")))
    early = least(met_by_leaders(sides))
    limits = sides.left.select("id", "limit").join(early.withColumnRenamed("left_id", "id"), "id", "left").select("id", F.coalesce("right_id", "limit").alias("limit"))
    limits = stored(limits)
    met = stored(met_by_pieces(sides, limits))
    late = least(met)
    out = stored(early.union(late).groupBy("left_id").agg(F.min("right_id").alias("right_id")))
    sides.discard()
    discard(early, limits, met, late)
    return out
