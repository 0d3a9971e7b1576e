"""Searches over local corpora: boolean queries, several sources, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import boolean


def searched_text() -> Column:
    """What queries are about: title and abstract."""
    return F.concat(F.col("title"), F.lit(" "), F.coalesce("abstract", F.lit("")))


def search(corpus: DataFrame, query: str, limit: int | None = 100, *, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """Papers whose title or abstract satisfies a boolean query, with score: those that mention most of its terms first.

    Ties go to the more cited paper, then to the first; the limit is a top-k over partitions, not a sort of all matches.
    """
    text = searched_text()
    found = _of_years(corpus, year_min, year_max).where(boolean.evaluate(query, text)).withColumn("score", boolean.score(query, text))
    return found.orderBy(F.desc("score"), F.coalesce("citation_count", F.lit(0)).desc(), "seq").limit(limit) if limit else found


def _of_years(corpus: DataFrame, year_min: int | None, year_max: int | None) -> DataFrame:
    for bound, fits in ((year_min, F.col("year") >= year_min if year_min else None), (year_max, F.col("year") <= year_max if year_max else None)):
        if bound:
            corpus = corpus.where(fits)
    return corpus


class Queries:
    """Several boolean queries and the distinct terms of all of them."""

    def __init__(self, queries: dict[str, str]):
        self.trees = {name: boolean.parse(q, strict=True) for name, q in queries.items()}
        self.own = {name: list(dict.fromkeys(t.text for t in boolean.tokenize(q) if t.operand)) for name, q in queries.items()}
        self.terms = list(dict.fromkeys(t for own in self.own.values() for t in own))

    def holds(self, name: str, mentioned) -> Column | bool:
        """A query's tree over mentioned(term), a column or a truth."""

        def test(n: boolean.Node):
            if not n.parts:
                return mentioned(n.text)
            tests = [test(p) for p in n.parts]
            if n.kind == "not":
                return ~tests[0] if isinstance(tests[0], Column) else not tests[0]
            return reduce((lambda a, b: a | b) if n.kind == "or" else (lambda a, b: a & b), tests)

        return test(self.trees[name]) if self.trees[name] else False

    def without_terms(self) -> bool:
        """Whether a text that mentions no term satisfies some query."""
        return any(self.holds(name, lambda _: False) for name in self.trees)

    def hits(self, mentioned) -> Column:
        """(query, score) of each query that holds, as an array."""
        one = []
        for name, own in self.own.items():
            test = self.holds(name, mentioned)
            if isinstance(test, Column):
                one.append(F.when(test, F.struct(F.lit(name).alias("query"), reduce(Column.__add__, (mentioned(t).cast("int") for t in own)).alias("score"))))
        return F.array_compact(F.array(*one)) if one else F.array().cast("array<struct<query:string,score:int>>")


def best_of(found: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of each query; what can't be among them is dropped before the shuffle."""
    if not limit:
        return found
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.coalesce("citation_count", F.lit(0)).desc(), "seq")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def search_many(corpus: DataFrame, queries: dict[str, str], limit: int | None = 100, *, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """search() for several queries in one pass over the corpus: its rows with query and score, each term tested once a paper."""
    asked = Queries(queries)
    place = {t: i for i, t in enumerate(asked.terms)}
    text = searched_text()
    tested = _of_years(corpus, year_min, year_max).withColumn("_said", F.array(*(boolean.mentions(text, t) for t in asked.terms)).cast("array<boolean>"))
    found = tested.withColumn("_hit", F.explode(asked.hits(lambda t: F.get("_said", F.lit(place[t])))))
    return best_of(found.select(*corpus.columns, "_hit.query", "_hit.score"), limit)


def fan_out(corpora: dict[str, DataFrame], queries: dict[str, str], limit: int = 100, **years) -> DataFrame:
    """Each query over each source, with provenance search:<source>:<query>; records may be found repeatedly. Each source is read once."""
    parts = [search_many(corpus, queries, limit, **years).withColumn("found_via", F.array(F.concat(F.lit(f"search:{source}:"), "query"))) for source, corpus in corpora.items()]
    return reduce(DataFrame.unionByName, parts).drop("query")


def seed(corpora: list[DataFrame], queries: dict[str, str], limit: int = 20, **years) -> DataFrame:
    """Natural-language queries: for each the answer of the first source that has any, with provenance seed:<query>. Each source is read once."""
    words = {name: boolean.keywords(boolean.to_plain(query)) for name, query in queries.items()}
    parts = [search_many(corpus, words, limit, **years).withColumn("source_rank", F.lit(rank)) for rank, corpus in enumerate(corpora)]
    best = F.min("source_rank").over(Window.partitionBy("query"))  # at most queries x sources x limit rows
    found = reduce(DataFrame.unionByName, parts).withColumn("_best", best).where("source_rank = _best")
    return found.withColumn("found_via", F.array(F.concat(F.lit("seed:"), "query"))).drop("_best", "query", "source_rank")
