"""An inverted index over papers: postings with positions in buckets, and boolean queries that read only those of their terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import boolean
from paperloom.functions.text import _let, WORD
from paperloom.operators.search import _of_years, best_of, Queries, searched_text
from paperloom.sources.commits import Commits

#: Buckets of postings, and parts that a bucket's postings are dealt to, as one word may be a large share of all.
BUCKETS, PARTS = 64, 8
_POSTING = "token string, seq long, positions array<int>"


def folded(c: Column) -> Column:
    """Texts that a pattern takes for equal in any case have equal forms."""
    return F.translate(F.lower(F.upper(F.translate(c, "İẞ", "iß"))), "ς", "σ")


def tokens(c: Column) -> Column:
    """The runs of letters, digits and underscores of a text, in order."""
    return F.regexp_extract_all(folded(c), F.lit(f"{WORD}+"), F.lit(0))


def grouped_positions(said: Column) -> Column:
    """(token, positions) of the distinct ones of some tokens, by one sort of them where they are; null if there are none."""

    def grouped(pairs: Column) -> Column:
        token = lambda i: F.get(pairs, i)["token"]
        first = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: (i == 0) | (token(i) != token(i - 1)))
        places = lambda a, z: F.transform(F.slice(pairs, a + 1, z - a), lambda x: x["at"])
        return _let(first, lambda f: F.transform(f, lambda a, j: F.struct(token(a).alias("token"), places(a, F.coalesce(F.get(f, j + 1), F.size(pairs))).alias("positions"))))

    pairs = F.sort_array(F.transform(said, lambda t, i: F.struct(t.alias("token"), i.alias("at"))))
    return F.when(F.size(said) > 0, _let(pairs, grouped))


def _bucket(token: Column, buckets: int) -> Column:
    """By the first two characters, so that the words with a common start lie together."""
    return F.pmod(F.xxhash64(F.left(token, F.lit(2))), F.lit(buckets)).cast("int")


class TextIndex:
    """Postings of papers' titles and abstracts, in files by bucket and sorted by word."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.commits = spark, Commits(spark, folder)
        self.version, self.document = self.commits.latest()

    def build(self, corpus: DataFrame, buckets: int = BUCKETS) -> TextIndex:
        """Indexes the papers in place of whatever the folder holds."""
        said = corpus.select("seq", tokens(searched_text()).alias("said"))
        rows = said.select("seq", F.inline(grouped_positions(F.col("said")))).select("token", "seq", "positions")
        name = f"v{self.version + 1:08d}"
        dealt = rows.withColumn("bucket", _bucket(F.col("token"), buckets)).repartition("bucket", F.pmod(F.xxhash64("seq"), F.lit(PARTS)))
        dealt.sortWithinPartitions("bucket", "token", "seq").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.commits.folder}/{name}")
        self.commits.commit(self.version + 1, {"buckets": buckets, "postings": name})
        self.version, self.document = self.commits.latest()
        return self

    def postings(self, which: list[int] | None = None) -> DataFrame:
        """(token, seq, positions) of some buckets; files of others are not opened."""
        all_ = self.spark.read.schema(f"{_POSTING}, bucket int").parquet(f"{self.commits.folder}/{self.document['postings']}")
        return all_ if which is None else all_.where(F.col("bucket").isin(which))

    def _wanted(self, terms: list[str]) -> tuple[DataFrame | None, list[int], list[int]]:
        """What must be looked up for some terms: (term, place, token, prefix, size) rows, their buckets, and terms without words."""
        bare = [t.strip().strip('"').lower() for t in terms]
        asked = self.spark.createDataFrame([(i, b.rstrip("*"), b.endswith("*")) for i, b in enumerate(bare)], "term int, bare string, open boolean")
        rows, none = [], []
        ends = asked.select("term", "open", tokens(F.col("bare")).alias("tokens"), F.col("bare").rlike(f"{WORD}$").alias("word")).collect()  # as many as the queries have terms
        for r in ends:
            if not r.tokens:
                none.append(r.term)
            for place, token in enumerate(r.tokens):
                last = place == len(r.tokens) - 1 and r.word
                forms = [(token, True)] if last and r.open else [(token + more, False) for more in (("", "s", "es") if last else ("",))]
                rows += [(r.term, place, form, prefix, len(r.tokens)) for form, prefix in forms]
        if not rows:
            return None, [], none
        wanted = self.spark.createDataFrame(rows, "term int, place int, token string, prefix boolean, size int")
        if any(prefix and len(token) < 2 for _, _, token, prefix, _ in rows):
            return wanted, list(range(self.document["buckets"])), none
        return wanted, [r[0] for r in wanted.select(_bucket(F.col("token"), self.document["buckets"])).distinct().collect()], none

    def candidates(self, terms: list[str]) -> tuple[DataFrame, list[int]]:
        """(seq, term): papers whose words leave it open that they mention a term, by its number; and terms that have no words."""
        wanted, buckets, none = self._wanted(terms)
        if wanted is None:
            return self.spark.createDataFrame([], "seq long, term int"), none
        held = self.postings(buckets)
        own = wanted.select("term", "place", "size", F.col("token").alias("form"), "prefix")
        whole = held.join(F.broadcast(own.where("not prefix")), F.col("token") == F.col("form"))
        hits = whole.select("seq", "term", "place", "size", "positions")
        for n in (1, 2):  # words with a common start meet by its first two characters, or its only one
            some = own.where("prefix").where(F.length("form") >= 2 if n == 2 else F.length("form") == 1)
            met = held.join(F.broadcast(some), (F.left("token", F.lit(n)) == F.left("form", F.lit(n))) & F.startswith("token", F.col("form")))
            hits = hits.unionByName(met.select("seq", "term", "place", "size", "positions"))
        single = hits.where("size = 1").select("seq", "term")
        # Words of a phrase follow each other.
        starts = hits.where("size > 1").select("seq", "term", "size", "place", F.explode("positions").alias("at"))
        phrases = starts.groupBy("seq", "term", "size", (F.col("at") - F.col("place")).alias("start")).agg(F.count_distinct("place").alias("n")).where("n = size")
        return single.union(phrases.select("seq", "term")).distinct(), none

    def search_many(self, corpus: DataFrame, queries: dict[str, str], limit: int | None = 100, *, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
        """search_many() of the corpus that was indexed: (query, seq, score), read from the postings of the queries' words.

        Texts of papers that may mention a term are read once and tested for those terms alone; what is found is exact. Only
        queries that hold for papers without any term, and terms without a letter or digit, take all papers.
        """
        asked = Queries(queries)
        found, none = self.candidates(asked.terms)
        papers = _of_years(corpus, year_min, year_max).select("seq", "citation_count", searched_text().alias("_text"))
        if none:
            found = found.union(papers.select("seq", F.explode(F.array(*map(F.lit, none))).alias("term")))
        patterns = self.spark.createDataFrame([(i, boolean.term_pattern(t)) for i, t in enumerate(asked.terms)], "term int, pattern string")
        open_ = found.groupBy("seq").agg(F.collect_set("term").alias("open"))
        tested = papers.join(open_, "seq").select("seq", "citation_count", "_text", F.explode("open").alias("term")).join(F.broadcast(patterns), "term").where(F.expr("regexp_like(_text, pattern)"))
        said = tested.groupBy("seq").agg(F.first("citation_count").alias("citation_count"), F.collect_set("term").alias("_said"))
        if asked.without_terms():
            said = papers.select("seq", "citation_count").join(said.select("seq", "_said"), "seq", "left")
        place = {t: i for i, t in enumerate(asked.terms)}
        hits = said.select("seq", "citation_count", F.explode(asked.hits(lambda t: F.coalesce(F.array_contains("_said", place[t]), F.lit(False)))).alias("h"))
        return best_of(hits.select("h.query", "seq", "h.score", "citation_count"), limit).select("query", "seq", "score")
