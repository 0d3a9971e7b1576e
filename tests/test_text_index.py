"""Searches with many queries in one pass and from the inverted index, against one search for each query."""

import os
import random

from pyspark.sql import functions as F

from paperloom.operators import search
from paperloom.operators.text_index import TextIndex
from tests.helpers import papers

WORDS = ["network", "networks", "Net-work", "c++", "C", "state-of-the-art", "state of", "the", "art", "ISTANBUL", "İstanbul", "straße", "STRASSE", "Σίσυφος", "kelvin", "Kelvin", "a1_b", "boxes", "box", "of", "§§", "漢字"]
QUERIES = ["network", "net*", "c++", '"state of the art"', '"of the"', "straße", "strasse", "istanbul", "σίσυφοσ*", "kelvin OR box", "box AND NOT network", "NOT the", "§§", '"the art" OR (box AND n*)', "a1_b", "漢字", "c", "k*"]


def corpus(spark, n=150):
    rng = random.Random(8)
    say = lambda most: rng.choice([" ", "  ", "-", ", "]).join(rng.choice(WORDS) for _ in range(rng.randint(0, most)))
    return papers(spark, *({"title": say(6), "abstract": rng.choice([None, say(12)]), "year": rng.choice([None, 1999, 2005, 2010]), "citation_count": rng.choice([None, 0, 4, 9])} for _ in range(n)))


def told(df):
    return sorted(tuple(r) for r in df.select("query", "seq", "score").collect())


def one_by_one(p, limit, **years):
    out = []
    for i, q in enumerate(QUERIES):
        out += [(f"q{i}", r.seq, r.score) for r in search.search(p, q, limit, **years).select("seq", "score").collect()]
    return sorted(out)


def test_many_queries_equal_single_ones(spark, tmp_path):
    p = corpus(spark).cache()
    asked = {f"q{i}": q for i, q in enumerate(QUERIES)}
    index = TextIndex(spark, str(tmp_path / "index")).build(p, buckets=16)
    want = one_by_one(p, None)
    assert len({q for q, *_ in want}) == len(QUERIES)
    assert told(search.search_many(p, asked, None)) == want == told(index.search_many(p, asked, None))
    short = one_by_one(p, 7, year_min=2000)
    assert told(search.search_many(p, asked, 7, year_min=2000)) == short == told(TextIndex(spark, str(tmp_path / "index")).search_many(p, asked, 7, year_min=2000))
    p.unpersist()


def test_index_opens_the_buckets_of_a_query_only(spark, tmp_path):
    p = corpus(spark, 60)
    index = TextIndex(spark, str(tmp_path / "index")).build(p, buckets=32)
    _, buckets, _ = index._wanted(["kelvin", "box*"])
    folder = tmp_path / "index" / index.document["postings"]
    for name in os.listdir(folder):
        if name.startswith("bucket=") and int(name[7:]) not in buckets:
            for file in os.listdir(folder / name):
                (folder / name / file).write_bytes(b"no parquet")
    asked = {"a": "kelvin", "b": "box* AND kelvin"}
    assert told(index.search_many(p, asked, None)) == told(search.search_many(p, asked, None)) != []


def test_one_scan_a_source(spark, tmp_path):
    corpus(spark, 20).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    found = search.fan_out({"one": p, "two": p}, {f"q{i}": q for i, q in enumerate(QUERIES)}, 5)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert {r.found_via[0].split(":")[1] for r in found.collect()} == {"one", "two"}


def test_search_of_nothing(spark):
    p = corpus(spark, 5)
    assert search.search_many(p, {"q": ""}, 5).count() == 0 and search.search_many(p.where(F.lit(False)), {"q": "NOT x"}, 5).count() == 0
