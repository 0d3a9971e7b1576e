"""The entity index against identity resolution of all records at once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import identity
from paperloom.operators.entity_index import EntityIndex
from paperloom.sources.commits import Commits, Conflict
from tests.helpers import papers


def records(seed, n):
    rng = random.Random(seed)
    base = "deep learning for citation forecasting in large networks of "
    title = lambda: rng.choice([base + rng.choice(["papers", "paper", "texts", "authors"]), base + "papers part " + rng.choice("12"), "introduction", f"a title of its own number {rng.randint(0, 40)}", None, ""])
    return [{"title": title() or "", "year": rng.choice([None, 2001, 2002, 2010]), "doi": f"10.1/{rng.randint(0, 30)}" if rng.random() < 0.3 else None, "s2_id": f"s{rng.randint(0, 40)}" if rng.random() < 0.3 else None, "venue": rng.choice([None, "arXiv", "KDD"]), "citation_count": rng.randint(0, 9)} for _ in range(n)]


def as_sets(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1])
def test_upserts_equal_dedup_of_all(spark, tmp_path, seed):
    rows = records(seed, 90)
    whole = papers(spark, *rows)
    index = EntityIndex(spark, str(tmp_path / "index")).build(whole.where("seq < 50"), buckets=8)
    for low, high in ((50, 51), (51, 90)):
        before = {r.seq for r in index.merged().select("seq").collect()}
        changed, added = index.upsert(whole.where(F.col("seq").between(low, high - 1)))
        want = identity.groups(whole.where(F.col("seq") < high))
        assert as_sets(index.records().select("seq", "gid")) == as_sets(want.select("seq", "gid"))
        merged = identity.merge_groups(want)
        assert as_sets(index.merged()) == as_sets(merged)
        assert added == merged.where(F.col("seq") >= low).count()
        # What changed is told, and nothing else has.
        told = {r.seq for r in changed.select("seq").collect()}
        assert {r.seq for r in merged.select("seq").collect()} - before <= told
        assert as_sets(changed) == as_sets(merged.join(spark.createDataFrame([(s,) for s in told], "seq long"), "seq", "left_semi"))
    index.vacuum()
    again = EntityIndex(spark, str(tmp_path / "index"))
    assert as_sets(again.merged()) == as_sets(identity.dedup(whole))


def test_upsert_reads_touched_buckets_only(spark, tmp_path):
    """All files of other buckets are taken away; the upsert doesn't miss them."""
    whole = papers(spark, *({"title": f"an unlike title {chr(97 + i % 26) * 9} {i * i} {i}", "doi": f"10.1/{i}"} for i in range(400)))
    index = EntityIndex(spark, str(tmp_path / "index")).build(whole, buckets=64)
    new = papers(spark, {"title": "something that is new and long enough to count", "doi": "10.1/17"}, {"title": "short", "doi": "10.1/x"})
    keys = identity.keyed(new.unionByName(whole.where("seq = 17").withColumn("seq", F.lit(99).cast("long"))))
    from paperloom.operators import entity_index

    entries = entity_index._entries(keys.withColumn("gid", F.col("seq")))
    used = {("keys", b) for b in index._touched(entries, "key")} | {("records", b) for b in index._touched(spark.createDataFrame([(17,), (400,), (401,)], "gid long"), "gid")}
    gone = 0
    for table in ("records", "keys"):
        for path in index._paths(table):
            if (table, int(path.rsplit("=", 1)[1])) not in used:
                os.rename(path.removeprefix("file:"), path.removeprefix("file:") + ".gone")
                gone += 1
    assert gone > 80
    changed, added = index.upsert(new)
    assert {r.seq for r in changed.select("seq").collect()} == {17, 401} and added == 1
    kept = {p for t in ("records", "keys") for p in index._paths(t) if not os.path.exists(p.removeprefix("file:"))}
    assert len(kept) == gone  # the version still names them where they were


def test_second_writer_fails(spark, tmp_path):
    whole = papers(spark, {"doi": "10.1/a"}, {"doi": "10.1/b", "title": "x"})
    EntityIndex(spark, str(tmp_path / "index")).build(whole, buckets=2)
    one, two = (EntityIndex(spark, str(tmp_path / "index")) for _ in range(2))
    one.upsert(papers(spark, {"doi": "10.1/c", "title": "y"}))
    with pytest.raises(Conflict):
        two.upsert(papers(spark, {"doi": "10.1/d", "title": "z"}))
    assert EntityIndex(spark, str(tmp_path / "index")).records().count() == 3


def test_empty_index(spark, tmp_path):
    index = EntityIndex(spark, str(tmp_path / "index"))
    changed, added = index.upsert(papers(spark, {"doi": "10.1/a"}, {"doi": "10.1/a", "title": "other"}))
    assert added == 1 and changed.count() == 1 and index.records().count() == 2
    changed, added = index.upsert(papers(spark))
    assert added == 0 and changed.count() == 0 and index.merged().count() == 1


def test_commits(spark, tmp_path):
    a, b = Commits(spark, str(tmp_path / "c")), Commits(spark, str(tmp_path / "c"))
    assert a.latest() == (0, None)
    a.commit(1, {"x": "é"})
    with pytest.raises(Conflict):
        b.commit(1, {"x": 2})
    assert b.latest() == (1, {"x": "é"}) and b.versions() == [1]
