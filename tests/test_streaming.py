import datetime

from paperloom.operators import screening
from paperloom.streaming import results


def test_result_files_arrive_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "batch_001.result.jsonl").write_text('{"id": "a", "status": "core"}\n')
    (folder / "batch_001.jsonl").write_text('{"id": "not a result"}\n')

    def apply(batch, n):
        rows, _ = screening.results(batch.selectExpr("file", "0 as file_no", "0 as line", "value"))
        seen.extend(r.id for r in rows.collect())

    for _ in range(2):
        results.ingest(results.result_lines(spark, str(folder)), apply, str(tmp_path / "check")).awaitTermination(60)
        (folder / "batch_002.result.jsonl").write_text('{"id": "b", "status": "core"}\n')
    assert seen == ["a", "b"]


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    events = spark.createDataFrame([(1, at(0), "x", 1.0), (1, at(10), "x", 2.0), (1, at(100), "y", 3.0), (2, at(59), "x", 4.0)], "user_id long, ts timestamp, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events")
    batch = {tuple(r) for r in results.windowed_counts(events).collect()}
    assert {(r[2], r[3], r[4]) for r in batch} == {("x", 3, 7.0), ("y", 1, 3.0)}
    assert sorted(r.n for r in results.sessions(events).collect()) == [1, 1, 2]
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = results.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("windows").collect()} == batch
