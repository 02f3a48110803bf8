from datetime import datetime

from svcgraph.streaming import limiter, stateful

from .conftest import rows


def test_limiter_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "calls")
    calls = spark.createDataFrame([("c", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 2, 9, 10, 11)], "channel string, ts timestamp")
    calls.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(calls.schema).parquet(source)
    query = limiter.limit_calls(stream, 10, 2).writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((t.second, ok) for t, ok in rows(spark.table("verdicts"), "ts", "allowed"))
    assert got == [(0, True), (1, True), (2, False), (9, False), (10, True), (11, True)]


def test_windows_and_bursts(spark, tmp_path):
    edits = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, 0, s), f"v{s}") for s in (0, 1, 5)], "key string, ts timestamp, value string")
    assert rows(limiter.debounced(edits), "value") == [("v1",), ("v5",)]
    entries = spark.createDataFrame([(1, datetime(2024, 1, 1, h), h) for h in (1, 5)], "repo_id int, ts timestamp, score int")
    assert rows(limiter.windowed_scores(entries), "best", "n") == [(5, 2)]


def test_limiter_with_list_state_and_timers(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("calls", "out", "cp"))
    for turn in ((0, 1, 2), (9, 10, 11), (50,)):  # a run of the stream each: what was accepted stays known, and goes with time
        calls = spark.createDataFrame([("c", datetime(2024, 1, 1, 0, 0, s)) for s in turn] + [(None, datetime(2024, 1, 1)), ("d", None)], "channel string, ts timestamp")
        calls.coalesce(1).write.mode("append").parquet(source)
        verdicts = stateful.limited_calls(spark.readStream.schema(calls.schema).parquet(source), 10, 2, "1 second")
        verdicts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = sorted((t.second, ok) for t, ok in rows(spark.read.schema(stateful.VERDICTS).parquet(out), "ts", "allowed"))
    assert got == [(0, True), (1, True), (2, False), (9, False), (10, True), (11, True), (50, True)]


def test_bounded_histories_survive_a_new_checkpoint(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda n: datetime(2024, 1, 1, n // 60, n % 60)
    for turn in range(2):
        entries = spark.createDataFrame([(1, at(60 * turn + i), i) for i in range(60)] + [(2, at(turn), turn), (None, at(0), 1)], "repo_id int, ts timestamp, score int")
        entries.coalesce(1).write.mode("append").parquet(source)
        stateful.keep_last(spark.readStream.schema(entries.schema).parquet(source), target, str(tmp_path / "a"), available_now=True).awaitTermination()
    kept = stateful.kept_history(spark, target)
    assert sorted((r.ts, r.score) for r in kept.where("repo_id = 1").collect()) == [(at(n), n % 60) for n in range(20, 120)] and rows(kept.where("repo_id = 2"), "score") == [(0,), (1,)]
    late = spark.createDataFrame([(1, at(500), 7)], "repo_id int, ts timestamp, score int")
    late.write.parquet(str(tmp_path / "more"))
    stateful.keep_last(spark.readStream.schema(late.schema).parquet(str(tmp_path / "more")), target, str(tmp_path / "b"), available_now=True).awaitTermination()
    after = stateful.compacted(spark, target, str(tmp_path / "compact"))
    assert sorted(r.ts for r in after.where("repo_id = 1").collect()) == [at(n) for n in (*range(21, 120), 500)] and after.where("repo_id = 2").count() == 2
