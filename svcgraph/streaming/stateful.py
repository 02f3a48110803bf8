"""Streams with list state and timers: the call limiter (WIN04) and bounded score histories (LIM01, SNK10).

State lies in the RocksDB store of the checkpoint, partitioned by key; a key holds a bounded list. Rows of one key in one micro-batch are sorted in
memory, so a source bounds its micro-batches (maxFilesPerTrigger or the like).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import rules
from ..operators import history

VERDICTS = "channel string, ts timestamp, allowed boolean"
ENTRIES = "repo_id int, ts timestamp, score int"


def with_state_store(spark: SparkSession) -> None:
    """These operators need the RocksDB store; streams that are started later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CallLimit(StatefulProcessor):
    """WIN04: a call is allowed while fewer than `most` accepted calls lie within the window before it.

    The list holds the accepted times in the window, `most` at most. A timer a window past the last accepted call clears it, so idle channels hold nothing.
    """

    def __init__(self, window_seconds: int, most: int) -> None:
        self.micros, self.most = window_seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "t long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        times = pd.concat([r["ts"] for r in rows]).dropna().sort_values()
        allowed = []
        for t in times.astype("datetime64[us]").astype("int64").tolist():
            recent = [x for x in recent if t - x < self.micros]
            allowed.append(len(recent) < self.most)
            if allowed[-1]:
                recent.append(t)
        if recent:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer((recent[-1] + self.micros) // 1000 + 1)
            self.recent.put([(x,) for x in recent])
        yield pd.DataFrame({"channel": key[0], "ts": times.to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


class LastEntries(StatefulProcessor):
    """LIM01: the last `most` entries of a repository; each micro-batch that adds some emits the whole list anew. Lists that nothing is added to go after `ttl_ms`."""

    def __init__(self, most: int, ttl_ms: int | None = None) -> None:
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "t long, score int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        kept = [tuple(x) for x in self.entries.get()] if self.entries.exists() else []
        new = pd.concat(list(rows))
        micros = new["ts"].astype("datetime64[us]").astype("int64")
        kept = sorted([*kept, *zip(micros.tolist(), (int(x) for x in new["score"]), strict=True)])[-self.most :]
        self.entries.put(kept)
        yield pd.DataFrame({"repo_id": pd.Series([key[0]] * len(kept), dtype="int32"), "ts": pd.to_datetime([t for t, _ in kept], unit="us"), "score": pd.Series([s for _, s in kept], dtype="int32")})

    def close(self) -> None:
        pass


def limited_calls(calls: DataFrame, window_seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """VERDICTS, one for each call (channel, ts) of a stream; calls that come later than `late` get none, null channels and times neither."""
    with_state_store(calls.sparkSession)
    timed = calls.where("channel IS NOT NULL AND ts IS NOT NULL").select("channel", "ts").withWatermark("ts", late)
    return timed.groupBy("channel").transformWithStateInPandas(CallLimit(window_seconds, most), VERDICTS, "append", "eventTime")


def keep_last(entries: DataFrame, path: str, checkpoint: str, most: int = rules.HISTORY_KEPT, ttl_ms: int | None = None, available_now: bool = False) -> StreamingQuery:
    """SNK10/LIM01 on a stream of (repo_id, ts, score): histories of bounded length, below path by query and batch.

    A batch that runs again replaces itself; another checkpoint is another query, whose batches lie beside those of the first, so nothing older is overwritten.
    """
    spark = entries.sparkSession
    with_state_store(spark)
    kept = entries.where("repo_id IS NOT NULL AND ts IS NOT NULL AND score IS NOT NULL").select("repo_id", "ts", "score").groupBy("repo_id").transformWithStateInPandas(LastEntries(most, ttl_ms), ENTRIES, "update", "none" if ttl_ms is None else "processingTime")

    def store(batch: DataFrame, n: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").parquet(f"{path}/query={query}/batch={n}")

    started = kept.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if available_now else started).start()


def kept_history(spark: SparkSession, path: str) -> DataFrame:
    """What keep_last() has kept: of each query a repository's latest list, of all of them the last entries."""
    rows = spark.read.option("basePath", path).parquet(path)
    latest = rows.groupBy("query", "repo_id").agg(F.max("batch").alias("batch"))
    return history.kept(rows.join(latest, ["query", "repo_id", "batch"]).select("repo_id", "ts", "score"))


def compacted(spark: SparkSession, path: str, target: str) -> DataFrame:
    """kept_history(), written to a new folder that can take the old one's place once no query writes there."""
    kept_history(spark, path).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
