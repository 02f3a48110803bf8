"""Structured Streaming: call limits with bounded state, score history, and debounced edits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "recent string"
VERDICT = "channel string, ts timestamp, allowed boolean"


def limit_calls(calls: DataFrame, window_seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """WIN04 on a stream (channel, ts): one verdict a call. State is the accepted times in the window, `most` at most.

    A channel's state goes once the watermark is a window past its last accepted call. Calls that come later than
    `late` after the stream's latest one get no verdict.
    """
    import pandas as pd

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = [int(x) for x in state.get[0].split(",") if x] if state.exists else []
        times = pd.concat([b["ts"] for b in batches]).sort_values()
        micros, allowed = window_seconds * 1_000_000, []
        for t in times.astype("datetime64[us]").astype("int64").tolist():
            recent = [x for x in recent if t - x < micros]
            allowed.append(len(recent) < most)
            if allowed[-1]:
                recent.append(t)
        state.update((",".join(map(str, recent)),))
        state.setTimeoutTimestamp(max(max(recent or [t]) // 1000 + 1000 * window_seconds, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"channel": key[0], "ts": times.to_numpy(), "allowed": allowed})

    return calls.select("channel", "ts").withWatermark("ts", late).groupBy("channel").applyInPandasWithState(judge, VERDICT, STATE, "append", "EventTimeTimeout")


def windowed_scores(entries: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """History entries (repo_id, ts, score) by tumbling window; entries later than `late` are left out."""
    rows = entries.withWatermark("ts", late).groupBy("repo_id", F.window("ts", size)).agg(F.max("score").alias("best"), F.count("*").alias("n"))
    return rows.select("repo_id", F.col("window.start").alias("start"), "best", "n")


def debounced(edits: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """The last value of each burst of edits (key, ts, value): a session ends after `gap` without one."""
    rows = edits.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap)).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    return rows.select("key", "ts", "value")

