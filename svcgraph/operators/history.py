"""Score history and call limits: AGG16, WIN01, WIN02, WIN04, LIM01."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def kept(history: DataFrame, most: int = rules.HISTORY_KEPT) -> DataFrame:
    """LIM01: the latest entries of each repository, by (ts, score)."""
    k = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("ts"), F.desc("score")))
    return history.withColumn("k", k).where(F.col("k") <= most).drop("k")


def stats(history: DataFrame) -> DataFrame:
    """AGG16/WIN02: min, max, rounded mean, latest, and its difference from the first."""
    order = F.struct("ts", "score")
    made = history.groupBy("repo_id").agg(F.min("score").alias("lowest"), F.max("score").alias("highest"), F.floor(F.avg("score") + 0.5).cast("int").alias("mean"), F.max_by("score", order).alias("latest"), F.min_by("score", order).alias("first"), F.count("*").alias("n"))
    return made.withColumn("change", F.col("latest") - F.col("first"))


def trend(history: DataFrame) -> DataFrame:
    """WIN01: each entry with the difference from the one before (null for the first)."""
    order = Window.partitionBy("repo_id").orderBy("ts", "score")
    return history.withColumn("delta", F.col("score") - F.lag("score").over(order))


def accepted_calls(calls: DataFrame, window_seconds: int, most: int) -> DataFrame:
    """WIN04: channel, accepted, rejected under a limit on accepted calls in a sliding window.

    Whether a call counts depends on those accepted before it, so calls are read in order of time; but nothing
    before a pause of a whole window matters. Calls of one window-wide bucket are never that far apart, so the pauses show
    in each bucket's first and last call, and what lies between two pauses is a task's work of its own, however busy the channel.
    A task streams through its part and holds only the accepted times still in the window, `most` at the most.
    Null channels and times take no part.
    """
    import pyarrow as pa

    micros = window_seconds * 1_000_000

    def run(batches):
        counts: dict[str, list[int]] = {}
        channel, recent = None, []
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != channel:
                    channel, recent = name, []
                    counts.setdefault(name, [0, 0])
                recent = [x for x in recent if t - x < micros]
                if len(recent) < most:
                    recent.append(t)
                    counts[name][0] += 1
                else:
                    counts[name][1] += 1
            if len(counts) > 10_000:
                done = {k: counts.pop(k) for k in list(counts) if k != channel}
                yield pa.RecordBatch.from_pydict({"channel": list(done), "accepted": [v[0] for v in done.values()], "rejected": [v[1] for v in done.values()]})
        if counts:
            yield pa.RecordBatch.from_pydict({"channel": list(counts), "accepted": [v[0] for v in counts.values()], "rejected": [v[1] for v in counts.values()]})

    timed = calls.where("channel IS NOT NULL AND ts IS NOT NULL").select("channel", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    timed = timed.withColumn("bucket", F.col("t") - F.pmod("t", F.lit(micros)))
    order = Window.partitionBy("channel").orderBy("bucket")
    edges = timed.groupBy("channel", "bucket").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    pause = F.coalesce(F.col("first") - F.lag("last").over(order) >= micros, F.lit(True))
    parts = edges.withColumn("part", F.when(pause, F.col("bucket"))).withColumn("part", F.max("part").over(order)).select("channel", "bucket", "part")
    dealt = timed.join(parts, ["channel", "bucket"]).repartition("channel", "part").sortWithinPartitions("channel", "t")
    return dealt.select("channel", "t").mapInArrow(run, "channel string, accepted long, rejected long").groupBy("channel").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
