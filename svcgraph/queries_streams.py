"""Named queries that run a stream over files made from a table: written in two turns by time, each read by its own run of the stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import adapters as A
from .sources.shared import new_path
from .streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]


def in_turns(rows: DataFrame, start: Callable[[DataFrame], object]) -> None:
    """Writes rows (with ts) up to the middle of their time and runs the stream to its end, then the others, with the same state."""
    spark, folder = rows.sparkSession, new_path(rows.sparkSession, "stream")
    middle = rows.select(F.percentile_approx(F.unix_micros("ts"), 0.5).alias("m")).first()["m"]
    early = F.unix_micros("ts") <= F.lit(middle)
    for part in (rows.where(early), rows.where(~early)):
        part.write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


def limited(s: SparkSession, d: str) -> DataFrame:
    calls = A.table(s, d, "events").select(F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"))
    out, checkpoint = new_path(s, "verdicts"), new_path(s, "checkpoint")
    in_turns(calls, lambda stream: stateful.limited_calls(stream, 3600, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    verdicts = s.read.schema(stateful.VERDICTS).parquet(out)
    return verdicts.groupBy("channel").agg(F.count_if("allowed").alias("accepted"), F.count_if(~F.col("allowed")).alias("rejected"))


def last_entries(s: SparkSession, d: str) -> DataFrame:
    entries = A.adapted(s, d, A.HISTORY).select("repo_id", F.col("ts").cast("timestamp").alias("ts"), "score")
    out, checkpoint = new_path(s, "history"), new_path(s, "checkpoint")
    in_turns(entries, lambda stream: stateful.keep_last(stream, out, checkpoint, available_now=True))
    return stateful.kept_history(s, out).select("repo_id", "ts", "score")


QUERIES: dict[str, Query] = {"win04_stream": limited, "lim01_stream": last_entries}
