"""Places in a global order, without a task that sees all rows (SRC01, AGG03, AGG04, AGG06, AGG07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def dense_ranks(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place (from 0) in the order; equal rows take successive places.

    The range sort deals and numbers rows within partitions, which are written, so that the numbers stay; the partitions' counts, one
    small row each, become offsets by a prefix sum.
    """
    line, mask = F.monotonically_increasing_id(), (1 << 33) - 1  # (partition, place in it)
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_line", line), "ranks").withColumn("_part", F.shiftright("_line", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_line").bitwiseAND(mask)).drop("_part", "_base", "_line")


#: A row's place within its file has so many bits; a file of at most 1 MiB has fewer rows.
PLACE_BITS = 24


def walk_ranks(files: DataFrame) -> DataFrame:
    """repo_id, file, rank: files in the order of a walk that takes each folder's entries by name. Reads names, no contents."""
    paths = files.select("repo_id", F.col("path").alias("file")).distinct()
    return dense_ranks(paths.withColumn("_p", F.split("file", "/")), [F.col("repo_id"), F.col("_p")]).drop("_p")


def in_walk_order(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """rows (repo_id, file, at, ...) with ord, which follows the walk and then the place in the file, instead of at."""
    ord_ = F.shiftleft(F.col("rank"), PLACE_BITS) + F.col("at")
    return rows.join(ranks, ["repo_id", "file"]).withColumn("ord", ord_.cast("long")).drop("rank", "at")
