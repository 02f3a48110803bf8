"""Stopping one of several running plans: what a thread starts under a job tag ends when the tag is cancelled.

Job tags of the Spark context are used, not interruptTag of the session: in a classic session the latter reaches only what was tagged by
the calling thread itself, and whoever cancels a scan is another thread than the one that runs it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs of this thread within the block carry the tag; other tags of the thread stay."""
    context = spark.sparkContext
    new = tag not in context.getJobTags()
    if new:
        context.addJobTag(tag)
    try:
        yield
    finally:
        if new:
            context.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends all running jobs under the tag, in whatever thread; their actions fail, and others go on."""
    spark.sparkContext.cancelJobsWithTag(tag)
