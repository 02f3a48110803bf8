"""GR05: layers of all repositories' graphs at once: longest-path ranks, and the order within a rank by barycentres."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordering import dense_ranks


def inner_depths(nodes: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """repo_id, source, deep: of the nodes that lead somewhere, those that a path from a node that nothing leads to reaches, and the length (below `most`) of the longest one.

    Only these nodes and the links between them are walked, a distinct node a depth, so that the many nodes at the ends take no part.
    """
    inner = written(links.select("repo_id", F.col("source").alias("id")).distinct(), "inner")
    between = written(links.join(inner.withColumnRenamed("id", "target"), ["repo_id", "target"]).select("repo_id", "source", "target"), "between")
    starts = inner.join(between.select("repo_id", F.col("target").alias("id")).distinct(), ["repo_id", "id"], "left_anti")
    now = written(nodes.select("repo_id", "id").join(starts, ["repo_id", "id"]).distinct(), "depth")
    met = [now.withColumn("depth", F.lit(0))]
    for depth in range(1, most):
        now = written(between.join(now.withColumnRenamed("id", "source"), ["repo_id", "source"]).select("repo_id", F.col("target").alias("id")).distinct(), "depth")
        if not now.limit(1).count():
            break
        met.append(now.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, met).groupBy("repo_id", F.col("id").alias("source")).agg(F.max("depth").alias("deep"))


def ranks(nodes: DataFrame, edges: DataFrame, most: int = 32) -> DataFrame:
    """repo_id, id, rank: the length of the longest path to a node from one that nothing leads to; paths end after `most` edges.

    Nodes on a cycle that nothing leads to have no such path and rank 0.
    """
    links = edges.where("source <> target").select("repo_id", "source", "target").distinct()
    deep = inner_depths(nodes, links, most)
    found = links.join(deep, ["repo_id", "source"]).groupBy("repo_id", F.col("target").alias("id")).agg((F.max("deep") + 1).alias("rank"))
    return nodes.select("repo_id", "id").distinct().join(found, ["repo_id", "id"], "left").select("repo_id", "id", F.coalesce("rank", F.lit(0)).alias("rank"))


def layered(nodes: DataFrame, edges: DataFrame, most: int = 32) -> DataFrame:
    """repo_id, id, rank, place: places (from 0) within a repository's rank by the mean place of the nodes that lead there from lower ranks, then id.

    One range sort a rank, of which there are `most` + 1 at the most; nodes that nothing leads to come first, by id. An edge is read
    for its target's rank alone, and only places of nodes that lead somewhere are kept for later ranks.
    """
    edges = written(edges.select("repo_id", "source", "target").distinct(), "edges")
    nodes = written(nodes.select("repo_id", "id").distinct(), "nodes")
    ranked = written(ranks(nodes, edges, most), "layers")
    into = written(edges.join(ranked.withColumnRenamed("id", "target"), ["repo_id", "target"]).select("repo_id", "source", F.col("target").alias("id"), "rank"), "into")
    inner = written(edges.select("repo_id", "source").distinct(), "inner")
    deepest = ranked.agg(F.max("rank")).first()[0]
    done: list[DataFrame] = []
    before: list[DataFrame] = []
    for k in range(0 if deepest is None else deepest + 1):
        own = ranked.where(F.col("rank") == k)
        if before:
            places = reduce(DataFrame.unionByName, before)
            means = into.where(F.col("rank") == k).join(places, ["repo_id", "source"]).groupBy("repo_id", "id").agg(F.avg("place").alias("mean"))
            own = own.join(means, ["repo_id", "id"], "left")
        else:
            own = own.withColumn("mean", F.lit(0.0))
        at = dense_ranks(own, [F.col("repo_id"), F.col("mean").asc_nulls_first(), F.col("id")], "at")
        first = at.groupBy("repo_id").agg(F.min("at").alias("first"))
        done.append(at.join(first, "repo_id").select("repo_id", "id", "rank", (F.col("at") - F.col("first")).alias("place")))
        if k < deepest:
            before.append(written(done[-1].select("repo_id", F.col("id").alias("source"), "place").join(inner, ["repo_id", "source"]), "places"))
    return reduce(DataFrame.unionByName, done) if done else ranked.withColumn("place", F.lit(0).cast("long"))
