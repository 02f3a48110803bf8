"""What is picked from repositories for a model: files in order of priority (SRT06), contents within a budget (AI07), a service's context (JN21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordering import walk_ranks

# Which files are looked at, which folders come first, and the bounds.
CODE = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs"]
FIRST = ["lib/", "libs/", "services/", "api/", "utils/", "helpers/", "src/lib/", "src/services/", "src/api/", "src/utils/", "middleware", "config", "client"]
FILES, LINES, CHARS, LEAST, MARK = 4, 100, 5000, 200, "\n[... truncated]"


def priority_files(files: DataFrame, most: int = FILES) -> DataFrame:
    """SRT06: repo_id, path, k: the first code files of each repository, those in known folders before others, else in the order of the walk.

    The bound on k is known before the shuffle: no task sorts a repository's files to the end.
    """
    code = files.where(F.regexp_extract("path", r"(?:^|/)[^/]+?(\.[^./]*)\z", 1).isin(CODE)).select("repo_id", "path").distinct()
    known = F.exists(F.array(*[F.lit(x) for x in FIRST]), lambda x: F.contains(F.col("path"), x))
    ranked = walk_ranks(code).withColumnRenamed("file", "path").withColumn("known", known)
    k = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("known"), "rank"))
    return ranked.withColumn("k", k).where(F.col("k") <= most).select("repo_id", "path", "k")


def first_lines(content: Column, most: int = LINES) -> Column:
    """A content's first lines, with a mark where there are more."""
    lines = F.split(content, "\n", -1)
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit(MARK))).otherwise(content)


def within_budget(files: DataFrame, most: int = CHARS, least: int = LEAST) -> DataFrame:
    """AI07: repo_id, path, ord, content: files in their order while their characters fit; the first one that doesn't is cut if over `least` remain, and ends the list.

    Prefix sums over lengths alone: a range sort by (repo_id, ord), sums of its partitions' shares of a repository, then running sums within a
    share. No task sees a repository's files whole, and contents are joined to what is kept only.
    """
    order = [F.col("repo_id"), F.col("ord"), F.col("path")]
    sizes = files.select("repo_id", "ord", "path", F.length("content").cast("long").alias("n")).where("n IS NOT NULL")
    dealt = written(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_line", F.monotonically_increasing_id()), "sizes").withColumn("_part", F.shiftright("_line", 33))
    shares = dealt.groupBy("repo_id", "_part").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("repo_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = shares.select("repo_id", "_part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base")).where(F.col("base") <= most)
    running = F.sum("n").over(Window.partitionBy("repo_id", "_part").orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = dealt.join(bases, ["repo_id", "_part"]).withColumn("end", F.col("base") + running)
    room = F.lit(most) - (F.col("end") - F.col("n"))
    kept = ends.withColumn("room", room).where((F.col("end") <= most) | (F.col("room") > least)).select("repo_id", "ord", "path", F.when(F.col("end") > most, F.col("room")).alias("room"))
    whole = files.select("repo_id", "path", "ord", "content").join(kept, ["repo_id", "ord", "path"])
    return whole.select("repo_id", "path", "ord", F.when(F.col("room").isNull(), F.col("content")).otherwise(F.concat(F.expr("left(content, CAST(room AS INT))"), F.lit(MARK))).alias("content"))


def with_context(services: DataFrame, contexts: DataFrame) -> DataFrame:
    """JN21: services with usage, level and warnings of the first context (by ord) for their id; null where there is none."""
    fields = F.struct("usage", "level", "warnings")
    first = contexts.groupBy("repo_id", F.col("service_id").alias("id")).agg(F.min_by(fields, "ord").alias("c"))
    return services.join(first, ["repo_id", "id"], "left").select(*services.columns, "c.usage", "c.level", "c.warnings")
