"""Named queries over data sources and stored tables: recorded logs and answers, documents written in parts, migrated configurations."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_more as M
from .operators import facts, graph, health, history, layout, parsers, prompts, reports
from .operators.ordering import dense_ranks
from .sources import adapters as A
from .sources import file_adapter as T
from .sources import recorded, repo, stored
from .sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]


def logs(s: SparkSession, d: str) -> DataFrame:
    """The commits of events as logs of a folder a repository, read back; a filter on the repositories opens only their folders."""
    folder = new_path(s, "logs")
    commits = A.adapted(s, d, A.COMMIT).withColumn("value", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit("\n\n"), "file", F.lit("\n")))
    commits.select("repo_id", "value").write.partitionBy("repo_id").text(folder)
    recorded.register(s)
    return s.read.format("git_log").load(folder).where("repo_id IN (1, 4, 7, 12)")


def answers(s: SparkSession, d: str) -> DataFrame:
    """Recorded answers for a third of the dependencies, 50 queries each, read back."""
    folder = new_path(s, "answers")
    known = M.advisories(s, d).groupBy("advisory_ecosystem", "name", "version").agg(F.array_sort(F.collect_list(F.struct("at", "id", "summary", "scores"))).alias("a"))
    query = F.struct(F.struct("name", F.col("advisory_ecosystem").alias("ecosystem")).alias("package"), "version")
    found = F.transform("a", lambda x: F.struct(x["id"].alias("id"), x["summary"].alias("summary"), x["scores"].alias("severity")))
    batched = known.withColumn("batch", F.concat(F.lit("b"), F.pmod(F.xxhash64("advisory_ecosystem", "name", "version"), F.lit(40)).cast("string")))
    packed = batched.groupBy("batch").agg(F.to_json(F.struct(F.collect_list(query).alias("queries"), F.collect_list(F.struct(found.alias("vulns"))).alias("results"))).alias("value"))
    packed.select("batch", "value").write.partitionBy("batch").text(folder)
    recorded.register(s)
    return s.read.format("advisory_answers").load(folder).where("ok").drop("batch", "ok", "error")


def documents(s: SparkSession, d: str) -> DataFrame:
    """The reports, written as documents in ordered parts, as numbered lines read back."""
    from . import queries

    folder = new_path(s, "documents")
    lines = queries.QUERIES["snk02_markdown"](s, d)
    recorded.write_documents(lines, "repo_id", reports.LINE_ORDER[1:], folder, 7)
    back = recorded.read_documents(s, folder).select("document", "place", F.posexplode(F.split(F.expr("left(text, length(text) - 1)"), "\n")).alias("at", "line"))
    ranked = dense_ranks(back, [F.col("document"), F.col("place"), F.col("at")])
    first = ranked.groupBy("document").agg(F.min("rank").alias("first"))
    return ranked.join(first, "document").select("document", (F.col("rank") - F.col("first")).alias("n"), "line")


def bodies(s: SparkSession, d: str) -> DataFrame:
    """Stored configurations of three versions, and some that nothing can read."""

    def filled(template: str) -> Column:
        columns = {"§p": "p_size", "§k": "p_partkey"}
        return F.concat(*[F.col(columns[x]).cast("string") if x in columns else F.lit(x) for x in re.split("(§[pk])", template)])

    nodes = '{"id":"svc-s§p","data":{"label":"S§p","nodeType":"database"}},{"id":"n§k","data":{"label":"N"}}'
    services, graph = '[{"id":"s§p","name":"S§p","category":"email"},{"id":"x","name":"X"}]', '{"nodes":[' + nodes + '],"edges":[{"source":"n§k","target":"svc-s§p","type":"data"}]}'
    kinds = ['{"version":"0","items":' + services + ',"flow":' + graph + "}", '{"services":' + services + ',"graph":' + graph + "}", "{oops", "[1]", '{"version":"1","services":' + services + ',"graph":' + graph + "}"]
    body = F.lit(None).cast("string")
    for k, template in enumerate(kinds):
        body = F.when(F.col("p_partkey") % 5 == k, filled(template)).otherwise(body)
    # dealt to tasks by key: the part table is one row group, and a body takes long to parse
    return A.table(s, d, "part").repartition("p_partkey").select(F.col("p_partkey").alias("repo_id"), body.alias("body"))


def migrated(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return stored.migrated(bodies(s, d), [stored.renamed("0", "1", {"items": "services", "flow": "graph"})])


def imported(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return stored.imported_graph(migrated(s, d)[0])


def texts(s: SparkSession, d: str) -> DataFrame:
    """The documents as files of fifty repositories."""
    return A.table(s, d, "documents").select((F.col("doc_id") % 50).cast("int").alias("repo_id"), F.concat(F.lit("p"), "doc_id").alias("path"), F.col("doc_id").alias("ord"), prompts.first_lines(F.col("text"), 5).alias("content"))


def contexts(s: SparkSession, d: str) -> DataFrame:
    some = M.services(s, d).where("ord % 3 = 0").select("repo_id", F.col("id").alias("service_id"), F.explode(F.array(F.lit(2), F.lit(1))).alias("ord"))
    return some.select("*", F.concat(F.lit("u"), "ord").alias("usage"), F.lit("optional").alias("level"), F.lit("").alias("warnings"))


def mixed_case(s: SparkSession, d: str) -> DataFrame:
    return M.deps(s, d).withColumn("name", F.when(F.col("ord") % 2 == 0, F.upper("name")).otherwise(F.col("name")))


def graph_layers(s: SparkSession, d: str) -> DataFrame:
    services = graph.prepared(M.services(s, d))
    return layout.layered(graph.nodes(services.select("repo_id").distinct(), services), graph.edges(services))


def snapshot(s: SparkSession, d: str) -> DataFrame:
    """A snapshot of all repositories, then one of a third of them with other services."""
    folder, rows = new_path(s, "snapshot"), M.services(s, d).select("repo_id", "id", "category")
    reports.write_snapshot(rows, folder)
    reports.write_snapshot(rows.where("repo_id % 3 = 0").withColumn("category", F.lit("new")), folder)
    return s.read.parquet(folder).select("repo_id", "id", "category")


def appended(s: SparkSession, d: str) -> DataFrame:
    """Two runs, the second of which is written twice."""
    folder, rows = new_path(s, "runs"), A.adapted(s, d, A.HISTORY).select("repo_id", "ts", "score", "event_id")
    for run, part in (("a", "event_id % 2 = 0"), ("b", "event_id % 2 = 1"), ("b", "event_id % 2 = 1")):
        reports.append_history(rows.where(part).drop("event_id"), folder, run)
    return history.kept(s.read.parquet(folder)).select("repo_id", "ts", "score")


def secrets(s: SparkSession, d: str) -> DataFrame:
    """Owners encrypted and decrypted again, and whether the stored form differs."""
    key = F.lit("0123456789abcdef")
    stored_rows = reports.encrypted(M.services(s, d).select("id", "owner").withColumn("plain", F.col("owner")), key)
    return reports.decrypted(stored_rows.withColumn("hidden", F.coalesce(F.col("owner") != F.col("plain"), F.lit(True))), key).select("id", "owner", "hidden")


def scanned(s: SparkSession, d: str) -> DataFrame:
    files = A.adapted(s, d, T.files_sql(T.WORKSPACES, "CAST(k AS INT)"), deal="p_partkey")
    return repo.with_packages(parsers.evidence_of(repo.walked(files), only=["package_json"]), repo.workspace_packages(files)).select("repo_id", "type", "value", "file")


def many_packages(s: SparkSession, d: str) -> DataFrame:
    files = A.adapted(s, d, T.files_sql([("package.json", '{"workspaces":["packages/*"]}', "k < 3"), ("packages/p§k/package.json", "{}", "true")], "CAST(k % 3 AS INT)"), deal="p_partkey")
    return repo.workspace_packages(files)


def manual(s: SparkSession, d: str) -> DataFrame:
    """Nodes and edges after services are added by hand, half of which are there already."""
    rows = M.services(s, d).select("repo_id", "id", "name", "category", "source")
    added = M.services(s, d).where("ord % 6 = 0").select("repo_id", "id", "name", F.lit("payments").alias("category"))
    made, edges, _ = graph.with_manual(M.nodes(s, d).where("ord % 4 = 0").drop("ord"), M.links(s, d).where("ord % 4 = 0").drop("ord"), rows, added)
    return M.parts(made, edges)


def edited(s: SparkSession, d: str) -> DataFrame:
    rows = M.services(s, d).select("repo_id", "id", "category", "confidence", "needs_review")
    change = M.services(s, d).where("ord % 5 = 0").select("repo_id", "id", F.when(F.col("ord") % 10 == 0, "other").otherwise("email").alias("category"), F.when(F.col("ord") % 15 == 0, "high").otherwise("medium").alias("confidence"), "needs_review", F.lit(False).alias("deleted"), F.lit(1).alias("ts"))
    return graph.updated(rows, change)


def budgets(s: SparkSession, d: str) -> DataFrame:
    part = A.table(s, d, "part").select(F.col("p_partkey").alias("repo_id"), F.col("p_size").cast("double").alias("monthly"), F.lit(80.0).alias("threshold"))
    change = lambda when, ts, amount: part.where(when).select("repo_id", F.lit(amount).cast("double").alias("monthly"), F.lit(50.0).alias("threshold"), F.lit(ts).alias("ts"))
    return health.with_budgets(part.where("repo_id % 2 = 0"), change("repo_id % 3 = 0", 1, 7.0).unionAll(change("repo_id % 6 = 0", 2, None)).unionAll(change("repo_id % 12 = 0", 3, 9.0)))


QUERIES: dict[str, Query] = {
    "snk06_lines": lambda s, d: reports.cyclonedx_lines(M.deps(s, d), F.lit("app"), F.lit("2024-06-30")), "snk07_lines": lambda s, d: reports.spdx_lines(M.deps(s, d), F.lit("app"), F.lit("2024-06-30")),
    "snk01_lines": lambda s, d: reports.services_json_lines(M.services(s, d).select("repo_id", "id", "name", "category", "needs_review", "url", "ord")),
    "snk09_snapshot": snapshot, "snk10_history": appended, "snk11_encrypted": secrets, "src17_scan": scanned, "lim03_packages": many_packages, "mut02_manual": manual, "mut03_updated": edited, "mut06_budgets": budgets,
    "snk03_summary": lambda s, d: reports.summary_lines(M.services(s, d)),
    "snk12_diff": lambda s, d: reports.diff_markdown(facts.stack_diff(M.services(s, d).where("ord % 5 <> 0"), M.services(s, d).where("ord % 7 <> 0"), M.deps(s, d).limit(0), M.deps(s, d).limit(0))),
    "gr05_layers": graph_layers,
    "ai07_budget": lambda s, d: prompts.within_budget(texts(s, d)).select("repo_id", "path", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest")),
    "srt06_priority_files": lambda s, d: prompts.priority_files(A.adapted(s, d, T.WALK)),
    "jn21_context": lambda s, d: prompts.with_context(M.services(s, d).select("repo_id", "id"), contexts(s, d)),
    "srt01_by_name": lambda s, d: health.sorted_dependencies(mixed_case(s, d)).select("repo_id", "name", "ord", "place"),
    "srt01_by_type": lambda s, d: health.sorted_dependencies(mixed_case(s, d), "type", descending=True).select("repo_id", "type", "ord", "place"),
    "src11_git_activity": logs,
    "src12_advisories": lambda s, d: facts.vulnerable(M.deps(s, d), answers(s, d)).drop("aliases", "fixed_version", "url"),
    "snk02_documents": documents,
    "src08_services": lambda s, d: stored.services_of(migrated(s, d)[0]).select("repo_id", "ord", "id", "name", "category"),
    "src08_rejects": lambda s, d: migrated(s, d)[1],
    "src13_nodes": lambda s, d: imported(s, d)[0],
    "src13_edges": lambda s, d: imported(s, d)[1],
}
