"""Named queries over repository files made from the part table (sources/file_adapter.py): parsers, walk, kinds, workspaces, own names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grouping, parsers
from .operators.ordering import walk_ranks
from .sources import adapters as A
from .sources import file_adapter as T
from .sources import repo

Query = Callable[[SparkSession, str], DataFrame]


def made(s: SparkSession, d: str, sql: str) -> DataFrame:
    """The files that sql makes of the part table, a short row each that stands for much parsing."""
    return A.adapted(s, d, sql, deal="p_partkey")


def files(s: SparkSession, d: str, rows: list) -> DataFrame:
    return made(s, d, T.files_sql(rows, "CAST(k AS INT)"))


def template(s: SparkSession, d: str, name: str) -> DataFrame:
    return made(s, d, T.files_sql([(*T.TEMPLATES[name], "true")]))


#: The kind of file that each template is of; its query's plan holds that parser alone.
KIND_OF = {
    "tvf01_package_json": "package_json", "tvf02_env": "env", "tvf03_compose": "compose", "tvf04_workflow": "workflow", "tvf05_config_names": "config_name", "tvf06_source": "source", "tvf07_content_lines": "source",
    "tvf08_requirements": "requirements", "tvf09_pyproject": "pyproject", "tvf10_setup_py": "setup_py", "tvf11_cargo": "cargo", "tvf12_go_mod": "go_mod", "tvf13_terraform": "terraform", "tvf14_csproj": "csproj",
    "tvf15_appsettings": "appsettings", "tvf16_web_config": "web_config", "tvf17_pom": "pom", "tvf18_gradle": "gradle", "tvf19_properties": "properties", "tvf20_application_yml": "application_yml", "tvf21_gemfile": "gemfile",
    "tvf22_database_yml": "database_yml", "tvf23_composer": "composer", "tvf24_pipfile": "pipfile", "tvf25_setup_cfg": "setup_cfg",
}


def parsed(name: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        walked, only = repo.walked(template(s, d, name)), [KIND_OF[name]]
        found = parsers.evidence_of(walked, only=only).select("repo_id", "file", F.lit("evidence").alias("part"), "type", "value", "line", F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("ecosystem"))
        needed = parsers.dependencies_of(walked, only=only).select("repo_id", "file", F.lit("dependency").alias("part"), "type", F.col("name").alias("value"), F.lit(None).cast("int").alias("line"), "version", "ecosystem")
        return found.unionAll(needed)

    return query


def kinds(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n, _ in T.KIND_NAMES])
    paths = A.table(s, d, "part").select(F.col("p_partkey").cast("int").alias("repo_id"), F.concat(F.lit("d/"), F.get(names, (F.col("p_partkey") % len(T.KIND_NAMES)).cast("int"))).alias("path"))
    return parsers.kinds(paths).select("repo_id", "kind")


def ecosystems(s: SparkSession, d: str) -> DataFrame:
    rows = repo.walked(made(s, d, T.files_sql([(*T.TEMPLATES[n], "true") for n in ("tvf01_package_json", "tvf08_requirements", "tvf12_go_mod")])))
    return parsers.ecosystems(rows, parsers.dependencies_of(rows)).withColumn("ecosystems", F.array_join("ecosystems", ","))


def needed(s: SparkSession, d: str) -> DataFrame:
    """The dependencies of repositories with manifests in many folders, some of them ignored, in the order of the walk."""
    return parsers.extract_dependencies(repo.walked(repo.without_ignored(made(s, d, T.files_sql(T.MANIFESTS)))))


QUERIES: dict[str, Query] = {name: parsed(name) for name in T.TEMPLATES if name != "tvf26_env_map"} | {
    "tvf26_env_map": lambda s, d: template(s, d, "tvf26_env_map").select("repo_id", F.col("path").alias("file"), F.explode(parsers.env_map(F.col("content"))).alias("key", "value")),
    "src01_walk": lambda s, d: repo.walked(made(s, d, T.WALK)).select("repo_id", "path"),
    "src02_gitignore": lambda s, d: repo.without_ignored(files(s, d, T.IGNORES)).where("path <> '.gitignore'").select("repo_id", "path"),
    "src06_kinds": kinds,
    "src15_workspaces": lambda s, d: repo.workspace_packages(files(s, d, T.WORKSPACES)),
    "fn05_own_names": lambda s, d: parsers.project_names(files(s, d, T.NAMES)),
    "fn07_ecosystems": ecosystems,
    "src01_walk_order": lambda s, d: walk_ranks(repo.walked(made(s, d, T.files_sql(T.MANIFESTS)))),
    "src02_inventory": lambda s, d: needed(s, d).select("repo_id", "file", "name", "version", "type"),
    "agg07_walk_dedup": lambda s, d: grouping.unique_dependencies(needed(s, d)).select("repo_id", "ecosystem", "name", "version", "type", "file"),
}
