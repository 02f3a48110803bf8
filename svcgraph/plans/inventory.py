"""Whole plans: from files or evidence to services, dependencies, graph and score, as one lazy DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import grouping, parsers
from ..operators.classify import classify
from ..operators.ordering import walk_ranks
from ..sources import repo


def inventory_of_evidence(evidences: DataFrame, project: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(services, discarded) of evidence rows."""
    services, discarded = grouping.infer_services(classify(evidences, project))
    return services.drop("ord"), discarded


def inventory_of_files(files: DataFrame) -> dict[str, DataFrame]:
    """services, discarded, evidences, dependencies, ecosystems and names of a table of repository files.

    What a repository's own ignore file leaves out is never read. The names of each repository (a row each) are joined to its evidence before it is
    classified. The files' order (names only) is found once, so that whatever comes first does so in the order of the walk.
    """
    walked = repo.walked(repo.without_ignored(files))
    ranks = walk_ranks(walked)
    names = parsers.project_names(files).withColumn("project", F.coalesce("project_name", F.col("repo_id").cast("string")))
    with_domain = walked.join(names.select("repo_id", "own_domain"), "repo_id", "left")
    evidences = parsers.extract_evidences(with_domain, F.col("own_domain"), ranks)
    dependencies = parsers.extract_dependencies(walked, ranks)
    named = evidences.join(names.select("repo_id", "project"), "repo_id", "left").withColumn("project", F.coalesce("project", F.col("repo_id").cast("string")))
    services, discarded = inventory_of_evidence(named, F.col("project"))
    return {"services": services, "discarded": discarded, "evidences": evidences, "dependencies": dependencies, "ecosystems": parsers.ecosystems(walked, dependencies), "names": names}
