"""Stored tables of earlier runs: snapshots (SRC09), score histories (SRC10) and configurations (SRC07, SRC08, SRC13).

Each comes as one JSON text a repository; what can't be read gives no row and stops nothing. Configurations of older versions go through an
ordered chain of migrations on VARIANT values, and those that can't be read go to a table of rejects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SERVICE = "id string, name string, category string, confidence string, owner string, plan string"


def _listed(json: Column, kind: str) -> Column:
    # from_json would take one object for an array of one
    return F.coalesce(F.from_json(F.when(F.ltrim(json).startswith("["), json), f"array<struct<{kind}>>"), F.from_json(F.lit("[]"), f"array<struct<{kind}>>"))


def snapshot_services(raw: DataFrame) -> DataFrame:
    """SRC09: raw (repo_id, body) -> repo_id and a service's fields; unreadable bodies and versions other than '1' are none."""
    body = F.try_parse_json("body")
    good = raw.withColumn("version", F.get_json_object("body", "$.version")).where(body.isNotNull() & (F.coalesce("version", F.lit("1")) == "1"))
    return good.select("repo_id", F.explode(_listed(F.get_json_object("body", "$.services"), SERVICE)).alias("s")).select("repo_id", "s.*")


def score_history(raw: DataFrame) -> DataFrame:
    """SRC10: raw (repo_id, body) -> repo_id, at (place in the list), score; a body that is no array is an empty history."""
    return raw.select("repo_id", F.posexplode(_listed(F.col("body"), "score int")).alias("at", "e")).select("repo_id", "at", "e.score").where("score IS NOT NULL")


def configured_services(stored: DataFrame, beside: DataFrame) -> DataFrame:
    """SRC07/SRC08/SRC13: both (repo_id, body); a repository's stored configuration counts first, else the one beside its code."""
    ok = lambda rows: rows.where(F.try_parse_json("body").isNotNull())
    first = ok(stored)
    body = first.unionByName(ok(beside).join(first.select("repo_id"), "repo_id", "left_anti"))
    return body.select("repo_id", F.posexplode(_listed(F.get_json_object("body", "$.services"), SERVICE)).alias("ord", "s")).select("repo_id", "ord", "s.*")


# --- migrations ------------------------------------------------------------------------------------

CURRENT_VERSION = "1"


@dataclass(frozen=True)
class Migration:
    """From one version to another, as a function on a VARIANT column."""

    before: str
    after: str
    change: Callable[[Column], Column]


def renamed(before: str, after: str, fields: dict[str, str]) -> Migration:
    """A migration that gives top-level fields other names; all others stay."""

    def change(body: Column) -> Column:
        names = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
        entries = F.map_entries(body.cast("map<string,variant>"))
        return F.to_variant_object(F.map_from_entries(F.transform(entries, lambda e: F.struct(F.coalesce(F.element_at(names, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))))

    return Migration(before, after, change)


def migrated(raw: DataFrame, chain: list[Migration], current: str = CURRENT_VERSION) -> tuple[DataFrame, DataFrame]:
    """SRC08: raw (repo_id, body) -> (repo_id, body as VARIANT, version) of the current version, and rejects (repo_id, body, reason).

    The chain's migrations are applied in order to bodies that have their version by then; one without a version has "1". Whatever
    version is left after the chain, the body counts as the current one. Texts that aren't JSON, and JSON that is no object, are rejects.
    """
    parsed = raw.withColumn("v", F.try_parse_json("body"))
    reason = F.when(F.col("v").isNull(), "not JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "no object")
    judged = parsed.withColumn("reason", reason)
    rows = judged.where("reason IS NULL").select("repo_id", "v", F.coalesce(F.try_variant_get("v", "$.version", "string"), F.lit("1")).alias("version"))
    for step in chain:
        due = F.col("version") == step.before
        rows = rows.select("repo_id", F.when(due, step.change(F.col("v"))).otherwise(F.col("v")).alias("v"), F.when(due, step.after).otherwise(F.col("version")).alias("version"))
    return rows.select("repo_id", F.col("v").alias("body"), F.lit(current).alias("version")), judged.where("reason IS NOT NULL").select("repo_id", "body", "reason")


def _items(rows: DataFrame, path: str, *fields: tuple[str, str]) -> DataFrame:
    """repo_id, at and the named fields of the objects in an array of the body; anything else gives none."""
    array = F.when(F.schema_of_variant(F.try_variant_get("body", path, "variant")).startswith("ARRAY"), F.try_variant_get("body", path, "array<variant>"))
    return rows.select("repo_id", F.posexplode(array).alias("at", "e")).select("repo_id", "at", *[F.try_variant_get("e", f"$.{where}", "string").alias(name) for name, where in fields])


def services_of(rows: DataFrame) -> DataFrame:
    """repo_id, ord and fields of the services in migrated configurations."""
    names = [f.split()[0] for f in SERVICE.split(", ")]
    return _items(rows, "$.services", *[(n, n) for n in names]).withColumnRenamed("at", "ord")


def imported_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC13: nodes and edges of migrated configurations: saved ones, one (and an edge from the user) for each service without a node, and the user's.

    A node svc-<id> stands for the service of that id.
    """
    from ..operators.graph import missing_nodes

    node = _items(rows, "$.graph.nodes", ("id", "id"), ("label", "data.label"), ("type", "data.nodeType"), ("layer_color", "data.layerColor")).where("id IS NOT NULL")
    saved = node.select("repo_id", "id", "label", F.coalesce("type", F.lit("external")).alias("type"), F.when(F.col("id").startswith("svc-"), F.expr("substring(id, 5)")).alias("service_id"))
    saved = written(saved, "nodes")  # bodies are parsed once for nodes and once for services, which several joins read
    services = written(services_of(rows).select("repo_id", "id", "name", "category"), "services")
    links = _items(rows, "$.graph.edges", ("source", "source"), ("target", "target"), ("flow_type", "type")).drop("at")
    made, more = missing_nodes(services, saved)
    all_nodes = saved.unionByName(made)
    user = rows.select("repo_id").distinct().join(all_nodes.where("id = 'user'").select("repo_id"), "repo_id", "left_anti")
    null = F.lit(None).cast("string")
    return all_nodes.unionByName(user.select("repo_id", F.lit("user").alias("id"), F.lit("User").alias("label"), F.lit("layer").alias("type"), null.alias("service_id"))), links.unionByName(more)
