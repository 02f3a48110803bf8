"""GR01-GR07, JN15-JN17, JN20, FN37: the architecture graph as a table of nodes and one of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import rules
from ..sources.shared import written


def route(category: Column, url: Column) -> Column:
    """GR01: frontend or backend; other categories go by whether there is an address."""
    has_url = F.coalesce(url, F.lit("")) != ""
    return F.when(category.isin(rules.FRONTEND_CATEGORIES), "frontend").when(category.isin(rules.BACKEND_CATEGORIES), "backend").when(has_url, "backend").otherwise("frontend")


def node_type(category: Column) -> Column:
    """GR04."""
    return F.when(category == "cdn", "cdn").when(category == "database", "database").otherwise("external")


def flow_type(category: Column) -> Column:
    """GR04."""
    return F.when(category == "payments", "payment").when(category == "auth", "auth").otherwise("data")


def group_key(category: Column) -> Column:
    pairs = [(c, key) for key, members, _ in rules.LAYER_GROUPS for c in members]
    return E.lookup(category, pairs)


def prepared(services: DataFrame) -> DataFrame:
    """The columns of services that nodes and edges need, written once, as both read them several times."""
    return written(services.select("repo_id", "id", "name", "category", "url"), "services")


def repository_flags(services: DataFrame) -> DataFrame:
    """GR02: repo_id, has_front, has_back and the parents of both sides."""
    side = route(F.col("category"), F.col("url"))
    flags = services.groupBy("repo_id").agg(F.bool_or(F.col("category").isin("hosting", "cdn")).alias("hosted"), F.bool_or(side == "frontend").alias("f"), F.bool_or(side == "backend").alias("b"))
    front = F.col("hosted") & F.col("f")
    return flags.select("repo_id", front.alias("has_front"), F.col("b").alias("has_back"), F.when(front, "frontend").when(F.col("b"), "api").otherwise("user").alias("front_parent"), F.when(F.col("b"), "api").otherwise("user").alias("back_parent"))


def placed(services: DataFrame) -> DataFrame:
    """GR03: each service with its parent: a layer where at least two of a group share a side, else the side's node."""
    sided = services.withColumn("side", route(F.col("category"), F.col("url"))).withColumn("group_key", group_key(F.col("category")))
    sizes = sided.where("group_key IS NOT NULL").groupBy("repo_id", "side", "group_key").agg(F.count("*").alias("members"))
    rows = sided.join(sizes, ["repo_id", "side", "group_key"], "left").join(repository_flags(services), "repo_id")
    side_parent = F.when(F.col("side") == "frontend", F.col("front_parent")).otherwise(F.col("back_parent"))
    layered = F.coalesce(F.col("members") >= 2, F.lit(False))
    return rows.withColumn("side_parent", side_parent).withColumn("layered", layered).withColumn("parent", F.when(layered, F.concat(F.lit("layer-"), "group_key")).otherwise(side_parent))


def _node(id_: Column, label: Column, kind: Column, service: Column) -> list[Column]:
    return [F.col("repo_id"), id_.alias("id"), label.alias("label"), kind.alias("type"), service.alias("service_id")]


def virtual_nodes(repositories: DataFrame, services: DataFrame) -> DataFrame:
    """GR02: user always, frontend and api by the flags; repositories without services have the user alone."""
    flags = repositories.select("repo_id").distinct().join(repository_flags(services), "repo_id", "left")
    made = F.array(
        F.struct(F.lit(True).alias("on"), F.lit("user").alias("id"), F.lit("User").alias("label")),
        F.struct(F.coalesce("has_front", F.lit(False)).alias("on"), F.lit("frontend").alias("id"), F.lit("Frontend").alias("label")),
        F.struct(F.coalesce("has_back", F.lit(False)).alias("on"), F.lit("api").alias("id"), F.lit("Backend").alias("label")),
    )
    rows = flags.select("repo_id", F.explode(F.filter(made, lambda x: x["on"])).alias("n"))
    return rows.select(*_node(F.col("n.id"), F.col("n.label"), F.lit("layer"), F.lit(None).cast("string")))


def nodes(repositories: DataFrame, services: DataFrame) -> DataFrame:
    rows = placed(services)
    labels = E.lookup(F.col("group_key"), [(k, label) for k, _, label in rules.LAYER_GROUPS])
    layers = rows.where("layered").select("repo_id", "parent", "group_key").distinct().select(*_node(F.col("parent"), labels, F.lit("layer"), F.lit(None).cast("string")))
    own = rows.select(*_node(F.concat(F.lit("svc-"), F.col("id")), F.col("name"), node_type(F.col("category")), F.col("id")))
    return virtual_nodes(repositories, services).unionByName(layers).unionByName(own)


def edges(services: DataFrame) -> DataFrame:
    """repo_id, source, target, flow_type of virtual nodes, layers and services."""
    rows = placed(services)
    flags = rows.select("repo_id", "has_front", "has_back").distinct()
    link = lambda on, a, b: F.struct(on.alias("on"), F.lit(a).alias("s"), F.lit(b).alias("t"))
    made = F.array(link(F.col("has_front"), "user", "frontend"), link(F.col("has_back"), "user", "api"), link(F.col("has_front") & F.col("has_back"), "frontend", "api"))
    virtual = flags.select("repo_id", F.explode(F.filter(made, lambda x: x["on"])).alias("e")).select("repo_id", F.col("e.s").alias("source"), F.col("e.t").alias("target"), F.lit("data").alias("flow_type"))
    layers = rows.where("layered").select("repo_id", F.col("side_parent").alias("source"), F.col("parent").alias("target"), F.lit("data").alias("flow_type")).distinct()
    own = rows.select("repo_id", F.col("parent").alias("source"), F.concat(F.lit("svc-"), F.col("id")).alias("target"), flow_type(F.col("category")).alias("flow_type"))
    return virtual.unionByName(layers).unionByName(own)


def missing_nodes(services: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN15: nodes, and edges from the user, for services that no node stands for."""
    new = services.join(existing.where("service_id IS NOT NULL").select("repo_id", F.col("service_id").alias("id")).distinct(), ["repo_id", "id"], "left_anti")
    made = new.select(*_node(F.concat(F.lit("svc-"), F.col("id")), F.col("name"), node_type(F.col("category")), F.col("id")))
    links = new.select("repo_id", F.lit("user").alias("source"), F.concat(F.lit("svc-"), F.col("id")).alias("target"), flow_type(F.col("category")).alias("flow_type"))
    return made, links


#: What a person can edit of a node, beside its label and type.
NODE_FIELDS = ["category", "plan", "confidence", "url", "note", "source", "layer_color"]


def with_saved(made: DataFrame, links: DataFrame, saved_nodes: DataFrame, saved_edges: DataFrame, services: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """JN16: what was saved of a graph over the analysed one.

    made: repo_id, id, label, type, service_id; saved_nodes: repo_id, id, label, type, NODE_FIELDS (those it has), x, y; saved_edges as links;
    services: repo_id, id, category, plan, confidence, url, notes, source (those it has). An analysed node takes each saved field that isn't null, but a layer stays a
    layer; without a saved one it takes its service's. Saved nodes that the analysis lacks are added without a service. Saved positions count for analysed nodes where all of a
    repository's are saved (else all are laid out anew, x and y null). Saved edges are added if new and both ends exist.
    """
    col = F.col
    null = lambda t="string": F.lit(None).cast(t)
    given = lambda rows, c, t="string": F.col(c).cast(t) if c in rows.columns else null(t)
    base = made.select("repo_id", "id", "label", "type", "service_id", given(made, "layer_color").alias("layer_color"))
    spots = [given(saved_nodes, c, "double").alias(f"_{c}") for c in ("x", "y")]
    saved = saved_nodes.select("repo_id", "id", F.lit(True).alias("_saved"), *[given(saved_nodes, c).alias(f"_{c}") for c in ("label", "type", *NODE_FIELDS)], *spots)
    rows = base.join(saved, ["repo_id", "id"], "left")
    fields = {"category": "category", "plan": "plan", "confidence": "confidence", "url": "url", "note": "notes", "source": "source"}
    if services is None:
        rows = rows.withColumns({"_known": F.lit(False)} | {f"_s_{c}": null() for c in fields})
    else:
        own = services.select("repo_id", col("id").alias("service_id"), F.lit(True).alias("_known"), *[given(services, s).alias(f"_s_{c}") for c, s in fields.items()])
        rows = rows.join(own, ["repo_id", "service_id"], "left")
    here, known, layer = F.coalesce("_saved", F.lit(False)), F.coalesce("_known", F.lit(False)), col("type") == "layer"
    sure = F.coalesce("_s_confidence", F.lit("high"))
    of_service = lambda c: sure if c == "confidence" else col(f"_s_{c}")
    value = {c: F.when(here, F.coalesce(f"_{c}", sure if c == "confidence" else null())).when(known, of_service(c)) for c in fields}
    value["layer_color"] = F.when(here & layer, F.coalesce("layer_color", "_layer_color")).when(here, F.coalesce("_layer_color", "layer_color")).otherwise(col("layer_color"))
    from pyspark.sql import Window

    placed = rows.withColumn("_all", F.bool_and(here).over(Window.partitionBy("repo_id")))
    analysed = placed.select(
        "repo_id", "id", F.coalesce("_label", "label").alias("label"), F.when(layer, "layer").otherwise(F.coalesce("_type", "type")).alias("type"), "service_id",
        *[value[c].alias(c) for c in NODE_FIELDS], *[F.when(col("_all"), col(f"_{c}")).alias(c) for c in ("x", "y")],
    )
    defaults = {"plan": "unknown", "confidence": "high", "source": "manual"}
    manual = saved.join(made.select("repo_id", "id"), ["repo_id", "id"], "left_anti").select(
        "repo_id", "id", col("_label").alias("label"), F.coalesce("_type", F.lit("external")).alias("type"), null().alias("service_id"),
        *[(F.coalesce(f"_{c}", F.lit(defaults[c])) if c in defaults else col(f"_{c}")).alias(c) for c in NODE_FIELDS], col("_x").alias("x"), col("_y").alias("y"),
    )
    all_nodes = analysed.unionByName(manual)
    ids = all_nodes.select("repo_id", "id").distinct()
    new = saved_edges.join(links.select("repo_id", "source", "target").distinct(), ["repo_id", "source", "target"], "left_anti")
    new = new.join(ids.withColumnRenamed("id", "source"), ["repo_id", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["repo_id", "target"], "left_semi")
    return all_nodes, links.unionByName(new.select(*links.columns))


def retyped(links: DataFrame, types: DataFrame) -> DataFrame:
    """JN17: types (repo_id, service_id, flow_type) set, each, the first edge that touches a service's node; of several for one edge the last one stays.

    First and last go by ord, of links and of types, where they have one; else edges by source and target.
    """
    place = F.struct("ord", "source", "target") if "ord" in links.columns else F.struct("source", "target")
    turn = F.col("ord") if "ord" in types.columns else F.lit(0)
    ends = links.select("repo_id", place.alias("e"), F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    wanted = types.select("repo_id", F.concat(F.lit("svc-"), "service_id").alias("node"), F.struct(turn.alias("turn"), F.col("flow_type").alias("new")).alias("t")).groupBy("repo_id", "node").agg(F.max("t").alias("t"))
    first = ends.join(wanted, ["repo_id", "node"]).groupBy("repo_id", "node").agg(F.min("e").alias("e"), F.max("t").alias("t"))
    keys = ["repo_id", "source", "target", *(["ord"] if "ord" in links.columns else [])]
    chosen = first.groupBy("repo_id", "e").agg(F.max("t").alias("t")).select("repo_id", "e.*", F.col("t.new").alias("_new"))
    return links.join(chosen, keys, "left").withColumn("flow_type", F.coalesce("_new", "flow_type")).select(*links.columns)


def without(made: DataFrame, links: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR06: nodes (repo_id, id) go with every edge that touches them."""
    gone = deleted.select("repo_id", "id").distinct()
    left = links.join(gone.withColumnRenamed("id", "source"), ["repo_id", "source"], "left_anti").join(gone.withColumnRenamed("id", "target"), ["repo_id", "target"], "left_anti")
    return made.join(gone, ["repo_id", "id"], "left_anti"), left


def overlaid(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """GR07/MUT02-MUT05: the latest change (by ts) of a key replaces its row, adds it, or, with deleted, removes it."""
    columns = [c for c in rows.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("deleted", *columns), F.col("ts")).alias("c"))
    both = rows.withColumn("_r", F.struct(*columns)).select(*keys, "_r").join(last, keys, "full").where("c IS NULL OR NOT c.deleted")
    return both.select(*keys, *[F.when(F.col("c").isNotNull(), F.col(f"c.{x}")).otherwise(F.col(f"_r.{x}")).alias(x) for x in columns])


def with_manual(made: DataFrame, links: DataFrame, services: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT02: nodes, edges and services with those that a person adds (as services: repo_id, id, name, category, ...): a node and an edge from the user for each.

    An id that is there already is replaced as a service and keeps its node.
    """
    own = added.withColumn("source", F.lit("manual"))
    new_nodes, new_links = missing_nodes(own, made)
    rest = services.join(own.select("repo_id", "id"), ["repo_id", "id"], "left_anti")
    return made.unionByName(new_nodes, allowMissingColumns=True), links.unionByName(new_links), rest.unionByName(own, allowMissingColumns=True)


def updated(services: DataFrame, changes: DataFrame) -> DataFrame:
    """MUT03: services (with category, confidence, needs_review, and warnings where counted) after their latest change; the review flag of changed ones is found anew (FN29)."""
    warnings = F.col("warnings") if "warnings" in services.columns else F.lit(0)
    keys, touched = ["repo_id", "id"], F.coalesce("_touched", F.lit(False))
    rows = overlaid(services, changes, keys).join(changes.select(*keys).distinct().withColumn("_touched", F.lit(True)), keys, "left")
    return rows.withColumn("needs_review", F.when(touched, E.should_review(F.coalesce("confidence", F.lit("")), F.col("category"), warnings)).otherwise(F.col("needs_review"))).select(*services.columns)


def labelled(links: DataFrame, made: DataFrame) -> DataFrame:
    """JN20: edges with their ends' labels, the id where there is none."""
    name = lambda end: made.select("repo_id", F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    rows = links.join(name("source"), ["repo_id", "source"], "left").join(name("target"), ["repo_id", "target"], "left")
    return rows.withColumn("source_label", F.coalesce("source_label", "source")).withColumn("target_label", F.coalesce("target_label", "target"))


def structure_hash(made: DataFrame, links: DataFrame) -> DataFrame:
    """FN37: sorted node ids, then sorted source-target pairs, of each repository."""
    a = made.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("n"))
    b = links.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", "source", "target"))), ",").alias("e"))
    return a.join(b, "repo_id", "left").select("repo_id", F.concat_ws("|", "n", F.coalesce("e", F.lit(""))).alias("structure"))
