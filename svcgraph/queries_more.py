"""Named queries of facts, graph overlays, model actions, stored tables and single functions over adapter inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as E
from .operators import facts, graph, health
from .sources import adapters as A
from .sources import stored
from .sources.shared import written

Query = Callable[[SparkSession, str], DataFrame]


def services(s, d):
    return A.adapted(s, d, A.SERVICE)


def deps(s, d):
    return A.adapted(s, d, A.DEPENDENCY)


def advisories(s, d):
    """Seven advisories for a third of the dependencies, with scores of every shape."""
    keys = facts.advisory_keys(deps(s, d)).where("ord % 3 = 0").select("advisory_ecosystem", "name", F.col("bare_version").alias("version")).distinct()
    rows = keys.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(6))))
    one = lambda score, label: F.array(F.struct(F.lit(score).cast("double").alias("score"), F.lit(label).cast("string").alias("severity")))
    scores = F.when(F.col("at") == 0, one(9.1, None)).when(F.col("at") == 1, one(None, "MODERATE")).when(F.col("at") == 2, F.concat(one(0.0, "x"), one(4.5, None))).when(F.col("at") == 3, F.filter(one(1.0, "x"), lambda x: F.lit(False))).otherwise(one(None, "High"))
    return rows.select("*", F.when(F.col("at") != 3, F.concat_ws("-", F.lit("A"), "name", F.col("at").cast("string"))).alias("id"), F.when(F.col("at") != 1, F.repeat(F.lit("s"), 150 + 30 * F.col("at"))).alias("summary"), scores.alias("scores"))


def found(s, d):
    return facts.vulnerable(deps(s, d), advisories(s, d))


def counts(s, d):
    return facts.severity_counts(found(s, d))


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.select("repo_id", F.concat(F.lit("svc-"), "id").alias("id"), F.col("name").alias("label"), F.lit("service").alias("type"), F.col("id").alias("service_id"), "ord")


def nodes(s, d):
    return nodes_of(services(s, d))


def links_of(rows: DataFrame) -> DataFrame:
    return rows.where("ord % 3 = 0").select("repo_id", F.lit("user").alias("source"), F.concat(F.lit("svc-"), "id").alias("target"), F.lit("data").alias("flow_type"), "ord")


def links(s, d):
    return links_of(services(s, d))


def parts(made: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges in one table."""
    return made.select("repo_id", F.lit("node").alias("part"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionAll(edges.select("repo_id", F.lit("edge"), "source", "target"))


def saved_graph(s, d):
    """An analysed graph, all of whose nodes are saved in a tenth of the repositories, with edited fields, own nodes and edges."""
    rows = written(services(s, d).select("repo_id", "id", "name", "category", "plan", "confidence", "url", "source", "ord"), "services")
    made = nodes_of(rows).where("ord % 2 = 0 AND (repo_id % 10 <> 3 OR ord % 4 = 0)").drop("ord")
    edges = links_of(rows).where("ord % 2 = 0").drop("ord")
    when = lambda condition, value: F.when(F.expr(condition), value)
    own = rows.where("ord % 4 = 0 OR ord % 10 = 1").select(
        "repo_id", F.concat(F.lit("svc-"), "id").alias("id"), when("ord % 4 = 0 AND ord % 8 <> 0", F.concat(F.lit("L-"), "name")).when(F.expr("ord % 10 = 1"), F.col("name")).alias("label"), when("ord % 12 = 0", "cdn").alias("type"),
        when("ord % 16 = 0", "saved").alias("category"), F.lit("n").alias("note"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"),
    )
    drawn = rows.where("ord % 5 = 1").select("repo_id", F.concat(F.lit("svc-"), "id").alias("source"), F.concat(F.lit("svc-"), "id").alias("target"), F.lit("x").alias("flow_type"))
    back = drawn.withColumn("target", F.lit("gone"))
    return graph.with_saved(made, edges, own, drawn.unionAll(back), rows)


def merged_graph(s, d):
    return parts(*saved_graph(s, d))


def overlaid(s, d):
    rows = services(s, d).select("repo_id", "id", "category", "confidence")
    at = lambda when, ts, deleted, id_, category: services(s, d).where(when).select("repo_id", id_.alias("id"), F.lit(ts).alias("ts"), F.lit(deleted).alias("deleted"), F.lit(category).alias("category"), F.lit("high").alias("confidence"))
    changes = at("ord % 4 = 0", 1, False, F.col("id"), "edited").unionAll(at("ord % 8 = 0", 2, True, F.col("id"), "gone")).unionAll(at("ord % 9 = 0", 3, False, F.concat(F.lit("n-"), "id"), "added"))
    return graph.overlaid(rows, changes, ["repo_id", "id"])


def reasoned(s, d):
    return services(s, d).select("repo_id", "id", "name", "category", "confidence", "needs_review", F.array(F.lit("scan")).alias("reasons"))


def model_merged(s, d):
    def suggest(when, id_, name, category, confidence, reason, turn):
        made = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        reasons = F.lit(None).cast("array<string>") if reason is None else F.array(F.lit(reason))
        return services(s, d).where(when).select("repo_id", id_.alias("id"), made(name).alias("name"), made(category).alias("category"), made(confidence).alias("confidence"), reasons.alias("reasons"), F.lit(turn).alias("ord"))

    known, new = F.col("id"), F.concat(F.lit("x-"), "id")
    todo = suggest("ord % 3 = 0", known, F.col("name"), "ai", "medium", "model", 1).unionAll(suggest("ord % 6 = 0", known, F.col("name"), "data", "high", "again", 2)).unionAll(suggest("ord % 12 = 0", known, F.col("name"), "other", "low", None, 3))
    todo = todo.unionAll(suggest("ord % 5 = 0", new, F.when(F.expr("ord % 2 = 0"), F.lit("New")), None, "low", "model", 1)).unionAll(suggest("ord % 20 = 0", new, "Newer", "cdn", "medium", "more", 2))
    return facts.merge_model(reasoned(s, d), todo).withColumn("reasons", F.array_join("reasons", "|"))


def configured(s, d):
    config = services(s, d).where("ord % 11 = 0").select("repo_id", "id", "name", "ord", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("owner"), F.lit("free").alias("plan"))
    return facts.overlay_config(services(s, d), config).select("repo_id", "id", "owner", "plan")


def restored(s, d):
    discarded = services(s, d).where("confidence = 'low'").select("repo_id", "id", "name", "category")
    chosen = services(s, d).where("ord % 6 = 1").select("repo_id", "name")
    back, left = facts.restore(discarded, chosen)
    return back.select("repo_id", F.lit("service").alias("part"), F.col("id").alias("item"), "name").unionAll(left.select("repo_id", F.lit("discarded"), "id", "name"))


def actions(s, d):
    rows = services(s, d)
    kept = rows.where("confidence <> 'high' AND ord % 7 = 0").groupBy("repo_id").agg(F.min_by("id", "ord").alias("value"))
    fixed = rows.where("confidence = 'high'").groupBy("repo_id").agg(F.min_by("id", "ord").alias("value"))
    merge = lambda when, to: rows.where(when).join(to, "repo_id").select("repo_id", "id", F.lit("merge").alias("action"), "value", "ord")
    pick = lambda when, action, value: rows.where(when).select("repo_id", "id", F.lit(action).alias("action"), F.lit(value).alias("value"), "ord")
    todo = merge("ord % 5 = 0", kept).unionAll(merge("ord % 13 = 1", fixed)).unionAll(pick("ord % 11 = 0", "merge", "absent")).unionAll(pick("ord % 3 = 0", "category", "email")).unionAll(pick("ord % 9 = 0", "category", "nonsense"))
    todo = todo.unionAll(pick("ord % 4 = 1", "confidence", " LOW ")).unionAll(pick("ord % 13 = 0", "remove", None))
    refined = facts.apply_actions(rows.withColumn("reasons", F.array(F.concat(F.lit("r-"), "id"))), todo)
    return refined.select("repo_id", "id", "category", "confidence", "needs_review", F.array_join("reasons", "|").alias("reasons"))


def snapshots(s, d):
    body = F.concat(F.lit('{"version":"'), (F.col("p_partkey") % 2 + 1).cast("string"), F.lit('","services":[{"id":"a'), F.col("p_size").cast("string"), F.lit('","category":"email"},{"id":"b"}]'))
    return A.table(s, d, "part").select(F.col("p_partkey").alias("repo_id"), F.concat(body, F.when(F.expr("p_partkey % 5 = 0"), "").otherwise("}")).alias("body"))


def histories(s, d):
    row = F.concat(F.lit('[{"score":'), F.col("p_size").cast("string"), F.lit('},{"score":1},{"x":2}]'))
    return A.table(s, d, "part").select(F.col("p_partkey").alias("repo_id"), F.when(F.expr("p_partkey % 3 = 0"), "oops").when(F.expr("p_partkey % 3 = 1"), F.lit('{"score":1}')).otherwise(row).alias("body"))


def configurations(s, d):
    body = lambda tag: F.concat(F.lit('{"services":[{"id":"' + tag), F.col("p_size").cast("string"), F.lit('","owner":"o"}]}'))
    part = A.table(s, d, "part").withColumn("repo_id", F.col("p_partkey"))
    return stored.configured_services(part.where("p_partkey % 2 = 0").select("repo_id", F.when(F.expr("p_partkey % 4 = 0"), "{bad").otherwise(body("s")).alias("body")), part.select("repo_id", body("b").alias("body"))).select("repo_id", "ord", "id", "owner")


def relevant(s, d):
    """Half of the services are found by id, half by a name with a blank in it."""
    ev = A.adapted(s, d, A.EVIDENCE)
    needle = F.split_part(F.lower("value"), F.lit("_"), F.lit(1))
    by_id = F.col("repo_id") % 2 == 0
    spaced = F.concat(F.upper(F.left(needle, F.lit(3))), F.lit(" "), F.substr(needle, F.lit(4)))
    named = ev.where("type = 'ci_secret'").select("repo_id", F.when(by_id, needle).otherwise(F.concat(F.lit("no-"), needle)).alias("id"), F.when(by_id, F.lit("Zz None")).otherwise(spaced).alias("name")).distinct()
    return facts.relevant_files(named, ev)


def retyped(s, d):
    """Two edges a service, the first one by order not the first by name; two types for a service, of which the second stays."""
    both = links(s, d).select("repo_id", F.explode(F.array(F.struct(F.lit("user").alias("source"), (2 * F.col("ord")).alias("ord")), F.struct(F.lit("api").alias("source"), (2 * F.col("ord") + 1).alias("ord")))).alias("e"), "target", "flow_type").select("repo_id", "e.source", "target", "flow_type", "e.ord")
    types = services(s, d).where("ord % 5 = 0").select("repo_id", F.col("id").alias("service_id"), F.explode(F.array(F.struct(F.lit("webhook").alias("flow_type"), F.lit(1).alias("ord")), F.struct(F.lit("auth").alias("flow_type"), F.lit(2).alias("ord")))).alias("t")).select("repo_id", "service_id", "t.*")
    return graph.retyped(both, types).drop("ord")


def alternatives(s, d):
    return services(s, d).where("ord % 40 = 0").select("repo_id", "ord", F.col("name").alias("service_name"), F.lit("Alt").alias("name"), F.lit("open").alias("type"), F.when(F.col("ord") % 80 != 0, F.lit("$5")).alias("savings"), F.lit("r").alias("reason"))


def budgets(s, d):
    ids = services(s, d).select("repo_id").distinct()
    plan = ids.select("repo_id", F.when(F.expr("repo_id % 5 <> 0"), (F.col("repo_id") + 1) * 100_000).otherwise(0).cast("double").alias("monthly"), F.when(F.expr("repo_id % 3 = 0"), 50).cast("double").alias("threshold"))
    return health.budget_status(services(s, d), plan).select("repo_id", F.round("spent", 2).alias("spent"), F.round("percent", 4).alias("percent"), "colour")


def on_services(*columns) -> Query:
    return lambda s, d: services(s, d).select("id", *[c() for c in columns])


def on_pages(*columns) -> Query:
    return lambda s, d: A.table(s, d, "pages").select("page_id", *[c() for c in columns])


name = lambda: F.col("name")
odd = lambda: F.concat(F.lit("\x01 a\x7f"), F.col("name"), F.lit("\t tok_abcdef "))
QUERIES: dict[str, Query] = {
    "jn18_advisories": found, "agg13_severities": counts, "flt09_gate": lambda s, d: facts.gate(found(s, d), services(s, d)),
    "jn19_badges": lambda s, d: facts.advisory_badges(deps(s, d), found(s, d)).select("ord", "advisories"),
    "agg14_checks_scanned": lambda s, d: health.health_checks(services(s, d), F.to_date(F.lit("2024-06-30")), counts(s, d)).where("kind = 'security' AND check_id LIKE '%VULNS'"),
    "jn15_missing_nodes": lambda s, d: parts(*graph.missing_nodes(services(s, d), nodes(s, d).where("ord % 2 = 0"))),
    "jn16_saved_graph": merged_graph,
    "jn16_saved_nodes": lambda s, d: saved_graph(s, d)[0], "jn17_retyped": retyped,
    "jn20_labelled": lambda s, d: graph.labelled(links(s, d).drop("ord"), nodes(s, d).where("ord % 2 = 0")),
    "gr06_without": lambda s, d: parts(*graph.without(nodes(s, d), links(s, d), nodes(s, d).where("ord % 7 = 0").select("repo_id", "id"))),
    "gr07_overlaid": overlaid, "jn13_model_merge": model_merged, "jn14_config_overlay": configured, "jn22_relevant_files": relevant, "jn23_restored": restored,
    "ai01_keep": lambda s, d: facts.keep_listed(services(s, d), services(s, d).where("ord % 3 = 0 AND repo_id % 5 <> 0").select("repo_id", "id")).select("repo_id", "id"),
    "ai02_actions": actions, "jn07_activity": lambda s, d: facts.with_activity(services(s, d).select("repo_id", "id"), services(s, d).where("ord % 2 = 0").select("repo_id", "id", F.col("ord").alias("days"))),
    "src09_snapshots": lambda s, d: stored.snapshot_services(snapshots(s, d)).select("repo_id", "id", "category"), "src10_histories": lambda s, d: stored.score_history(histories(s, d)), "src07_configurations": configurations,
    "set05_evidence_files": lambda s, d: A.adapted(s, d, A.EVIDENCE).select("repo_id", "file").distinct(),
    "lim05_batches": lambda s, d: facts.batches(deps(s, d), 100).groupBy("repo_id", "batch").agg(F.count("*").alias("n"), F.min("ord").alias("first")),
    "flt05_discarded": lambda s, d: health.search_discarded(services(s, d).select("id", "name", F.col("plan").alias("reason")), "ice 9", "paid").select("id"),
    "agg17_reasons": lambda s, d: health.counts_by(services(s, d).select(F.col("plan").alias("reason")), "reason"),
    "fn15_rank": on_services(lambda: E.confidence_rank(F.col("confidence")).alias("rank")),
    "fn20_renewed": lambda s, d: health.renewed(services(s, d).where("billing_type = 'manual' AND period = 'yearly'"), F.lit("2024-02-29")).select("id", "last_renewed", "next_date"),
    "fn29_review": on_services(lambda: E.should_review(F.col("confidence"), F.when(F.col("ord") % 3 == 0, "other").otherwise(F.col("category")), F.col("ord") % 2).alias("review")),
    "fn30_band": lambda s, d: A.adapted(s, d, A.HISTORY).select("event_id", E.score_band(F.col("score")).alias("band")),
    "fn32_sanitized": on_pages(lambda: E.sanitize_prompt(F.concat(F.lit(" \x01"), "html", F.lit("\x7f")), 200).alias("clean")),
    "fn33_redacted": on_pages(lambda: E.redact_token(F.concat("url", F.lit(" failed: "), "html"), F.split_part("url", F.lit("/"), F.lit(3))).alias("message")),
    "fn34_traversal": on_pages(lambda: E.has_traversal(F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("/../x"))).when(F.col("page_id") % 4 == 1, F.concat("url", F.lit(".."))).when(F.col("page_id") % 4 == 2, F.concat("url", F.lit("\\.."))).otherwise(F.col("url"))).alias("unsafe")),
    "fn35_budget": budgets,
    "fn38_registry": lambda s, d: deps(s, d).select("ord", E.registry_url(F.col("ecosystem"), F.col("name")).alias("url")),
    "fn39_slugs": on_pages(
        lambda: E.valid_slug(F.concat(F.split_part("url", F.lit("/"), F.lit(4)), F.lit("/"), F.split_part("url", F.lit("/"), F.lit(5)))).alias("slug"),
        lambda: E.safe_base_url(F.when(F.col("page_id") % 3 == 0, F.replace("url", F.split_part("url", F.lit("/"), F.lit(3)), F.lit("u@169.254.1.1:80"))).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url"))).alias("base"),
    ),
}
