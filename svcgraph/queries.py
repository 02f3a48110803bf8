"""Named queries over the driver's tables: thin applications of the operators to adapter inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_files, queries_more, queries_sources, queries_streams
from .functions import exprs as E
from .operators import facts, graph, grouping, health, history, reports
from .operators.classify import classify
from .plans.inventory import inventory_of_evidence
from .sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-06-30"
RESULT = ["repo_id", "ord", "file", "service_name", "category", "confidence", "reason", "score", "evidence_type"]


def as_of():
    return F.to_date(F.lit(AS_OF))


def ev(s, d):
    return A.adapted(s, d, A.EVIDENCE)


def results(s, d):
    return A.adapted(s, d, A.RESULT)


def deps(s, d):
    return A.adapted(s, d, A.DEPENDENCY)


def services(s, d):
    return A.adapted(s, d, A.SERVICE)


def previous(s, d):
    return services(s, d).where("ord % 5 <> 0")


def current(s, d):
    return services(s, d).where("ord % 7 <> 0").withColumn("category", F.when(F.expr("ord % 11 = 0"), "shifted").otherwise(F.col("category")))


def classified(kind: str | None) -> Query:
    return lambda s, d: classify(ev(s, d) if kind is None else ev(s, d).where(F.col("type") == kind)).select(*RESULT)


def keyed_evidence(s, d):
    return grouping.keyed(classify(ev(s, d)))


def keyed_results(s, d):
    return grouping.keyed(results(s, d))


def on(table: str, *columns) -> Query:
    return lambda s, d: A.table(s, d, table).select(*[c() if callable(c) else c for c in columns])


def secrets_as_services(s, d):
    needle = F.split_part(F.lower("value"), F.lit("_"), F.lit(1))
    return ev(s, d).where("type = 'ci_secret'").select("repo_id", needle.alias("id"), needle.alias("name")).distinct()


def merged(s, d):
    cur = current(s, d).where("source = 'inferred'")
    overrides = services(s, d).where("ord % 13 = 0").select("repo_id", "id", F.lit("high").alias("confidence"))
    return facts.merge_services(cur, previous(s, d).where("ord % 9 = 0"), overrides, previous(s, d)).select("repo_id", "id", "category", "owner", "confidence")


def id_difference(s, d):
    p, c = previous(s, d).select("id"), current(s, d).select("id")
    return facts.added(p, c, ["id"]).select(F.lit("added").alias("kind"), "id").union(facts.added(c, p, ["id"]).select(F.lit("removed").alias("kind"), "id"))


def rate_limited(s, d):
    calls = A.table(s, d, "events").select(F.col("event_type").alias("channel"), "ts")
    return history.accepted_calls(calls, 3600, 3)


def billing(column) -> Query:
    return lambda s, d: services(s, d).select("id", *column())


def repositories(s, d):
    return services(s, d).select("repo_id").distinct()


def doctor_rows(s, d):
    repos = repositories(s, d).select("repo_id", (F.col("repo_id") % 3 != 0).alias("has_config"), (F.col("repo_id") % 3 != 0).alias("config_valid"), F.when(F.col("repo_id") % 2 == 0, "p").alias("project_name"))
    return health.doctor(services(s, d), repos, queries_more.counts(s, d))


def made_badges(s, d):
    found = queries_more.counts(s, d)
    score = health.health_score(health.health_checks(services(s, d), as_of(), found))
    sizes = services(s, d).groupBy("repo_id").agg(F.count("*").alias("services"))
    needs = deps(s, d).groupBy("repo_id").agg(F.count("*").alias("dependencies"))
    known = found.select("repo_id", (F.col("critical") + F.col("high") + F.col("medium") + F.col("low") + F.col("unknown")).alias("vulnerabilities"))
    rows = score.join(sizes, "repo_id").join(known, "repo_id", "left").join(needs, "repo_id", "left").fillna(0, ["vulnerabilities", "dependencies"])
    return reports.badge_urls(rows.withColumn("scanned", F.lit(AS_OF)))


def structure(s, d):
    rows = graph.prepared(services(s, d))
    return graph.structure_hash(graph.nodes(rows.select("repo_id").distinct(), rows), graph.edges(rows))


host = lambda: E.host_of(F.col("url")).alias("host")
plain_host = lambda: F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))

QUERIES: dict[str, Query] = {
    "service_inventory": lambda s, d: inventory_of_evidence(ev(s, d))[0],
    "cls00_classify": classified(None), "cls01_env_var": classified("env_var"), "cls02_url_host": classified("url"), "cls03_npm": classified("npm_package"),
    "cls04_import": classified("import"), "cls05_config": classified("config_file"), "cls06_ci_secret": classified("ci_secret"), "cls07_domain": classified("domain"),
    "fn01_hosts": on("pages", "page_id", host),
    "fn02_ignored": on("pages", "page_id", lambda: E.is_ignored_exact(plain_host()).alias("exact"), lambda: E.is_ignored_suffix(plain_host()).alias("suffix")),
    "fn04_apex": on("pages", "page_id", lambda: E.apex(F.col("url")).alias("apex")),
    "fn08_title": on("part", "p_partkey", lambda: E.title_case(F.col("p_name")).alias("title")),
    "fn09_category": on("part", "p_partkey", lambda: E.category_of(F.col("p_name")).alias("category")),
    "fn13_key": on("part", "p_partkey", lambda: E.service_key(F.col("p_name")).alias("key")),
    "fn19_next_date": billing(lambda: [health.effective_next_date().alias("next_billing")]),
    "fn21_threshold": billing(lambda: [E.renewal_threshold(F.col("billing_type"), F.col("period")).alias("threshold")]),
    "fn22_monthly": billing(lambda: [F.round(E.monthly_amount(F.col("period"), F.col("amount")), 4).alias("monthly"), F.round(E.yearly_amount(F.col("period"), F.col("amount")), 4).alias("yearly")]),
    "fn24_version": lambda s, d: deps(s, d).select("ord", E.strip_version_prefix(F.col("version")).alias("bare")),
    "fn25_purl": lambda s, d: deps(s, d).select("ord", E.purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"), E.spdx_id(F.col("name")).alias("spdx")),
    "fn27_uuid": on("part", "p_partkey", lambda: E.namespace_uuid("seed:", F.col("p_name")).alias("uuid")),
    "fn28_path_hash": on("part", "p_partkey", lambda: E.path_hash(F.col("p_name")).alias("hash")),
    "fn31_escape": on("pages", "page_id", lambda: E.html_escape(F.col("html")).alias("escaped")),
    "fn36_badge": lambda s, d: health.renewals(services(s, d), F.lit("2024-01-01")).select("id", "days", "badge"),
    "agg01_best_per_type": lambda s, d: grouping.best_per_type(keyed_evidence(s, d)),
    "agg02_final_score": lambda s, d: grouping.final_score(keyed_evidence(s, d)),
    "agg03_first_category": lambda s, d: keyed_evidence(s, d).groupBy("repo_id", "key").agg(grouping.first_category().alias("category")),
    "agg04_longest_name": lambda s, d: keyed_evidence(s, d).groupBy("repo_id", "key").agg(grouping.longest_name().alias("name")),
    "agg05_reasons": lambda s, d: grouping.ordered_reasons(keyed_results(s, d)).withColumn("reasons", F.array_join("reasons", "|")),
    "agg06_best_evidence": lambda s, d: grouping.best_evidence(keyed_results(s, d)),
    "agg07_dep_dedup": lambda s, d: grouping.unique_dependencies(deps(s, d)),
    "agg08_by_category": lambda s, d: health.counts_by(services(s, d), "category"),
    "agg09_by_ecosystem": lambda s, d: health.counts_by(deps(s, d), "ecosystem"),
    "agg10_confidence": lambda s, d: health.confidence_breakdown(services(s, d), "repo_id"),
    "agg11_cost_by_category": lambda s, d: health.cost_by_category(services(s, d)).withColumn("total", F.round("total", 2)),
    "agg12_totals": lambda s, d: health.totals(services(s, d), "repo_id").withColumn("total_monthly", F.round("total_monthly", 2)).withColumn("total_yearly", F.round("total_yearly", 2)),
    "agg14_checks": lambda s, d: health.health_checks(services(s, d), as_of()),
    "agg15_score": lambda s, d: health.health_score(health.health_checks(services(s, d), as_of())),
    "agg16_history_stats": lambda s, d: history.stats(A.adapted(s, d, A.HISTORY)),
    "agg18_activity": lambda s, d: health.activity_counts(services(s, d), "repo_id"),
    "agg19_doctor": doctor_rows,
    "agg19_doctor_summary": lambda s, d: health.doctor_summary(doctor_rows(s, d)),
    "agg21_sources": lambda s, d: health.source_counts(services(s, d), "repo_id"),
    "agg22_share": lambda s, d: health.share_summary(services(s, d), deps(s, d)),
    "agg23_information": lambda s, d: health.information_counts(services(s, d), "repo_id"),
    "agg24_deps_by_type": lambda s, d: health.dependencies_by_type(deps(s, d)),
    "jn01_prefix_merge": lambda s, d: grouping.prefix_roots(keyed_results(s, d)),
    "jn02_brands": lambda s, d: grouping.collapse_brands(grouping.merge_related(grouping.groups_of(keyed_results(s, d)))).select("repo_id", "key", "name", "category", grouping.total(F.col("scores")).alias("score")),
    "jn03_generic_removal": lambda s, d: grouping.split_generic(results(s, d).select("repo_id", F.col("service_name").alias("name"), "category").distinct())[1].select("repo_id", "name", "category"),
    "jn04_contains_join": lambda s, d: facts.service_files(secrets_as_services(s, d), ev(s, d)),
    "jn05_last_activity": lambda s, d: facts.last_activity(secrets_as_services(s, d), ev(s, d), A.adapted(s, d, A.COMMIT), as_of()),
    "jn08_added": lambda s, d: facts.added(previous(s, d), current(s, d), ["repo_id", "id"]).select("repo_id", "id", "category"),
    "jn08_removed": lambda s, d: facts.added(current(s, d), previous(s, d), ["repo_id", "id"]).select("repo_id", "id", "category"),
    "jn09_changed": lambda s, d: facts.changed(previous(s, d), current(s, d)).select("repo_id", "id", "category", "previous_category"),
    "jn10_dep_diff": lambda s, d: facts.added(deps(s, d).where("ord % 5 <> 0"), deps(s, d).where("ord % 7 <> 0"), ["repo_id", "ecosystem", "name"]).select("repo_id", "ecosystem", "name").distinct(),
    "jn12_merge": merged,
    "win01_trend": lambda s, d: history.trend(A.adapted(s, d, A.HISTORY)).select("repo_id", "ts", "score", "delta"),
    "win04_rate_limit": rate_limited,
    "lim01_last_100": lambda s, d: history.kept(A.adapted(s, d, A.HISTORY)).select("repo_id", "ts", "score"),
    "gr02_virtual_nodes": lambda s, d: graph.virtual_nodes(repositories(s, d), services(s, d)).select("repo_id", "id", "label", "type"),
    "gr03_layers": lambda s, d: graph.placed(services(s, d)).select("repo_id", "id", "parent"),
    "gr04_edges": lambda s, d: graph.edges(graph.prepared(services(s, d))),
    "fn37_structure": structure,
    "sbom_purl": lambda s, d: reports.components(deps(s, d)).select("repo_id", "ord", "purl", "scope"),
    "snk02_markdown": lambda s, d: reports.report_lines(health.default_view(services(s, d)).withColumn("last_activity", F.col("last_renewed")).withColumn("days", F.when(F.col("ord") % 3 == 0, F.col("ord") % 400)), deps(s, d), queries_more.alternatives(s, d), F.lit(AS_OF)),
    "snk04_html": lambda s, d: reports.services_html(services(s, d)),
    "snk06_cyclonedx": lambda s, d: reports.cyclonedx(deps(s, d), F.lit("app"), F.lit(AS_OF)),
    "snk07_spdx": lambda s, d: reports.spdx(deps(s, d), F.lit("app"), F.lit(AS_OF)),
    "snk08_badges": made_badges,
    "flt01_default": lambda s, d: health.default_view(services(s, d)).select("id"),
    "flt02_facets": lambda s, d: health.facets(services(s, d), "service 1", plan="paid", activity="active").select("id"),
    "flt03_review": lambda s, d: health.to_review(services(s, d)).select("id"),
    "flt04_deps": lambda s, d: health.search_dependencies(deps(s, d), "-1", "peer").select("ord"),
    "flt08_notifications": lambda s, d: health.notifications(services(s, d), F.lit("2000-01-01")),
    "set02_ecosystems": lambda s, d: deps(s, d).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set(E.ecosystem_of(F.col("ecosystem")))), ",").alias("ecosystems")),
    "set03_id_difference": id_difference,
}

QUERIES |= queries_files.QUERIES | queries_more.QUERIES | queries_sources.QUERIES | queries_streams.QUERIES
