"""Sinks: bills of materials (FN25-FN27, SNK06, SNK07), badges (SNK08), reports (SNK01-SNK04, SNK12), snapshots and history (SNK09-SNK11).

Documents are one row a repository, built by aggregates; product names are parameters, not constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E


def components(dependencies: DataFrame) -> DataFrame:
    """Dependencies with their package URL, scope and SPDX id."""
    scope = F.when(F.col("type") == "production", "required").otherwise("optional")
    return dependencies.select("repo_id", "ecosystem", "name", "version", "ord", E.purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"), scope.alias("scope"), F.concat(F.lit("SPDXRef-Package-"), E.spdx_id(F.col("name"))).alias("spdx_id"))


def cyclonedx(dependencies: DataFrame, project: Column, created: Column, tool: tuple[str, str, str] = ("svcgraph", "svcgraph", "1")) -> DataFrame:
    """SNK06: repo_id, document (CycloneDX 1.5 as JSON)."""
    item = F.struct(F.col("ord"), F.struct(F.lit("library").alias("type"), "name", "version", "purl", "scope").alias("c"))
    packed = components(dependencies).groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)), lambda x: x["c"]).alias("components"))
    vendor, name, version = (F.lit(x) for x in tool)
    meta = F.struct(created.alias("timestamp"), F.array(F.struct(vendor.alias("vendor"), name.alias("name"), version.alias("version"))).alias("tools"), F.struct(F.lit("application").alias("type"), project.alias("name")).alias("component"))
    return packed.select("repo_id", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), meta.alias("metadata"), "components")).alias("document"))


def spdx(dependencies: DataFrame, project: Column, created: Column, seed: str = "svcgraph:", creator: str = "Tool: svcgraph-1") -> DataFrame:
    """SNK07: repo_id, document (SPDX 2.3 as JSON); the namespace is a hash of seed and project."""
    ref = F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))
    package = F.struct(F.col("spdx_id").alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), ref.alias("externalRefs"))
    order = lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
    packed = components(dependencies).groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", package.alias("p"))), order), lambda x: x["p"]).alias("packages"))
    space = F.concat(F.lit("https://spdx.org/spdxdocs/"), project, F.lit("-"), E.namespace_uuid(seed, project))
    head = [F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), project.alias("name"), space.alias("documentNamespace")]
    return packed.select("repo_id", F.to_json(F.struct(*head, F.struct(created.alias("created"), F.array(F.lit(creator)).alias("creators")).alias("creationInfo"), "packages")).alias("document"))


# --- the same in lines, for repositories of any size ------------------------------------------------


def array_lines(items: DataFrame, head: Column, tail: str) -> DataFrame:
    """repo_id, section, place, line of JSON documents: what comes before an array, its items (repo_id, place, item) a line each, and what closes it.

    In the order of section and place the lines are the document; places differ within a repository. No row holds a whole document.
    """
    first = items.groupBy("repo_id").agg(F.min("place").alias("first"))
    comma = F.when(F.col("place") == F.col("first"), "").otherwise(",")
    body = items.join(first, "repo_id").select("repo_id", F.lit(1).alias("section"), F.col("place").cast("long").alias("place"), F.concat(comma, "item").alias("line"))
    ends = F.array(F.struct(F.lit(0).alias("section"), head.alias("line")), F.struct(F.lit(2).alias("section"), F.lit(tail).alias("line")))
    return body.unionByName(first.select("repo_id", F.explode(ends).alias("e")).select("repo_id", "e.section", F.lit(0).cast("long").alias("place"), "e.line"))


def _opened(head: Column, name: str) -> Column:
    """A JSON object up to the start of one more field, an array."""
    text = F.to_json(head)
    return F.concat(F.left(text, F.length(text) - 1), F.lit(f',"{name}":['))


def cyclonedx_lines(dependencies: DataFrame, project: Column, created: Column, tool: tuple[str, str, str] = ("svcgraph", "svcgraph", "1")) -> DataFrame:
    """SNK06 as lines."""
    vendor, name, version = (F.lit(x) for x in tool)
    meta = F.struct(created.alias("timestamp"), F.array(F.struct(vendor.alias("vendor"), name.alias("name"), version.alias("version"))).alias("tools"), F.struct(F.lit("application").alias("type"), project.alias("name")).alias("component"))
    head = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), meta.alias("metadata"))
    items = components(dependencies).select("repo_id", F.col("ord").alias("place"), F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", "purl", "scope")).alias("item"))
    return array_lines(items, _opened(head, "components"), "]}")


def spdx_lines(dependencies: DataFrame, project: Column, created: Column, seed: str = "svcgraph:", creator: str = "Tool: svcgraph-1") -> DataFrame:
    """SNK07 as lines."""
    ref = F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))
    package = F.struct(F.col("spdx_id").alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), ref.alias("externalRefs"))
    space = F.concat(F.lit("https://spdx.org/spdxdocs/"), project, F.lit("-"), E.namespace_uuid(seed, project))
    head = F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), project.alias("name"), space.alias("documentNamespace"), F.struct(created.alias("created"), F.array(F.lit(creator)).alias("creators")).alias("creationInfo"))
    return array_lines(components(dependencies).select("repo_id", F.col("ord").alias("place"), F.to_json(package).alias("item")), _opened(head, "packages"), "]}")


def services_json_lines(services: DataFrame) -> DataFrame:
    """SNK01 as lines, by ord."""
    columns = [c for c in services.columns if c not in ("repo_id", "id", "ord")]
    return array_lines(services.select("repo_id", F.col("ord").alias("place"), F.to_json(F.struct("id", *columns)).alias("item")), F.lit("["), "]")


# --- badges --------------------------------------------------------------------------------------

BADGES = "https://img.shields.io/badge/"


def badge_urls(rows: DataFrame, product: str = "svcgraph") -> DataFrame:
    """SNK08: rows (repo_id, score, services, vulnerabilities, dependencies, scanned date) -> repo_id, kind, url, markdown, html."""
    colour = F.when(E.score_band(F.col("score")) == "green", "brightgreen").otherwise(E.score_band(F.col("score")))
    text = lambda c: F.col(c).cast("string")
    vulnerable = F.when(F.col("vulnerabilities") == 0, "3d8c5e").otherwise("c05050")
    made = [
        ("score", F.concat(F.lit("Stack_Score-"), text("score"), F.lit("%2F100-"), colour), F.concat(F.lit("Stack Score: "), text("score"), F.lit("/100"))),
        ("services", F.concat(F.lit(f"{product}-"), text("services"), F.lit("%20services-gold")), F.concat(F.lit("Services: "), text("services"))),
        ("vulnerabilities", F.concat(F.lit("Vulnerabilities-"), text("vulnerabilities"), F.lit("_found-"), vulnerable), F.concat(F.lit("Vulnerabilities: "), text("vulnerabilities"), F.lit(" found"))),
        ("dependencies", F.concat(F.lit("Dependencies-"), text("dependencies"), F.lit("_tracked-4a8ab0")), F.concat(F.lit("Dependencies: "), text("dependencies"), F.lit(" tracked"))),
        ("scanned", F.concat(F.lit("Scanned-"), F.replace(text("scanned"), F.lit("-"), F.lit("--")), F.lit("-8090a6")), F.concat(F.lit("Scanned: "), text("scanned"))),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(F.lit(BADGES), u).alias("url"), label.alias("label")) for k, u, label in made])
    flat = rows.select("repo_id", F.inline(each))
    markdown = F.concat(F.lit("!["), "label", F.lit("]("), "url", F.lit(")"))
    html = F.concat(F.lit('<img src="'), "url", F.lit('" alt="'), "label", F.lit('" />'))
    return flat.select("repo_id", "kind", "url", markdown.alias("markdown"), html.alias("html"))


def badge_svg(score: Column, label: str = "Stack Score") -> Column:
    """SNK08: a flat badge; its shapes are this engine's own."""
    fill = F.when(E.score_band(score) == "green", "#3d8c5e").when(E.score_band(score) == "yellow", "#e2b04a").otherwise("#c05050")
    value = F.concat(score.cast("string"), F.lit("/100"))
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="140" height="20"><rect width="84" height="20" fill="#555"/><rect x="84" width="56" height="20" fill="'), fill, F.lit(f'"/><g fill="#fff" font-family="sans-serif" font-size="11"><text x="8" y="14">{label}</text><text x="92" y="14">'), value, F.lit("</text></g></svg>"))


# --- reports -------------------------------------------------------------------------------------


def _lines(rows: DataFrame, order: list[Column], line: Column) -> DataFrame:
    packed = rows.select("repo_id", F.struct(*order).alias("o"), line.alias("line")).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("l"))
    return packed.select("repo_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def report_lines(services: DataFrame, dependencies: DataFrame | None = None, alternatives: DataFrame | None = None, date: Column | None = None) -> DataFrame:
    """SNK02: repo_id, section, block, place, line of a report; in this order the lines are the document, and no row holds a whole one.

    Sections: 0 title, 1 services by category (categories in order of their first service), 2 dependencies, 3 services without
    activity, 4 alternatives, 5 end. services: repo_id, name, category, plan, confidence, ord and, where known, status,
    last_activity, days; dependencies: repo_id, name, version, type, ecosystem, ord; alternatives: repo_id, ord, service_name, name, type, savings, reason.
    """
    last = (1 << 63) - 1
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("undefined"))
    cells = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    long = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("long")

    def rows(of: DataFrame, section: int, block, place, line: Column) -> DataFrame:
        return of.select("repo_id", F.lit(section).alias("section"), long(block).alias("block"), long(place).alias("place"), line.alias("line"))

    def fixed(of: DataFrame, section: int, block, before: list, after: bool = True) -> DataFrame:
        """Lines before all places of a block (the first at a lowest place), and an empty one behind."""
        made = [F.struct(F.lit(i - len(before) - 1).alias("p"), (F.lit(x) if isinstance(x, str) else x).alias("l")) for i, x in enumerate(before)]
        made += [F.struct(F.lit(last).alias("p"), F.lit("").alias("l"))] * after
        return rows(of.select("*", F.explode(F.array(*made)).alias("_f")), section, block, F.col("_f.p"), F.col("_f.l"))

    categories = services.groupBy("repo_id", "category").agg(F.min("ord").alias("first"))
    repos = services.select("repo_id").distinct()
    title = F.concat(F.upper(F.left("category", F.lit(1))), F.expr("substring(category, 2)"))
    in_group = services.join(categories, ["repo_id", "category"])
    parts = []
    if dependencies is not None:
        repos = repos.unionByName(dependencies.select("repo_id")).distinct()
        counted = dependencies.groupBy("repo_id").agg(F.count("*").alias("n"))
        parts += [
            fixed(counted, 2, 0, [F.concat(F.lit("## Dependencies ("), F.col("n").cast("string"), F.lit(")")), "", "| Name | Version | Type | Ecosystem |", "|---|---|---|---|"]),
            rows(dependencies, 2, 0, F.col("ord"), cells(*map(text, ("name", "version", "type", "ecosystem")))),
        ]
    if "status" in services.columns:
        day = F.coalesce(F.date_format("last_activity", "yyyy-MM-dd"), F.lit("unknown")) if "last_activity" in services.columns else F.lit("unknown")
        ago = F.when(F.col("days").isNotNull(), F.concat(F.lit(", "), F.col("days").cast("string"), F.lit(" days ago"))).otherwise("") if "days" in services.columns else F.lit("")
        item = F.concat(F.lit("- **"), text("name"), F.lit("** (last activity: "), day, ago, F.lit(")"))
        idle = services.where("status IN ('zombie', 'stale')")
        parts.append(fixed(idle.select("repo_id").distinct(), 3, 0, ["## Zombie Services", ""], after=False))
        for block, (status, head) in enumerate((("zombie", "### Zombie (6+ months inactive)"), ("stale", "### Stale (3-6 months inactive)")), 1):
            some = idle.where(F.col("status") == status)
            parts += [fixed(some.select("repo_id").distinct(), 3, block, [head, ""]), rows(some, 3, block, F.col("ord"), item)]
    if alternatives is not None:
        parts += [
            fixed(alternatives.select("repo_id").distinct(), 4, 0, ["## Stack Alternatives", "", "| Service | Alternative | Type | Savings | Reason |", "|---|---|---|---|---|"]),
            rows(alternatives, 4, 0, F.col("ord"), cells(text("service_name"), text("name"), text("type"), F.coalesce("savings", F.lit("-")), text("reason"))),
        ]
    on = F.current_date() if date is None else date
    out = fixed(repos, 0, 0, [F.concat(F.lit("# Services - "), F.col("repo_id").cast("string")), "", F.concat(F.lit("Generated on "), on.cast("string")), ""], after=False)
    out = out.unionByName(fixed(categories, 1, F.col("first"), [F.concat(F.lit("## "), title), "", "| Service | Plan | Confidence |", "|---|---|---|"]))
    out = out.unionByName(rows(in_group, 1, F.col("first"), F.col("ord"), cells(text("name"), text("plan"), F.coalesce("confidence", F.lit("medium")))))
    for part in parts:
        out = out.unionByName(part)
    return out.unionByName(fixed(repos, 5, 0, ["---"], after=False))


#: Columns whose order is that of a report's lines.
LINE_ORDER = ["repo_id", "section", "block", "place"]


def services_html(services: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """SNK04: services and, if given, labelled edges as escaped HTML."""
    td = lambda c: F.concat(F.lit("<td>"), E.html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    rows = _lines(services, [F.col("category"), F.col("name")], F.concat(F.lit("<tr>"), td("name"), td("category"), td("plan"), F.lit("</tr>")))
    out = rows.select("repo_id", F.concat(F.lit("<table>\n"), "body", F.lit("\n</table>")).alias("document"))
    if edges is None:
        return out
    items = _lines(edges, [F.col("source_label"), F.col("target_label")], F.concat(F.lit("<li>"), E.html_escape(F.col("source_label")), F.lit(" &rarr; "), E.html_escape(F.col("target_label")), F.lit("</li>"))).withColumnRenamed("body", "list")
    return out.join(items, "repo_id", "left").select("repo_id", F.concat("document", F.coalesce(F.concat(F.lit("\n<ul>\n"), "list", F.lit("\n</ul>")), F.lit(""))).alias("document"))


def services_json(services: DataFrame) -> DataFrame:
    """SNK01: all services of a repository as one JSON array, by id."""
    columns = [c for c in services.columns if c not in ("repo_id", "id")]
    return services.groupBy("repo_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", *columns)))).alias("document"))


def summary_lines(services: DataFrame) -> DataFrame:
    """SNK03: one line a category with its number of services."""
    counted = services.groupBy("repo_id", "category").agg(F.count("*").alias("n"))
    return _lines(counted, [-F.col("n"), F.col("category")], F.concat("category", F.lit(": "), F.col("n").cast("string"))).withColumnRenamed("body", "document")


def diff_markdown(diff: DataFrame) -> DataFrame:
    """SNK12: stack_diff rows as a list, grouped by kind."""
    return _lines(diff, [F.col("change_kind"), F.col("entity")], F.concat(F.lit("- "), F.replace("change_kind", F.lit("_"), F.lit(" ")), F.lit(": "), "entity")).withColumnRenamed("body", "document")


# --- tables ----------------------------------------------------------------------------------------


def write_snapshot(rows: DataFrame, path: str) -> None:
    """SNK09: the repositories in rows are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def append_history(entries: DataFrame, path: str, run: str) -> None:
    """SNK10: the entries of a run, in a folder of its own, so that one that is written again replaces itself; history.kept() is the view with the bound."""
    entries.write.mode("overwrite").parquet(f"{path}/run={run}")


#: SNK11. Fields that a stored configuration encrypts.
SENSITIVE = ["account_email", "owner", "notes"]


def encrypted(rows: DataFrame, key: Column) -> DataFrame:
    """SNK11: sensitive fields as base64 of AES-GCM; decrypted() is its inverse."""
    return rows.withColumns({c: F.base64(F.aes_encrypt(F.col(c), key)) for c in SENSITIVE if c in rows.columns})


def decrypted(rows: DataFrame, key: Column) -> DataFrame:
    return rows.withColumns({c: F.decode(F.aes_decrypt(F.unbase64(F.col(c)), key), "UTF-8") for c in SENSITIVE if c in rows.columns})
