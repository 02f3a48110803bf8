"""Facts on services: activity (JN04-JN07), advisories (JN18, FN23), differences (JN08-JN11), merges (JN12-JN14, JN23), model actions (AI01, AI02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import rules
from ..sources.shared import written
from .containment import containing

# --- activity ----------------------------------------------------------------------------------


def service_files(services: DataFrame, evidences: DataFrame) -> DataFrame:
    """JN04: repo_id, id, file where a service's name stands in an evidence's value or file, and the file it was inferred from, if services name it."""
    named = services.select("repo_id", "id", F.lower("name").alias("needle"))
    seen = evidences.select("repo_id", "file", F.explode(F.array_distinct(F.array(F.lower("value"), F.lower("file")))).alias("hay")).where("hay IS NOT NULL").distinct()
    found = named.join(containing(named, seen, ["repo_id"]), ["repo_id", "needle"]).select("repo_id", "id", "hay").distinct()
    files = found.join(seen, ["repo_id", "hay"]).select("repo_id", "id", "file")
    if "inferred_from" in services.columns:
        files = files.unionByName(services.where("inferred_from <> ''").select("repo_id", "id", F.col("inferred_from").alias("file")))
    return files.distinct()


def last_activity(services: DataFrame, evidences: DataFrame, commits: DataFrame, as_of: Column) -> DataFrame:
    """JN05/JN06/FN16/FN18: repo_id, id, last_activity, days, status.

    The latest commit of a service's files; in repositories with over 50 such files the repository's latest commit
    counts for every service. Where services tell their source, only inferred ones are looked at.
    """
    if "source" in services.columns:
        services = services.where("source = 'inferred'")
    files = written(service_files(services, evidences), "service-files")
    by_file = commits.groupBy("repo_id", "file").agg(F.max("ts").alias("ts"))
    by_repo = commits.groupBy("repo_id").agg(F.max("ts").alias("repo_ts"))
    size = files.groupBy("repo_id").agg(F.countDistinct("file").alias("n_files"))
    own = files.join(by_file, ["repo_id", "file"], "left").groupBy("repo_id", "id").agg(F.max("ts").alias("ts"))
    rows = services.select("repo_id", "id").join(own, ["repo_id", "id"], "left").join(size, "repo_id", "left").join(by_repo, "repo_id", "left")
    latest = F.when(F.coalesce("n_files", F.lit(0)) > rules.MAX_ACTIVITY_FILES, F.col("repo_ts")).otherwise(F.col("ts"))
    dated = rows.select("repo_id", "id", latest.alias("last_activity")).withColumn("days", E.days_between(F.col("last_activity"), as_of))
    return dated.withColumn("status", E.activity_status(F.col("days")))


def with_activity(services: DataFrame, activity: DataFrame) -> DataFrame:
    """JN07."""
    return services.join(activity, ["repo_id", "id"], "left")


def relevant_files(services: DataFrame, evidences: DataFrame, most: int = 3) -> DataFrame:
    """JN22: repo_id, id, file, k: the first files (by ord) with a value that holds a service's id or its name without blanks.

    The bound on k is known before the shuffle, so each task sends `most` files of a service at most.
    """
    from pyspark.sql import Window

    spelled = F.array_distinct(F.array(F.lower(F.regexp_replace("name", r"(?U)\s", "")), F.lower("id")))
    named = services.select("repo_id", "id", F.explode(spelled).alias("needle"))
    seen = evidences.select("repo_id", "file", "ord", F.lower("value").alias("hay"))
    found = named.join(containing(named, seen, ["repo_id"]), ["repo_id", "needle"]).select("repo_id", "id", "hay").distinct()
    first = seen.where("hay IS NOT NULL").groupBy("repo_id", "hay", "file").agg(F.min("ord").alias("ord"))
    files = found.join(first, ["repo_id", "hay"]).groupBy("repo_id", "id", "file").agg(F.min("ord").alias("ord"))
    k = F.row_number().over(Window.partitionBy("repo_id", "id").orderBy("ord", "file"))
    return files.withColumn("k", k).where(F.col("k") <= most).drop("ord")


# --- advisories --------------------------------------------------------------------------------


def advisory_keys(dependencies: DataFrame) -> DataFrame:
    """Dependencies that an advisory source knows, with its ecosystem name and the bare version."""
    known = dependencies.withColumn("advisory_ecosystem", E.lookup(F.col("ecosystem"), rules.ADVISORY_ECOSYSTEMS)).where("advisory_ecosystem IS NOT NULL")
    return known.withColumn("bare_version", E.strip_version_prefix(F.col("version")))


def vulnerable(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """JN18/LIM02: one row for each found advisory of the first dependency with a name and ecosystem.

    advisories: advisory_ecosystem, name, version, at, id, summary, scores, and aliases, fixed_version, url where known. At most five (by at) count, summaries are cut.
    """
    from pyspark.sql import Window

    keyed = advisory_keys(dependencies)
    first = keyed.withColumn("k", F.row_number().over(Window.partitionBy("repo_id", "advisory_ecosystem", "name").orderBy("ord", "ecosystem", "version"))).where("k = 1").drop("k")
    hits = first.join(advisories.withColumnRenamed("version", "bare_version"), ["advisory_ecosystem", "name", "bare_version"])
    place = F.row_number().over(Window.partitionBy("repo_id", "ecosystem", "name").orderBy("at", "id"))
    return hits.withColumn("k", place).where(F.col("k") <= rules.ADVISORIES_KEPT).select("repo_id", "ecosystem", "name", "version", F.coalesce("id", F.lit("unknown")).alias("advisory"), F.left(F.coalesce("summary", F.lit("No description")), F.lit(rules.SUMMARY_CHARS)).alias("summary"), E.severity(F.col("scores")).alias("severity"), *[c for c in ("aliases", "fixed_version", "url") if c in advisories.columns])


def severity_counts(found: DataFrame) -> DataFrame:
    """AGG13."""
    return found.groupBy("repo_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "unknown")])


def advisory_badges(dependencies: DataFrame, found: DataFrame) -> DataFrame:
    """JN19: dependencies with the number of their advisories, by repository, ecosystem and name."""
    n = found.groupBy("repo_id", "ecosystem", "name").agg(F.count("*").alias("advisories"))
    return dependencies.join(n, ["repo_id", "ecosystem", "name"], "left").withColumn("advisories", F.coalesce("advisories", F.lit(0)))


def batches(dependencies: DataFrame, size: int = 100) -> DataFrame:
    """LIM05: dependencies in batches of a bounded number by repository, in their order, as requests take them."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("repo_id").orderBy("ord"))
    return dependencies.withColumn("batch", F.floor((k - 1) / size).cast("int"))


def gate(found: DataFrame, services: DataFrame) -> DataFrame:
    """FLT09: exit_code of each repository: 1 for a critical or high advisory, else 2 for a service to review, else 0."""
    bad = found.groupBy("repo_id").agg(F.bool_or(F.col("severity").isin("critical", "high")).alias("bad"))
    review = services.groupBy("repo_id").agg(F.bool_or("needs_review").alias("review"))
    both = review.join(bad, "repo_id", "full")
    return both.select("repo_id", F.when(F.coalesce("bad", F.lit(False)), 1).when(F.coalesce("review", F.lit(False)), 2).otherwise(0).alias("exit_code"))


# --- differences -------------------------------------------------------------------------------


def added(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """JN08/JN10/JN11: rows of current whose keys aren't in previous; swap the two for removals."""
    return current.join(previous.select(*keys).distinct(), keys, "left_anti")


def changed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """JN09: services of both with another category or confidence (a missing one counts as medium)."""
    before = previous.select("repo_id", "id", F.col("category").alias("previous_category"), F.coalesce("confidence", F.lit("medium")).alias("previous_confidence"))
    both = current.join(before, ["repo_id", "id"])
    return both.where(~F.col("category").eqNullSafe(F.col("previous_category")) | (F.coalesce("confidence", F.lit("medium")) != F.col("previous_confidence")))


def stack_diff(prev: DataFrame, cur: DataFrame, prev_deps: DataFrame, cur_deps: DataFrame) -> DataFrame:
    """All differences as change_kind, repo_id, entity."""
    service, dep = ["repo_id", "id"], ["repo_id", "ecosystem", "name"]
    dep_entity = F.concat_ws(":", "ecosystem", "name").alias("entity")
    parts = [
        added(prev, cur, service).select(F.lit("added").alias("change_kind"), "repo_id", F.col("id").alias("entity")),
        added(cur, prev, service).select(F.lit("removed").alias("change_kind"), "repo_id", F.col("id").alias("entity")),
        changed(prev, cur).select(F.lit("changed").alias("change_kind"), "repo_id", F.col("id").alias("entity")),
        added(prev_deps, cur_deps, dep).select(F.lit("dep_added").alias("change_kind"), "repo_id", dep_entity).distinct(),
        added(cur_deps, prev_deps, dep).select(F.lit("dep_removed").alias("change_kind"), "repo_id", dep_entity).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- merges ------------------------------------------------------------------------------------

#: Fields that a person edits and that a new scan keeps.
EDITED = ["owner", "billing", "notes", "comment", "account_email"]


def merge_services(inferred: DataFrame, manual: DataFrame, overrides: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """JN12 (MUT01): inferred services keep earlier edits; a manual service replaces the whole record; overrides set confidence."""
    rows = inferred
    if previous is not None:
        kept = [c for c in EDITED if c in inferred.columns and c in previous.columns]
        more = ["url"] if "url" in inferred.columns and "url" in previous.columns else []
        # one row a service, so that a repeated one doesn't multiply others; of several the greatest values
        old = previous.where("source = 'inferred'").groupBy("repo_id", "id").agg(F.max(F.struct(*kept, *more)).alias("_o")).select("repo_id", "id", *[F.col(f"_o.{c}").alias(f"_{c}") for c in kept + more])
        joined = rows.join(old, ["repo_id", "id"], "left")
        given = lambda c: F.col(f"_{c}").isNotNull() & (F.col(f"_{c}").cast("string") != "") if dict(inferred.dtypes)[c] == "string" else F.col(f"_{c}").isNotNull()
        cols = {c: F.when(given(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in kept}
        cols |= {c: F.when(given(c) & (F.coalesce(F.col(c), F.lit("")) == ""), F.col(f"_{c}")).otherwise(F.col(c)) for c in more}
        rows = joined.withColumns(cols).select(*inferred.columns)
    merged = rows.join(manual.select("repo_id", "id"), ["repo_id", "id"], "left_anti").select(*inferred.columns).unionByName(manual, allowMissingColumns=True)
    if overrides is not None:
        # MUT05: the last write wins, by ts where overrides have one
        last = F.max_by("confidence", "ts") if "ts" in overrides.columns else F.max("confidence")
        set_to = overrides.groupBy("repo_id", "id").agg(last.alias("_set"))
        merged = merged.join(set_to, ["repo_id", "id"], "left").withColumn("confidence", F.coalesce("_set", "confidence")).drop("_set")
    return merged


def merge_model(services: DataFrame, suggested: DataFrame) -> DataFrame:
    """JN13: suggestions raise confidence, fill category "other", append reasons, or add a service; those for one id one after another, by ord.

    Both have repo_id, id, name, category, confidence, needs_review, reasons; suggested has ord where its order matters. Suggestions without id
    or name are none. Applied in turn, they come to one: the highest confidence (of the first suggestion that has it) if it is above the service's; the first
    category that isn't "other"; all reasons. The first suggestion for an unknown id makes the service, which later ones change.
    """
    from pyspark.sql import Window

    order = F.col("ord") if "ord" in suggested.columns else F.lit(0)
    rows = suggested.withColumn("_o", order).where("id IS NOT NULL AND id <> '' AND name IS NOT NULL AND name <> ''")
    none, kept = F.array().cast("array<string>"), services.withColumn("there", F.lit(True))
    step = Window.partitionBy("repo_id", "id").orderBy("_o", "name", "confidence", "category")
    rows = rows.withColumn("_k", F.row_number().over(step))
    new = rows.groupBy("repo_id", "id").agg(
        F.min_by(F.struct("name", F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("confidence", F.lit("medium")).alias("confidence")), "_k").alias("one"),
        F.max(F.when(F.col("confidence").isNotNull(), F.struct(E.confidence_rank(F.col("confidence")).alias("rank"), (-F.col("_k")).alias("k"), "confidence"))).alias("best"),
        F.min(F.when(F.col("category") != "other", F.struct("_k", "category"))).alias("_category"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("reasons", none).alias("r")))), lambda x: x["r"])).alias("_reasons"),
    )
    both = kept.join(new, ["repo_id", "id"], "full")
    there = F.coalesce("there", F.lit(False))
    base = F.when(there, F.coalesce("confidence", F.lit("low"))).otherwise(F.col("one.confidence"))
    higher = F.coalesce(F.col("best.rank") > E.confidence_rank(base), F.lit(False))
    start = F.when(there, F.col("category")).otherwise(F.col("one.category"))
    return both.select(
        "repo_id", "id", F.when(there, F.col("name")).otherwise(F.col("one.name")).alias("name"),
        F.when(start == "other", F.coalesce(F.col("_category.category"), start)).otherwise(start).alias("category"),
        F.when(higher, F.col("best.confidence")).when(there, F.col("confidence")).otherwise(base).alias("confidence"),
        F.when(higher, F.col("best.confidence") == "low").when(there, F.col("needs_review")).otherwise(base == "low").alias("needs_review"),
        F.concat(F.coalesce("reasons", none), F.coalesce("_reasons", none)).alias("reasons"),
    )


def overlay_config(services: DataFrame, config: DataFrame) -> DataFrame:
    """JN14: owner, billing and plan of the first configured service with the same id or name (by ord).

    Only the first of each id and of each name is joined: a service meets two rows at most, however many share its name.
    """
    fields = [c for c in ("owner", "billing", "plan") if c in config.columns and c in services.columns]
    least = lambda key: config.groupBy("repo_id", F.col(key).alias("_k")).agg(F.min_by(F.struct(*fields), F.col("ord")).alias("o"), F.min("ord").alias("ord"))
    by = lambda key: services.select("repo_id", F.col("id").alias("_sid"), F.col(key).alias("_k")).join(least(key), ["repo_id", "_k"]).drop("_k")
    first = by("id").unionByName(by("name")).groupBy("repo_id", "_sid").agg(F.min_by("o", "ord").alias("o"))
    joined = services.join(first.withColumnRenamed("_sid", "id"), ["repo_id", "id"], "left")
    return joined.withColumns({c: F.coalesce(F.col(f"o.{c}"), F.col(c)) for c in fields}).select(*services.columns)


def restore(discarded: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN23: chosen (repo_id, name) items become services to review; the rest stay discarded."""
    back = discarded.join(chosen.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_semi")
    services = back.select("repo_id", E.service_key(F.col("name")).alias("id"), "name", "category", F.lit("low").alias("confidence"), F.lit(True).alias("needs_review"))
    return services, discarded.join(chosen.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_anti")


def keep_listed(services: DataFrame, keep: DataFrame) -> DataFrame:
    """AI01: services whose id is in keep; a repository for which that leaves none keeps all."""
    flagged = services.join(keep.select("repo_id", "id").distinct().withColumn("_k", F.lit(True)), ["repo_id", "id"], "left").withColumn("_k", F.coalesce("_k", F.lit(False)))
    some = flagged.groupBy("repo_id").agg(F.bool_or("_k").alias("_some"))
    return flagged.join(some, "repo_id").where("_k OR NOT _some").drop("_k", "_some")


def apply_actions(services: DataFrame, actions: DataFrame) -> DataFrame:
    """AI02: actions (repo_id, id, action, value): merge (value: the id that stays), category, confidence, remove, in this order.

    High-confidence services are never touched. A merge counts only between two other services of the repository: the merged one goes, and
    its reasons (if services have any) are added to the other's, by the actions' ord if they have one, else by id. Unknown categories and confidences count for
    nothing. A service that is merged away after it took reasons itself takes only its own with it.
    """
    fixed, open_ = services.where("confidence = 'high'"), services.where("confidence IS NULL OR confidence <> 'high'")
    pick = lambda kind: actions.where(F.col("action") == kind).groupBy("repo_id", "id").agg(F.max("value").alias(f"_{kind}"))
    ids = open_.select("repo_id", "id").distinct()
    order = F.col("ord") if "ord" in actions.columns else F.lit(0)
    pairs = actions.where("action = 'merge' AND value <> id").select("repo_id", "id", F.col("value").alias("to"), order.alias("o"))
    pairs = pairs.join(ids, ["repo_id", "id"], "left_semi").join(ids.withColumnRenamed("id", "to"), ["repo_id", "to"], "left_semi")
    rest = open_.join(pairs.select("repo_id", "id").distinct(), ["repo_id", "id"], "left_anti")
    if "reasons" in services.columns:
        none = F.array().cast("array<string>")
        taken = pairs.join(open_.select("repo_id", "id", F.coalesce("reasons", none).alias("r")), ["repo_id", "id"])
        taken = taken.groupBy("repo_id", F.col("to").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", "id", "r"))), lambda x: x["r"])).alias("_taken"))
        rest = rest.join(taken, ["repo_id", "id"], "left").withColumn("reasons", F.when(F.col("_taken").isNotNull(), F.concat(F.coalesce("reasons", none), "_taken")).otherwise(F.col("reasons"))).drop("_taken")
    set_ = rest.join(pick("category"), ["repo_id", "id"], "left").join(pick("confidence"), ["repo_id", "id"], "left")
    level = F.lower(F.trim("_confidence"))
    ok = F.coalesce(level.isin("high", "medium", "low"), F.lit(False))
    set_ = set_.withColumn("category", F.when(F.coalesce(F.col("_category").isin(rules.CATEGORIES), F.lit(False)), F.col("_category")).otherwise(F.col("category")))
    set_ = set_.withColumn("needs_review", F.when(ok, level == "low").otherwise(F.col("needs_review"))).withColumn("confidence", F.when(ok, level).otherwise(F.col("confidence")))
    removed = actions.where("action = 'remove'").select("repo_id", "id").distinct()
    return fixed.unionByName(set_.drop("_category", "_confidence").join(removed, ["repo_id", "id"], "left_anti").select(*services.columns))
