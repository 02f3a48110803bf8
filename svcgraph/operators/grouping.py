"""AGG01-AGG07, JN01-JN03, FLT06-FLT07: results become services and discarded items.

Every step is a key-based aggregate or an equi-join on (repo_id, key); rows that share a key are
combined map-side before any shuffle. Order rules ("first", "earliest") go by (ord, reason).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import rules


def keyed(results: DataFrame) -> DataFrame:
    """Adds key and type_key; names without a letter or digit go."""
    return results.withColumn("key", E.service_key(F.col("service_name"))).where("key <> ''").withColumn("type_key", E.type_key(F.col("evidence_type")))


def best_per_type(rows: DataFrame) -> DataFrame:
    """AGG01: repo_id, key, type_key, score (the best of each type; instances don't add)."""
    return rows.groupBy("repo_id", "key", "type_key").agg(F.max("score").cast("int").alias("score"))


def final_score(rows: DataFrame) -> DataFrame:
    """AGG02: repo_id, key, final_score (sum over types)."""
    return best_per_type(rows).groupBy("repo_id", "key").agg(F.sum("score").cast("int").alias("final_score"))


def first_category() -> Column:
    """AGG03: the earliest category that isn't other."""
    return F.coalesce(F.expr("min_by(category, struct(ord, reason)) FILTER (WHERE category <> 'other')"), F.lit("other"))


def longest_name() -> Column:
    """AGG04: the longest name, the earliest on ties."""
    return F.max_by("service_name", F.struct(F.length("service_name"), -F.col("ord")))


def ordered_reasons(rows: DataFrame) -> DataFrame:
    """AGG05: repo_id, key, reasons array<string> in order of first appearance, distinct."""
    once = rows.groupBy("repo_id", "key", "reason").agg(F.min("ord").alias("o"))
    return once.groupBy("repo_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "reason"))), lambda x: x["reason"]).alias("reasons"))


def best_evidence(rows: DataFrame) -> DataFrame:
    """AGG06: the best-scored reason of each type, the earliest on ties."""
    best = F.min_by(F.struct("reason", "evidence_type", "score"), F.struct(-F.col("score"), F.col("ord"), F.col("reason")))
    return rows.groupBy("repo_id", "key", "type_key").agg(best.alias("b")).select("repo_id", "key", "type_key", F.col("b.evidence_type").alias("evidence_type"), F.col("b.reason").alias("reason"), F.col("b.score").alias("score"))


def prefix_roots(keys: DataFrame, carried: str | None = None) -> DataFrame:
    """JN01: repo_id, key -> root, the shortest present key that is the key itself or a prefix of it up to a dash.

    Each key goes to all its dash prefixes; a prefix that is a key itself answers to those under it. Two
    aggregates by equality do what a prefix join would, with one pass over keys. A carried column comes along.
    """
    extra = [carried] if carried else []
    parts = F.split("key", "-")
    rows = (keys.select("repo_id", "key", *extra) if carried else keys.select("repo_id", "key").distinct()).withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))))
    there = rows.groupBy("repo_id", "prefix").agg(F.max(F.col("key") == F.col("prefix")).alias("present"), F.collect_list(F.struct("key", *extra)).alias("under"))
    answered = there.where("present").select("repo_id", "prefix", F.inline("under"))
    return answered.groupBy("repo_id", "key").agg(F.min_by("prefix", F.length("prefix")).alias("root"), *[F.first(c).alias(c) for c in extra])


def groups_of(rows: DataFrame) -> DataFrame:
    """One row a key: repo_id, key, name, category, scores map<type_key, best>, ord (first appearance), first_ord (of the category)."""
    by_type = rows.groupBy("repo_id", "key", "type_key").agg(
        F.max("score").cast("int").alias("score"), F.max(F.struct(F.length("service_name"), -F.col("ord"), "service_name")).alias("n"),
        F.min(F.when(F.col("category") != "other", F.struct("ord", "reason", "category"))).alias("c"), F.min("ord").alias("ord"),
    )
    return by_type.groupBy("repo_id", "key").agg(
        F.max("n").alias("n"), F.min("c").alias("c"), F.min("ord").alias("ord"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type_key", "score")))).alias("scores"),
    ).select("repo_id", "key", F.col("n.service_name").alias("name"), F.coalesce("c.category", F.lit("other")).alias("category"), "scores", "ord", F.col("c.ord").alias("first_ord"))


def merge_related(groups: DataFrame) -> DataFrame:
    """JN01 on groups: those under a root join it; the root gives the name, and the category unless it is other."""
    packed = groups.withColumn("g", F.struct("name", "category", "scores", "ord", "first_ord")).select("repo_id", "key", "g")
    rooted = prefix_roots(packed, "g")
    own = F.col("key") == F.col("root")
    merged = rooted.groupBy("repo_id", "root").agg(
        F.max(F.when(own, F.struct(F.col("g.name").alias("name"), F.col("g.category").alias("category"), F.col("g.ord").alias("ord")))).alias("o"),
        F.min(F.when(F.col("g.category") != "other", F.struct(F.col("g.first_ord").alias("f"), F.col("g.category").alias("category")))).alias("c"), F.collect_list("g.scores").alias("s"),
    )
    category = F.when(F.col("o.category") != "other", F.col("o.category")).otherwise(F.coalesce("c.category", F.lit("other")))
    return merged.select("repo_id", F.col("root").alias("key"), F.col("o.name").alias("name"), category.alias("category"), _combine(F.col("s")).alias("scores"), F.col("o.ord").alias("ord"))


def _combine(scores: list[Column] | Column) -> Column:
    """Best per type over an array of maps."""
    entries = F.flatten(F.transform(scores, lambda m: F.map_entries(m)))
    kinds = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.array_max(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]))))


def collapse_brands(groups: DataFrame) -> DataFrame:
    """JN02: "brand" and "brand-..." groups of a repository become one under the brand's key.

    With a root group, or with several, the name is the brand's; a single group keeps a name of one or
    two words. Brands apply in order, the first that fits a key takes it. The dimension is a constant list.
    """
    key = reduce(lambda k, v: F.when(k == v[0], F.lit(v[1])).otherwise(k), rules.KEY_VARIANTS, F.col("key"))
    variant = groups.withColumn("was", F.col("key")).withColumn("key", key)
    brand = reduce(lambda c, b: c.when(F.col("key").startswith(b + "-"), F.lit(b)), rules.KNOWN_BRANDS[1:], F.when(F.col("key").startswith(rules.KNOWN_BRANDS[0] + "-"), F.lit(rules.KNOWN_BRANDS[0])))
    to = variant.withColumn("to", F.coalesce(brand, F.col("key"))).withColumn("is_root", F.col("key") == F.coalesce(brand, F.col("key")))
    packed = to.groupBy("repo_id", "to").agg(
        F.countDistinct("key").alias("k"), F.max("is_root").alias("rooted"), F.max(F.when(~F.col("is_root"), True)).alias("has_parts"),
        F.array_sort(F.collect_list(F.struct(F.col("is_root").cast("int").alias("r"), "ord", "name", "category", "was"))).alias("g"), F.collect_list("scores").alias("s"),
    )
    ordered = F.when(F.col("rooted"), F.concat(F.filter("g", lambda g: g["r"] == 1), F.filter("g", lambda g: g["r"] == 0))).otherwise(F.col("g"))
    first = F.get(ordered, F.lit(0))
    # a spelled variant that stands alone takes the canonical spelling
    plain = reduce(lambda n, v: F.when((F.size("g") == 1) & (first["was"] == v[0]), E.title_case(F.lit(v[1]))).otherwise(n), rules.KEY_VARIANTS, first["name"])
    brand_name = E.title_case(F.col("to"))
    single = F.when(F.size(F.split(plain, r"\s+")) <= 2, plain).otherwise(brand_name)
    name = F.when(~F.coalesce("has_parts", F.lit(False)), plain).when(F.col("rooted") | (F.col("k") > 1), brand_name).otherwise(single)
    category = F.coalesce(F.get(F.filter(F.transform(ordered, lambda g: g["category"]), lambda c: c != "other"), F.lit(0)), F.lit("other"))
    return packed.select("repo_id", F.col("to").alias("key"), name.alias("name"), category.alias("category"), _combine(F.col("s")).alias("scores"), first["ord"].alias("ord"))


def total(scores: Column) -> Column:
    return F.aggregate(F.map_values(scores), F.lit(0), lambda a, x: a + x)


def split_generic(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN03: (kept, discarded): a generic name goes where a specific one has its category in the repository."""
    from pyspark.sql import Window

    generic = F.lower("name").isin(rules.GENERIC_SERVICES)
    marked = groups.withColumn("_lost", generic & F.max(~generic).over(Window.partitionBy("repo_id", "category")))
    return marked.where("NOT _lost").drop("_lost"), marked.where("_lost").drop("_lost")


def services_of(groups: DataFrame) -> DataFrame:
    """FLT07 and FLT06: groups of the least score and more, with confidence; names that slipped through go."""
    scored = groups.withColumn("final_score", total(F.col("scores")).cast("int")).where(F.col("final_score") >= rules.DISCARD_BELOW)
    high = F.col("final_score") > rules.HIGH_ABOVE
    services = scored.select("repo_id", F.col("key").alias("id"), "name", "category", "final_score", F.when(high, "high").otherwise("low").alias("confidence"), (~high).alias("needs_review"), "ord")
    return services.where(is_sane(F.col("name")))


def is_sane(name: Column) -> Column:
    """FLT06. Names that are parts of a runtime."""
    return (F.length(name) >= 3) & ~F.lower(name).isin("child process", "child_process", "file system", "event emitter", "buffer", "stream", "crypto") & ~name.startswith("$")


def discarded_of(groups: DataFrame, generic: DataFrame) -> DataFrame:
    """repo_id, name, reason, score, category: generic terms, and groups under the least score."""
    def item(df: DataFrame, reason: str) -> DataFrame:
        return df.select("repo_id", "name", F.lit(reason).alias("reason"), total(F.col("scores")).cast("int").alias("score"), "category")

    return item(generic, "generic_term").unionByName(item(groups, "low_score").where(F.col("score") < rules.DISCARD_BELOW))


def infer_services(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole grouping: (services, discarded)."""
    merged = merge_related(groups_of(keyed(results)))
    kept, lost = split_generic(collapse_brands(merged))
    return services_of(kept), discarded_of(kept, lost)


def unique_dependencies(deps: DataFrame) -> DataFrame:
    """AGG07: one row for each (repo_id, ecosystem, name), production first, then the earliest; ord is the first seen."""
    columns = [c for c in deps.columns if c not in ("repo_id", "ecosystem", "name", "ord")]
    best = F.min_by(F.struct(*columns), F.struct((F.col("type") != "production").cast("int"), F.col("ord"), *columns))
    return deps.groupBy("repo_id", "ecosystem", "name").agg(best.alias("d"), F.min("ord").alias("ord")).select("repo_id", "ecosystem", "name", "d.*", "ord")
