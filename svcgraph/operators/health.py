"""Billing, costs, renewals, health checks and the doctor (FN19-FN22, FN35-FN36, AGG08, AGG10-AGG15, AGG17-AGG24, FLT01-FLT05, FLT08).

A service row has repo_id, id, name, category, plan, confidence, needs_review, owner, url, status (activity), and billing as
plain columns billing_type, period, amount, currency, next_date, last_renewed (billing_type null: no billing).
Sums of money cross currencies, as the amounts are compared in reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from .ordering import dense_ranks

HAS_BILLING = "billing_type IS NOT NULL"
PAID = "plan IN ('paid', 'trial')"


def effective_next_date() -> Column:
    return E.next_billing_date(F.col("billing_type"), F.col("period"), F.col("last_renewed"), F.col("next_date"))


def renewed(services: DataFrame, as_of: Column) -> DataFrame:
    """FN20: services renewed on a day, with their next date counted from it."""
    rows = services.withColumn("last_renewed", as_of.cast("date"))
    return rows.withColumn("next_date", effective_next_date())


def monthly_costs(services: DataFrame) -> DataFrame:
    """Paid services with what they cost a month and a year."""
    paid = services.where("amount > 0 AND billing_type IS NOT NULL")
    return paid.withColumn("monthly", E.monthly_amount(F.col("period"), F.col("amount"))).withColumn("yearly", E.yearly_amount(F.col("period"), F.col("amount")))


def cost_by_category(services: DataFrame, *by: str) -> DataFrame:
    """AGG11/SRT03 (unsorted: sort by total descending where it is shown)."""
    return monthly_costs(services).groupBy(*by, "category").agg(F.sum("monthly").alias("total"), F.count("*").alias("n"))


def totals(services: DataFrame, *by: str) -> DataFrame:
    """AGG12."""
    return monthly_costs(services).groupBy(*by).agg(F.sum("monthly").alias("total_monthly"), F.sum("yearly").alias("total_yearly"), F.count("*").alias("paid"))


def budget_status(services: DataFrame, budgets: DataFrame) -> DataFrame:
    """FN35: budgets (repo_id, monthly, threshold) against monthly totals; nothing spent counts 0."""
    spent = budgets.join(totals(services, "repo_id"), "repo_id", "left").withColumn("spent", F.coalesce("total_monthly", F.lit(0.0)))
    percent = E.budget_percent(F.col("spent"), F.col("monthly"))
    return spent.select("repo_id", "spent", percent.alias("percent"), (F.col("monthly") - F.col("spent")).alias("remaining"), E.budget_colour(percent, F.coalesce("threshold", F.lit(80))).alias("colour"))


def with_budgets(budgets: DataFrame, changes: DataFrame) -> DataFrame:
    """MUT06: budgets (repo_id, monthly, threshold) after the latest change (by ts) of each repository; one without a monthly amount clears the budget."""
    last = changes.groupBy("repo_id").agg(F.max_by(F.struct("monthly", "threshold"), "ts").alias("c"))
    both = budgets.withColumn("b", F.struct("monthly", "threshold")).select("repo_id", "b").join(last, "repo_id", "full")
    now = both.select("repo_id", F.when(F.col("c").isNotNull(), F.col("c")).otherwise(F.col("b")).alias("n"))
    return now.where("n.monthly IS NOT NULL").select("repo_id", "n.monthly", "n.threshold")


def renewals(services: DataFrame, as_of: Column) -> DataFrame:
    """SRT02/FN36: services with a stored next date, the days to it and the badge (sort by days where shown)."""
    days = E.days_until(F.col("next_date"), as_of)
    return services.where("next_date IS NOT NULL").select("repo_id", "id", "name", "billing_type", "next_date", days.alias("days"), E.renewal_badge(days).alias("badge"))


def notifications(services: DataFrame, as_of: Column, within: int = 30, single: int = 3) -> DataFrame:
    """FLT08: renewals in 1 to 30 days; up to three are told one by one, more as one list."""
    due = renewals(services, as_of).where(F.col("days").between(1, within))
    packed = due.groupBy("repo_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("days", "name"))).alias("due"))
    one = F.transform("due", lambda d: F.concat(d["name"], F.lit(" renews in "), d["days"].cast("string"), F.lit(" days")))
    many = F.array(F.concat(F.col("n").cast("string"), F.lit(" renewals coming up: "), F.array_join(F.transform("due", lambda d: d["name"]), ", ")))
    return packed.select("repo_id", F.explode(F.when(F.col("n") <= single, one).otherwise(many)).alias("message"))


# --- health ------------------------------------------------------------------------------------

#: check, kind; in the order in which they are listed.
CHECKS = [
    ("NO_CRITICAL_VULNS", "security"), ("NO_HIGH_VULNS", "security"), ("NO_ZOMBIE_SERVICES", "security"), ("NO_OVERDUE_RENEWALS", "security"),
    ("NO_UPCOMING_RENEWALS", "security"), ("ALL_PAID_HAVE_OWNER", "completeness"), ("ALL_PAID_HAVE_BILLING", "completeness"),
    ("ALL_PAID_HAVE_RENEWAL", "completeness"),
]


def health_checks(services: DataFrame, as_of: Column, vulnerabilities: DataFrame | None = None) -> DataFrame:
    """AGG14: repo_id, check_id, kind, status (pass, fail, unchecked), affected; one conditional aggregate a repository.

    vulnerabilities: severity counts by repo_id of scanned repositories; the others' two checks stay unchecked.
    """
    nxt, threshold = effective_next_date(), E.renewal_threshold(F.col("billing_type"), F.col("period"))
    days = E.days_until(nxt, as_of)
    tracked, paid = threshold.isNotNull(), F.expr(PAID)
    recurring = paid & (F.col("billing_type").isNull() | ((F.col("billing_type") != "free") & ~F.coalesce(F.col("period").isin("usage-based", "one-time"), F.lit(False))))
    n = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    counts = services.groupBy("repo_id").agg(
        n(F.col("status").isNotNull()).alias("with_status"), n(F.col("status") == "zombie").alias("zombies"), n(tracked).alias("tracked"),
        n(tracked & (days < 0)).alias("overdue"), n(tracked & (days >= 0) & (days <= threshold)).alias("upcoming"), n(paid).alias("paid"),
        n(paid & (E.trim(F.coalesce("owner", F.lit(""))) == "")).alias("no_owner"), n(paid & ~F.coalesce(F.col("amount") > 0, F.lit(False))).alias("no_amount"),
        n(recurring).alias("recurring"), n(recurring & nxt.isNull()).alias("no_date"),
    )
    if vulnerabilities is None:
        counts = counts.withColumn("critical", F.lit(None).cast("long")).withColumn("high", F.lit(None).cast("long"))
    else:
        counts = counts.join(vulnerabilities.select("repo_id", "critical", "high"), "repo_id", "left")
    of = {
        "NO_CRITICAL_VULNS": (F.col("critical").isNotNull(), F.col("critical")), "NO_HIGH_VULNS": (F.col("high").isNotNull(), F.col("high")),
        "NO_ZOMBIE_SERVICES": (F.col("with_status") > 0, F.col("zombies")), "NO_OVERDUE_RENEWALS": (F.col("tracked") > 0, F.col("overdue")),
        "NO_UPCOMING_RENEWALS": (F.col("tracked") > 0, F.col("upcoming")), "ALL_PAID_HAVE_OWNER": (F.col("paid") > 0, F.col("no_owner")),
        "ALL_PAID_HAVE_BILLING": (F.col("paid") > 0, F.col("no_amount")), "ALL_PAID_HAVE_RENEWAL": (F.col("recurring") > 0, F.col("no_date")),
    }
    rows = F.array(*[F.struct(F.lit(c).alias("check_id"), F.lit(k).alias("kind"), F.when(~of[c][0], "unchecked").when(of[c][1] == 0, "pass").otherwise("fail").alias("status"), F.when(of[c][0], of[c][1]).cast("long").alias("affected")) for c, k in CHECKS])
    return counts.select("repo_id", F.inline(rows))


def health_score(checks: DataFrame) -> DataFrame:
    """AGG15: 100 * passing / applicable, rounded half up; 0 where nothing applies."""
    n = checks.groupBy("repo_id").agg(F.count_if(F.col("status") != "unchecked").alias("total_checks"), F.count_if(F.col("status") == "pass").alias("passing_checks"))
    score = F.coalesce(F.floor(F.try_divide(F.col("passing_checks") * 100.0, F.col("total_checks")) + 0.5), F.lit(0)).cast("int")
    return n.withColumn("score", score)


# --- counts and facets ---------------------------------------------------------------------------


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """AGG08, AGG09, AGG17, AGG24 (counts)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def confidence_breakdown(services: DataFrame, *by: str) -> DataFrame:
    """AGG10."""
    level = F.coalesce("confidence", F.lit("none"))
    return services.groupBy(*by).agg(*[F.count_if(level == c).alias(c) for c in ("high", "medium", "low")], F.count_if("needs_review").alias("to_review"))


def activity_counts(services: DataFrame, *by: str) -> DataFrame:
    """AGG18."""
    return services.groupBy(*by).agg(F.count_if(F.col("status") == "zombie").alias("zombie"), F.count_if(F.col("status") == "stale").alias("stale"))


def source_counts(services: DataFrame, *by: str) -> DataFrame:
    """AGG21."""
    return services.groupBy(*by).agg(F.count_if(F.col("source") == "inferred").alias("inferred"), F.count_if(F.col("source") == "manual").alias("manual"))


def share_summary(services: DataFrame, dependencies: DataFrame) -> DataFrame:
    """AGG22: services, dependencies and the rounded monthly cost as reports count it."""
    cost = E.monthly_amount_reported(F.col("period"), F.col("amount"))
    a = services.groupBy("repo_id").agg(F.count("*").alias("services"), F.floor(F.sum(cost) + 0.5).cast("long").alias("monthly_cost"))
    b = dependencies.groupBy("repo_id").agg(F.count("*").alias("dependencies"))
    return a.join(b, "repo_id", "left").select("repo_id", "services", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), "monthly_cost")


def information_counts(services: DataFrame, *by: str) -> DataFrame:
    """AGG23."""
    return services.groupBy(*by).agg(F.count_if(F.col("plan") == "free").alias("free"), F.count_if(F.col("plan") == "unknown").alias("unknown"), F.count_if((F.col("billing_type") == "automatic") & (F.col("period") == "monthly")).alias("automatic_monthly"))


def dependencies_by_type(dependencies: DataFrame) -> DataFrame:
    """AGG24: the names of each type, sorted."""
    return dependencies.groupBy("repo_id", "type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def default_view(services: DataFrame) -> DataFrame:
    """FLT01."""
    return services.where((F.coalesce("confidence", F.lit("")) != "low") & ~F.coalesce("needs_review", F.lit(False)))


def facets(services: DataFrame, text: str = "", category: str | None = None, plan: str | None = None, activity: str | None = None) -> DataFrame:
    """FLT02: a missing status counts as active."""
    rows = services.where(F.contains(F.lower("name"), F.lit(text.lower()))) if text else services
    for column, value in (("category", category), ("plan", plan)):
        rows = rows.where(F.col(column) == value) if value else rows
    return rows.where(F.coalesce("status", F.lit("active")) == activity) if activity else rows


def to_review(services: DataFrame) -> DataFrame:
    """FLT03."""
    return services.where(F.coalesce("needs_review", F.lit(False)) | (F.coalesce("confidence", F.lit("")) == "low"))


def search_dependencies(dependencies: DataFrame, text: str = "", kind: str | None = None) -> DataFrame:
    """FLT04; sort by name or type where shown (SRT01)."""
    rows = dependencies.where(F.contains(F.lower("name"), F.lit(text.lower()))) if text else dependencies
    return rows.where(F.col("type") == kind) if kind else rows


def sorted_dependencies(dependencies: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """SRT01: dependencies with their place (from 0) in their repository's list by name or type, as a reader of words would sort them; ties keep their order."""
    key = F.collate(by, "UNICODE")
    ranked = dense_ranks(dependencies.withColumn("_k", key), [F.col("repo_id"), F.col("_k").desc() if descending else F.col("_k"), F.col("ord")])
    first = ranked.groupBy("repo_id").agg(F.min("rank").alias("_first"))
    return ranked.join(first, "repo_id").withColumn("place", F.col("rank") - F.col("_first")).select(*dependencies.columns, "place")


def search_discarded(discarded: DataFrame, text: str = "", reason: str | None = None) -> DataFrame:
    """FLT05."""
    rows = discarded.where(F.contains(F.lower("name"), F.lit(text.lower()))) if text else discarded
    return rows.where(F.col("reason") == reason) if reason else rows


# --- doctor --------------------------------------------------------------------------------------


def doctor(services: DataFrame, repositories: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """AGG19/AGG20: repo_id, section, check_id, level (passed, warning, error), affected.

    repositories: repo_id, has_config, config_valid, project_name. vulnerabilities: severity counts. A check that doesn't apply gives no row.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    paid = F.col("plan") == "paid"
    counts = services.groupBy("repo_id").agg(
        F.count("*").alias("n"), n(E.trim(F.coalesce("owner", F.lit(""))) == "").alias("no_owner"), n(paid).alias("paid"), n(paid & F.col("next_date").isNull()).alias("no_date"),
        n(F.col("needs_review")).alias("review"), n(F.col("confidence") == "low").alias("low"), n(F.coalesce("category", F.lit("")) == "").alias("no_category"),
        n(paid & (F.coalesce(F.col("amount").cast("double"), F.lit(0.0)) == 0)).alias("no_cost"), F.sum(F.when(paid, E.monthly_amount_reported(F.col("period"), F.col("amount"))).otherwise(0.0)).alias("cost"),
    )
    found = vulnerabilities.select("repo_id", (F.col("critical") + F.col("high")).alias("severe"), (F.col("critical") + F.col("high") + F.col("medium") + F.col("low") + F.col("unknown")).alias("vulns"))
    rows = repositories.join(counts, "repo_id", "left").join(found, "repo_id", "left").fillna(0)
    some = F.col("n") > 0

    def check(section: str, name: str, applies: Column, bad: Column, level: str, affected: Column) -> Column:
        return F.when(applies, F.struct(F.lit(section).alias("section"), F.lit(name).alias("check_id"), F.when(bad, level).otherwise("passed").alias("level"), F.when(bad, affected).otherwise(0).cast("long").alias("affected")))

    named, one = F.coalesce("project_name", F.lit("")) != "", F.lit(1)
    every = F.lit(True)
    checks = [
        check("configuration", "config_found", every, ~F.col("has_config"), "error", one), check("configuration", "config_valid", F.col("has_config"), ~F.col("config_valid"), "error", one),
        check("configuration", "project_name", every, ~named, "error", one), check("services", "detected", ~some, ~some, "warning", one),
        check("services", "owners", some, F.col("no_owner") > 0, "warning", F.col("no_owner")), check("services", "renewal_dates", F.col("paid") > 0, F.col("no_date") > 0, "error", F.col("no_date")),
        check("services", "reviewed", some, F.col("review") > 0, "warning", F.col("review")), check("services", "confidence", some, F.col("low") > 0, "warning", F.col("low")),
        check("services", "categories", some, F.col("no_category") > 0, "warning", F.col("no_category")), check("costs", "documented", every, F.col("no_cost") > 0, "error", F.col("no_cost")),
        check("costs", "total", F.col("cost") > 0, F.lit(False), "error", F.lit(0)),
        check("security", "vulnerabilities", every, F.col("vulns") > 0, "warning", F.col("vulns")),
    ]
    out = rows.select("repo_id", "severe", F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c")).select("repo_id", "severe", "c.*")
    severe = (F.col("check_id") == "vulnerabilities") & (F.col("severe") > 0)
    return out.withColumn("level", F.when(severe, "error").otherwise(F.col("level"))).drop("severe")


def doctor_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("repo_id").agg(*[F.count_if(F.col("level") == level).alias(name) for level, name in (("error", "errors"), ("warning", "warnings"), ("passed", "passed"))])
