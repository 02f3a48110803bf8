"""Scalar functions: Column -> Column, all JVM-side. Nulls give null unless a docstring says otherwise.

White space is trimmed as Unicode white space, `\\z` is the end of the input, and parsing never throws.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def lookup(key: Column, pairs: list[tuple], otherwise: Column | None = None) -> Column:
    """The value of the first pair whose key equals; null or `otherwise` if none does."""
    if not pairs:
        return F.lit(None) if otherwise is None else otherwise
    chain = reduce(lambda c, p: c.when(key == p[0], F.lit(p[1])), pairs[1:], F.when(key == pairs[0][0], F.lit(pairs[0][1])))
    return chain if otherwise is None else chain.otherwise(otherwise)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often `then` uses it; within a higher-order function nothing else sees to that."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def host_of(url: Column) -> Column:
    """FN01: lower-case host; null for localhost, numeric hosts and what is no URL."""
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when((host != "") & (host != "localhost") & ~host.rlike(r"^[\d.]+\z"), host)


def is_ignored_exact(host: Column) -> Column:
    """FN02."""
    return host.isin(rules.IGNORED_DOMAINS)


def is_ignored_suffix(host: Column) -> Column:
    """FN03: api.* hosts are never ignored; sub-domains of ignored hosts are."""
    listed = F.array(*[F.lit(d) for d in rules.IGNORED_DOMAINS])
    return ~host.startswith("api.") & F.exists(listed, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def apex(host_or_url: Column) -> Column:
    """FN04: the first label without www, of a URL or a bare domain."""
    url = F.when(host_or_url.contains("://"), host_or_url).otherwise(F.concat(F.lit("https://"), host_or_url))
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.split_part(F.regexp_replace(host, r"^www\.", ""), F.lit("."), F.lit(1)))


def is_own_domain(host: Column, project: Column) -> Column:
    """FN04: only the first label is compared; never null."""
    return F.coalesce(apex(host) == F.lower(project), F.lit(False))


def project_label(package_name: Column) -> Column:
    """FN05, its last step: the letters and digits of a package name."""
    return F.lower(F.regexp_replace(package_name, "[^A-Za-z0-9]", ""))


def format_project_name(raw: Column) -> Column:
    """FN06: words in title case; temp, dev, test and local go wherever they stand, with the blanks beside them."""
    spaced = F.regexp_replace(raw, "[-_]", " ")
    words = F.transform(F.split(spaced, r"(?<=\W)|(?=\W)"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    cut = trim(F.regexp_replace(F.array_join(words, ""), r"(?i)\s*(temp|dev|test|local)\s*", ""))
    return F.when(cut == "", F.lit("App")).otherwise(cut)


def ecosystem_of(dependency_ecosystem: Column) -> Column:
    """FN07, by dependency."""
    return lookup(dependency_ecosystem, rules.ECOSYSTEM_OF_DEPENDENCY)


def ecosystem_of_file(basename: Column, ext: Column) -> Column:
    """FN07, by file: the name first, then the extension."""
    return F.coalesce(lookup(basename, rules.ECOSYSTEM_OF_FILE), lookup(ext, rules.ECOSYSTEM_OF_EXTENSION))


def title_case(text: Column) -> Column:
    """FN08: words between blanks, _ and -, each with one capital."""
    words = F.filter(F.split(text, r"[\s_\-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")


def category_of(name: Column) -> Column:
    """FN09: first matching pattern, in order."""
    low = F.lower(name)
    chain = reduce(lambda c, p: c.when(low.rlike(p[1]), p[0]), rules.CATEGORY_PATTERNS, F.when(low.isNull(), F.lit(None)))
    return chain.otherwise("other")


def is_generic(name: Column) -> Column:
    """FN10."""
    return F.lower(trim(name)).isin(rules.GENERIC_NAMES)


def suffix_penalty(upper: Column) -> Column:
    """FN11."""
    return F.when(upper.rlike("(" + "|".join(rules.CONFIG_SUFFIXES) + r")\z"), F.lit(-5)).otherwise(0)


def is_hard_filtered(upper: Column) -> Column:
    """FN12: CI variables and flags; a known service's name rescues a flag, before browser and pricing names are looked at."""
    token = F.lower(F.regexp_replace(F.regexp_replace(upper, r"^(DISABLE_|ENABLE_)", ""), "_", ""))
    flag = F.when(upper.rlike(rules.FLAG_NAME), ~token.rlike(rules.KNOWN_SERVICE)).otherwise(upper.rlike(rules.BROWSER_NAME))
    return upper.rlike(rules.CI_NAME) | flag


def service_key(name: Column) -> Column:
    """FN13."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def type_key(evidence_type: Column) -> Column:
    """FN14: imports and packages count as one type."""
    return F.when(evidence_type.isin("import", "npm_package"), "import/npm").otherwise(evidence_type)


def confidence_rank(confidence: Column) -> Column:
    """FN15."""
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1)


def days_between(a: Column, b: Column) -> Column:
    """FN16: whole days, unsigned."""
    return F.floor(F.abs(F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))) / 86400).cast("int")


def days_until(target: Column, as_of: Column) -> Column:
    """FN17: signed days between midnights."""
    return F.datediff(target.cast("date"), as_of.cast("date"))


def activity_status(days: Column) -> Column:
    """FN18: null counts as active."""
    return F.when(days >= rules.ZOMBIE_DAYS, "zombie").when(days >= rules.STALE_DAYS, "stale").otherwise("active")


def add_months_overflowing(day: Column, months: Column | int) -> Column:
    """Days past the month's end run on into the next month (Jan 31 + 1 month is Mar 2 or 3)."""
    first = F.add_months(F.trunc(day, "MM"), months)
    return F.date_add(first, (F.dayofmonth(day) - 1).cast("int"))


def next_billing_date(kind: Column, period: Column, last_renewed: Column, next_date: Column) -> Column:
    """FN19: counted from the last renewal if there is one, else the stored date; null where nothing recurs."""
    counted = F.when(period == "monthly", add_months_overflowing(last_renewed, 1)).when(period == "yearly", add_months_overflowing(last_renewed, 12))
    none = (F.coalesce(kind, F.lit("")) == "free") | F.coalesce(period.isin("one-time", "usage-based"), F.lit(False))
    return F.when(~none, F.when(last_renewed.isNotNull(), counted).otherwise(next_date))


def renewal_threshold(kind: Column, period: Column) -> Column:
    """FN21: days before a renewal from which it is due for a check; null where none is tracked."""
    return F.when((kind == "automatic") & (period == "yearly"), 60).when((kind == "manual") & (period == "monthly"), 7).when((kind == "manual") & (period == "yearly"), 30)


def monthly_amount(period: Column, amount: Column) -> Column:
    """FN22: yearly amounts by 12; one-time, by usage and unknown periods count 0."""
    return F.coalesce(F.when(period == "yearly", amount.cast("double") / 12).when(period == "monthly", amount.cast("double")), F.lit(0.0))


def monthly_amount_reported(period: Column, amount: Column) -> Column:
    """As reports and doctor count: all but yearly amounts are monthly."""
    return F.coalesce(F.when(period == "yearly", amount.cast("double") / 12).otherwise(amount.cast("double")), F.lit(0.0))


def yearly_amount(period: Column, amount: Column) -> Column:
    return F.coalesce(F.when(period == "yearly", amount.cast("double")).when(period == "monthly", amount.cast("double") * 12), F.lit(0.0))


def severity(scores: Column) -> Column:
    """FN23, of array<struct<score double, severity string>>: the first positive score decides, then the first known label."""
    positive = F.get(F.filter(scores, lambda s: s["score"] > 0), F.lit(0))["score"]
    labels = F.filter(F.transform(scores, lambda s: F.lower(s["severity"])), lambda s: s.isin("critical", "high", "medium", "moderate", "low"))
    label = F.get(labels, F.lit(0))
    by_score = F.when(positive >= 9.0, "critical").when(positive >= 7.0, "high").when(positive >= 4.0, "medium").when(positive > 0, "low")
    return F.coalesce(by_score, F.when(label == "moderate", "medium").otherwise(label), F.lit("unknown"))


def strip_version_prefix(version: Column) -> Column:
    """FN24: one leading sign only."""
    return F.regexp_replace(version, r"^[\^~>=<]", "")


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """FN25."""
    kind = lookup(ecosystem, rules.PURL_TYPES, ecosystem)
    scoped = F.when((kind == "npm") & name.startswith("@"), F.concat(F.lit("%40"), F.substr(name, F.lit(2)))).otherwise(name)
    tail = F.when(version.isNotNull() & (version != "*") & (version != ""), F.concat(F.lit("@"), version)).otherwise("")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), scoped, tail)


def spdx_id(name: Column) -> Column:
    """FN26."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9.\-]", "-")


def namespace_uuid(seed: str, name: Column) -> Column:
    """FN27: the first 32 hex digits of sha256(seed + name), in groups of 8-4-4-4-12."""
    h = F.sha2(F.concat(F.lit(seed), name), 256)
    return F.concat_ws("-", *[F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def path_hash(path: Column) -> Column:
    """FN28."""
    return F.left(F.sha2(path, 256), F.lit(16))


def should_review(confidence: Column, category: Column, warnings: Column) -> Column:
    """FN29: warnings is a number of them."""
    return F.when(confidence == "high", False).otherwise(category.isNull() | category.isin("", "other") | (F.coalesce(warnings, F.lit(0)) > 0))


def score_band(score: Column) -> Column:
    """FN30."""
    return F.when(score >= rules.SCORE_GREEN, "green").when(score >= rules.SCORE_YELLOW, "yellow").otherwise("red")


def html_escape(text: Column) -> Column:
    """FN31."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def sanitize_prompt(text: Column, limit: int = 200) -> Column:
    """FN32: control characters go, then at most `limit` characters, then blanks at the ends."""
    return trim(F.left(F.regexp_replace(text, r"[\x00-\x1F\x7F]", ""), F.lit(limit)))


def redact_token(message: Column, token: Column) -> Column:
    """FN33: all but the token's first four characters."""
    return F.when(token.isNull() | (token == ""), message).otherwise(F.replace(message, token, F.concat(F.left(token, F.lit(4)), F.lit("****"))))


def has_traversal(path: Column) -> Column:
    """FN34: a .. step, or a NUL."""
    return path.rlike(r"(^|[/\\])\.\.([/\\]|\z)") | path.contains("\x00")


def budget_percent(total: Column, monthly: Column) -> Column:
    """FN35: null without a budget."""
    return F.when(monthly > 0, total / monthly * 100)


def budget_colour(percent: Column, threshold: Column) -> Column:
    """FN35."""
    return F.when(percent > 100, "red").when(percent >= threshold, "yellow").otherwise("green")


def renewal_badge(days: Column) -> Column:
    """FN36."""
    return F.when(days < 0, "OVERDUE").when(days < 7, "URGENT").when(days < 30, "SOON")


def registry_url(ecosystem: Column, name: Column) -> Column:
    """FN38. Public package registries."""
    bases = [
        ("npm", "https://www.npmjs.com/package/"), ("pip", "https://pypi.org/project/"), ("cargo", "https://crates.io/crates/"),
        ("composer", "https://packagist.org/packages/"), ("go", "https://pkg.go.dev/"), ("dart", "https://pub.dev/packages/"),
        ("maven", "https://search.maven.org/search?q="), ("gradle", "https://search.maven.org/search?q="),
        ("gem", "https://rubygems.org/gems/"), ("nuget", "https://www.nuget.org/packages/"),
    ]
    return F.concat(lookup(ecosystem, bases), name)


def valid_slug(slug: Column) -> Column:
    """FN39: owner/name."""
    return slug.rlike(r"^[a-zA-Z0-9_.\-]+/[a-zA-Z0-9_.\-]+\z")


def safe_base_url(url: Column) -> Column:
    """FN39: http(s), and no metadata or link-local host. The blocked hosts."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return (host != "") & ~host.isin("169.254.169.254", "169.254.170.2", "metadata.google.internal", "100.100.100.200") & ~host.startswith("169.254.")
