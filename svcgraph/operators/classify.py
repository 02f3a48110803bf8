"""CLS00-CLS07: evidence rows become scored results, as one projection without a shuffle.

Input: repo_id, type, value, file, line, ord. Output: repo_id, service_name, category, confidence, reason,
score, evidence_type, file, ord. Evidence of unknown type, null values and unclassified values give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import rules

RAW = "struct<candidate:string,shown:string,score:int,confidence:string,reason:string,name:string,category:string>"


def _raw(candidate: Column | None, score: Column, confidence: Column | str, reason: Column, shown: Column | None = None, name: Column | None = None, category: Column | None = None) -> Column:
    """What a branch knows: either a candidate, from which name and category follow, or both as they are."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else F.lit(None).cast("string") if x is None else x
    return F.struct(lit(candidate).alias("candidate"), lit(candidate if shown is None else shown).alias("shown"), score.cast("int").alias("score"), lit(confidence).alias("confidence"), reason.alias("reason"), lit(name).alias("name"), lit(category).alias("category"))


def _quoted(before: str, x: Column, behind: str = "") -> Column:
    return F.concat(F.lit(f'{before} "'), x, F.lit(f'"{behind}'))


def _variable(value: Column, base: Column, reason: str) -> Column:
    """What CLS01 and CLS06 share: the candidate left of a known tail, after all filters."""
    upper = F.upper(value)
    stripped = F.regexp_replace(upper, rules.FRAMEWORK_PREFIX, "")
    cut = F.regexp_replace(F.regexp_replace(stripped, "^[^A-Z]+", ""), rules.NAME_TAIL, "")
    candidate = E.trim(F.regexp_replace(F.lower(cut), "_", " "))
    template = value.startswith("$") | value.startswith("{") | value.contains("${")
    fine = ~template & ~upper.rlike(rules.SYSTEM_NAME) & ~E.is_hard_filtered(stripped)
    score = (base + E.suffix_penalty(stripped)).cast("int")
    return F.when(fine, _raw(candidate, score, None, _quoted(reason, value, " suggests external service")))


def env_var(value: Column) -> Column:
    """CLS01."""
    upper = F.upper(value)
    return _variable(value, F.when(upper.rlike(rules.CREDENTIAL_NAME), 7).when(upper.rlike(rules.ENDPOINT_NAME), 6).otherwise(2), "Environment variable")


def ci_secret(value: Column) -> Column:
    """CLS06."""
    return _variable(value, F.lit(8), "CI secret")


def url(value: Column) -> Column:
    """CLS02: one known sub-domain goes, then the first label names the service."""
    host = F.lower(F.regexp_extract(value, r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    name = F.split_part(F.regexp_replace(host, rules.URL_SUBDOMAIN, ""), F.lit("."), F.lit(1))
    return _raw(name, F.lit(5), "medium", _quoted("External URL", value, " found in source code"))


def package(value: Column) -> Column:
    """CLS03: the scope or the package, without one language suffix."""
    first = F.split_part(F.regexp_replace(value, "^@", ""), F.lit("/"), F.lit(1))
    name = F.regexp_replace(first, rules.PACKAGE_TAIL, "")
    return F.when(~value.isin(rules.BUILTIN_MODULES), _raw(name, F.lit(1), "low", _quoted("npm package", value, " suggests external service dependency"), F.regexp_replace(name, "[-_]", " ")))


def import_path(value: Column) -> Column:
    """CLS04: the package of an import path."""
    parts = F.split(value, "/")
    base = F.when(value.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))
    return F.when(~value.isin(rules.BUILTIN_MODULES), package(base))


def config_file(value: Column) -> Column:
    """CLS05: compose services, workflows, actions, Terraform providers and known files, all with score 10."""
    after = lambda prefix: F.substr(value, F.lit(len(prefix) + 1))
    compose, action, provider = after("docker-service:"), after("action:"), after("terraform:")
    owner = F.split_part(action, F.lit("/"), F.lit(1))
    known_action = lambda i: E.lookup(owner, [(row[0], row[i]) for row in rules.ACTION_OWNERS])
    known_file = lambda i: E.lookup(value, [(row[0], row[i]) for row in rules.CONFIG_FILES])
    ten = F.lit(10)
    return (
        F.when(value.startswith("docker-service:"), _raw(compose, ten, "high", _quoted("Docker Compose service", compose)))
        .when(value == "github-actions", _raw(None, ten, "high", F.lit("GitHub Actions workflow found"), name=F.lit("GitHub Actions"), category=F.lit("cicd")))
        .when(value.startswith("action:"), _raw(None, ten, "high", _quoted("GitHub Action", action), name=known_action(1), category=known_action(2)))
        .when(value.startswith("terraform:"), _raw(provider, ten, "high", _quoted("Terraform provider", provider)))
        .otherwise(_raw(None, ten, "high", _quoted("Config file", value, " found"), name=known_file(1), category=known_file(2)))
    )


def domain(value: Column) -> Column:
    """CLS07: known products, else the first label if it has a category."""
    low = F.lower(value)
    name = F.split_part(F.regexp_replace(low, rules.DOMAIN_SUBDOMAIN, ""), F.lit("."), F.lit(1))
    known = [(low.isin(values), _raw(None, F.lit(score), confidence, F.lit(reason), name=F.lit(product), category=F.lit(category))) for values, product, category, confidence, reason, score in rules.KNOWN_DOMAINS]
    chain = reduce(lambda c, k: c.when(*k), known[1:], F.when(*known[0]))
    return chain.otherwise(_raw(name, F.lit(5), "medium", _quoted("Domain", value, " suggests external service")))


BRANCHES = {"env_var": env_var, "url": url, "npm_package": package, "import": import_path, "config_file": config_file, "ci_secret": ci_secret, "domain": domain}
#: Types whose candidates must not be general names; two letters are needed wherever a name is cut out of something.
CHECKED = ["env_var", "url", "npm_package", "import", "ci_secret"]


def project_aliases(project: Column) -> Column:
    """The project's name without signs, and without one common suffix if two letters stay."""
    whole = F.lower(F.regexp_replace(F.lower(project), "[^a-z0-9]", ""))
    stem = F.regexp_replace(whole, r"(com|io|dev|app|org)\z", "")
    return F.when(F.coalesce(whole, F.lit("")) == "", F.array().cast("array<string>")).when((stem != whole) & (F.length(stem) >= 2), F.array(whole, stem)).otherwise(F.array(whole))


def classify(evidences: DataFrame, project: Column | None = None) -> DataFrame:
    """CLS00: dispatch by type, penalties for the project's own name (10) and for over two words (3), positive scores only.

    Branches give small structs; name and category are worked out once behind them. The columns in between are
    kept apart so that each is computed once a row.
    """
    value, kind = F.col("value"), F.col("type")
    branches = [(k, fn(value).cast(RAW)) for k, fn in BRANCHES.items()]
    found = reduce(lambda c, b: c.when(kind == b[0], b[1]), branches[1:], F.when(kind == branches[0][0], branches[0][1]))
    kept = [c for c in ("repo_id", "file", "ord") if c in evidences.columns]
    own = project if project is not None else F.lit(None).cast("string")
    # inline over an array of one (or none): drops what isn't classified, and is a border for the optimizer
    rows = evidences.select(*kept, kind.alias("evidence_type"), own.alias("_project"), F.inline(F.when(found.isNotNull(), F.array(found)).otherwise(F.array().cast(f"array<{RAW}>"))))
    cut_out = F.col("evidence_type").isin(*CHECKED, "domain") & F.col("candidate").isNotNull()
    general = F.col("evidence_type").isin(CHECKED) & E.is_generic(F.col("shown"))
    rows = rows.where((F.col("candidate").isNotNull() | F.col("name").isNotNull()) & (~cut_out | (F.length("candidate") >= 2)) & ~general)
    rows = rows.withColumn("service_name", F.coalesce("name", E.title_case(F.col("shown")))).withColumn("category", F.coalesce("category", E.category_of(F.col("candidate"))))
    rows = rows.where(~((F.col("evidence_type") == "domain") & F.col("name").isNull() & (F.col("category") == "other")))
    level = F.when(F.col("score") >= 7, "high").when(F.col("score") >= 5, "medium").otherwise("low")
    rows = rows.withColumn("confidence", F.coalesce("confidence", level))
    words = F.size(F.split(E.trim(F.col("service_name")), r"\s+"))
    penalty = F.when(words > 2, -3).otherwise(0)
    if project is not None:
        plain = F.regexp_replace(F.lower(F.col("service_name")), "[^a-z0-9]", "")
        penalty = penalty + F.when(F.exists(project_aliases(F.col("_project")), lambda a: F.when(F.length(a) >= 4, plain.contains(a)).otherwise(plain == a)), -10).otherwise(0)
    return rows.withColumn("score", (F.col("score") + penalty).cast("int")).where("score > 0").select(*kept, "service_name", "category", "confidence", "reason", "score", "evidence_type")
