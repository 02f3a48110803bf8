"""Deterministic inputs made from the driver's tables, as SQL that Spark and DuckDB run alike.

They are test inputs and no part of the engine: `{table}` stands for a table, which Spark gets as a
DataFrame and DuckDB by its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VENDORS = ["stripe", "sentry", "redis", "sendgrid", "twilio", "datadog", "auth0", "vercel", "cloudflare", "algolia", "lodash", "zebra"]
TYPES = ["env_var", "ci_secret", "url", "domain", "config_file", "import", "npm_package"]
SUFFIXES = ["SECRET_KEY", "URL", "TOKEN", "HOST", "REGION", "TIMEOUT"]
NAMES = [("Stripe", "payments"), ("Stripe Connect", "payments"), ("Stripe Connect Live", "payments"), ("Docker Hub", "infra"), ("Dockerhub", "infra"), ("Cloudflare Sitekey", "cdn"), ("Cloudflare Turnstile", "cdn"), ("Database", "database"), ("PostgreSQL", "database"), ("Email From", "email"), ("Sendgrid", "email"), ("Zebra", "other")]
CATEGORIES = ["database", "payments", "email", "monitoring", "analytics", "storage", "auth", "hosting", "cicd", "ai", "messaging", "cdn", "infra", "domain", "mobile", "gaming", "data", "support", "other"]
ECOSYSTEMS = ["npm", "pip", "cargo", "go", "gem", "composer", "maven", "gradle", "dart", "nuget"]


def case(expression: str, values: list) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


EVIDENCE = f"""
SELECT repo_id, type, CASE ei WHEN 0 THEN upper(vendor) || '_' || suffix WHEN 1 THEN upper(vendor) || '_TOKEN' WHEN 2 THEN 'https://api.' || vendor || '.com/v1'
    WHEN 4 THEN 'docker-service:' || vendor ELSE vendor END AS value, file, line, ord
FROM (
  SELECT repo_id, ei, vi, line, ord, file, {case('ei', TYPES)} AS type, {case('vi', VENDORS)} AS vendor, {case('si', SUFFIXES)} AS suffix
  FROM (
    SELECT CAST(l_orderkey % 20 AS INT) AS repo_id, CAST(l_partkey % 7 AS INT) AS ei, CAST((l_suppkey + l_orderkey) % 12 AS INT) AS vi,
      CAST(l_linenumber % 6 AS INT) AS si, l_linenumber AS line, 'src/f' || CAST(l_partkey % 40 AS STRING) || '.ts' AS file,
      l_orderkey * 10000000000 + l_partkey * 10000 + l_suppkey * 8 + l_linenumber AS ord
    FROM {{lineitem}}
  ) b
  WHERE (vi * 3 + repo_id + ei * 5) % 4 = 0 AND (vi % 4 <> 0 OR ei IN (2, 5, 6))
) e
"""

RESULT = f"""
SELECT CAST(p_partkey % 20 AS INT) AS repo_id, {case('(p_partkey + p_size) % 12', [n for n, _ in NAMES])} AS service_name,
  {case('(p_partkey + p_size) % 12', [c for _, c in NAMES])} AS category, 'low' AS confidence,
  'part ' || CAST(p_partkey % 5 AS STRING) AS reason, CAST({case('p_size % 4', [1, 2, 7, 10])} AS INT) AS score,
  {case('p_partkey % 3', ['env_var', 'import', 'npm_package'])} AS evidence_type, p_partkey AS ord
FROM {{part}}
"""

DEPENDENCY = f"""
SELECT CAST(p_partkey % 20 AS INT) AS repo_id, {case('p_partkey % 10', ECOSYSTEMS)} AS ecosystem,
  {case('p_size % 3', ['production', 'development', 'peer'])} AS type, lower(substr(p_brand, 1, 5)) || '-' || CAST(p_partkey % 97 AS STRING) AS name,
  {case('p_partkey % 4', ['^', '~', '>=', ''])} || CAST(p_size AS STRING) || '.0' AS version, p_partkey AS ord
FROM {{part}}
"""

SERVICE = f"""
SELECT CAST(o_orderkey % 50 AS INT) AS repo_id, 's' || CAST(o_orderkey AS STRING) AS id, 'Service ' || CAST(o_orderkey % 997 AS STRING) AS name,
  {case('n_nationkey % 19', CATEGORIES)} AS category, {case('o_custkey % 4', ['paid', 'free', 'trial', 'unknown'])} AS plan,
  {case('o_orderkey % 3', ['manual', 'automatic', 'free'])} AS billing_type, {case('o_orderkey % 5', ['monthly', 'yearly', 'one-time', 'usage-based', 'monthly'])} AS period,
  o_totalprice AS amount, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS last_renewed,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS next_date, CASE WHEN o_custkey % 3 <> 0 THEN c_name END AS owner,
  {case('o_orderkey % 4', ['high', 'low', 'medium', 'low'])} AS confidence, o_orderkey % 4 = 1 AS needs_review,
  CASE WHEN o_orderkey % 6 = 0 THEN 'https://s.io' END AS url, {case('o_orderkey % 4', ['active', 'zombie', 'stale', 'active'])} AS status,
  {case('o_orderkey % 3', ['inferred', 'inferred', 'manual'])} AS source, o_orderkey AS ord
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""

COMMIT = """
SELECT CAST(user_id % 20 AS INT) AS repo_id, 'src/f' || CAST(event_id % 40 AS STRING) || '.ts' AS file, ts FROM {events}
"""

HISTORY = """
SELECT CAST(user_id % 20 AS INT) AS repo_id, ts, CAST(event_id * 37 % 101 AS INT) AS score, event_id FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, sql: str, deal: str | None = None) -> DataFrame:
    """The rows of sql; with deal, tables are dealt to tasks by that column first: a table of one row group would else be one task, however long its rows take."""
    import re

    dealt = lambda rows: rows if deal is None else rows.repartition(deal)
    return spark.sql(sql, **{n: dealt(table(spark, sf_dir, n)) for n in set(re.findall(r"\{(\w+)\}", sql))})


def duckdb(sql: str) -> str:
    import re

    return re.sub(r"\{(\w+)\}", r"\1", sql)
