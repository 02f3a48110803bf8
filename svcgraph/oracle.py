"""DuckDB SQL for the registered queries, written apart from the operators (rule tables are shared values)."""

from __future__ import annotations

from . import oracle_files, oracle_more
from .functions import rules
from .sources import adapters as A


def cte(name: str, adapter: str) -> str:
    return f"{name} AS ({A.duckdb(adapter)})"


EV, RE, DE, SE = cte("ev", A.EVIDENCE), cte("re", A.RESULT), cte("de", A.DEPENDENCY), cte("se", A.SERVICE)
CO, HI = cte("co", A.COMMIT), cte("hi", A.HISTORY)
AS_OF = "DATE '2024-06-30'"


def names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def title(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split_regex({x}, '[\\s_-]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


def category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN '{c}'" for c, p in rules.CATEGORY_PATTERNS) + " ELSE 'other' END"


def generic(x: str) -> str:
    return f"lower(trim({x})) IN ({names(rules.GENERIC_NAMES)})"


SUFFIX = "(" + "|".join(rules.CONFIG_SUFFIXES) + r")\z"

VARIABLES = f"""
vars AS (
  SELECT *, upper(value) AS u, regexp_replace(upper(value), '{rules.FRAMEWORK_PREFIX}', '') AS st FROM ev WHERE type IN ('env_var', 'ci_secret')
), cand AS (
  SELECT *, trim(replace(lower(regexp_replace(regexp_replace(st, '^[^A-Z]+', ''), '{rules.NAME_TAIL}', '')), '_', ' ')) AS c,
    replace(lower(regexp_replace(st, '^(DISABLE_|ENABLE_)', '')), '_', '') AS tok,
    (CASE WHEN type = 'ci_secret' THEN 8 WHEN regexp_matches(u, '{rules.CREDENTIAL_NAME}') THEN 7 WHEN regexp_matches(u, '{rules.ENDPOINT_NAME}') THEN 6 ELSE 2 END)
      - (CASE WHEN regexp_matches(st, '{SUFFIX}') THEN 5 ELSE 0 END) AS s
  FROM vars
), var_rows AS (
  SELECT repo_id, ord, file, {title('c')} AS service_name, {category('c')} AS category,
    CASE WHEN s >= 7 THEN 'high' WHEN s >= 5 THEN 'medium' ELSE 'low' END AS confidence,
    (CASE type WHEN 'ci_secret' THEN 'CI secret "' ELSE 'Environment variable "' END) || value || '" suggests external service' AS reason, s AS score, type AS evidence_type
  FROM cand
  WHERE NOT regexp_matches(u, '{rules.SYSTEM_NAME}') AND NOT regexp_matches(st, '{rules.CI_NAME}') AND length(c) >= 2 AND NOT {generic('c')}
    AND NOT (CASE WHEN regexp_matches(st, '{rules.FLAG_NAME}') THEN NOT regexp_matches(tok, '{rules.KNOWN_SERVICE}') ELSE regexp_matches(st, '{rules.BROWSER_NAME}') END)
)"""

URLS = f"""
url_rows AS (
  SELECT repo_id, ord, file, {title('n')} AS service_name, {category('n')} AS category, 'medium' AS confidence, 'External URL "' || value || '" found in source code' AS reason, 5 AS score, type AS evidence_type
  FROM (SELECT *, split_part(regexp_replace(lower(regexp_extract(value, '^[a-zA-Z]+://([^/:?#]+)', 1)), '{rules.URL_SUBDOMAIN}', ''), '.', 1) AS n FROM ev WHERE type = 'url')
  WHERE length(n) >= 2 AND NOT {generic('n')}
)"""

PACKAGES = f"""
pkg_rows AS (
  SELECT repo_id, ord, file, {title('n')} AS service_name, {category('n')} AS category, 'low' AS confidence, 'npm package "' || base || '" suggests external service dependency' AS reason, 1 AS score, type AS evidence_type
  FROM (
    SELECT *, regexp_replace(split_part(regexp_replace(base, '^@', ''), '/', 1), '{rules.PACKAGE_TAIL}', '') AS n
    FROM (SELECT *, CASE WHEN type = 'npm_package' THEN value WHEN value[1:1] = '@' THEN split_part(value, '/', 1) || '/' || split_part(value, '/', 2) ELSE split_part(value, '/', 1) END AS base FROM ev WHERE type IN ('npm_package', 'import'))
    WHERE value NOT IN ({names(rules.BUILTIN_MODULES)})
  ) WHERE length(n) >= 2 AND NOT {generic("regexp_replace(n, '[-_]', ' ', 'g')")}
)"""

CONFIGS = f"""
cfg_rows AS (
  SELECT repo_id, ord, file, {title('n')} AS service_name, {category('n')} AS category, 'high' AS confidence, 'Docker Compose service "' || n || '"' AS reason, 10 AS score, type AS evidence_type
  FROM (SELECT *, replace(value, 'docker-service:', '') AS n FROM ev WHERE type = 'config_file' AND starts_with(value, 'docker-service:'))
)"""

_KNOWN = lambda i: "CASE " + " ".join(f"WHEN v IN ({names(k[0])}) THEN {k[i]!r}" for k in rules.KNOWN_DOMAINS)
DOMAINS = f"""
dom_rows AS (
  SELECT repo_id, ord, file, {_KNOWN(1)} ELSE {title('n')} END AS service_name, {_KNOWN(2)} ELSE {category('n')} END AS category, {_KNOWN(3)} ELSE 'medium' END AS confidence,
    {_KNOWN(4)} ELSE 'Domain "' || value || '" suggests external service' END AS reason, {_KNOWN(5)} ELSE 5 END AS score, type AS evidence_type
  FROM (SELECT *, lower(value) AS v, split_part(regexp_replace(lower(value), '{rules.DOMAIN_SUBDOMAIN}', ''), '.', 1) AS n FROM ev WHERE type = 'domain')
  WHERE v IN ({names([x for k in rules.KNOWN_DOMAINS for x in k[0]])}) OR (length(n) >= 2 AND {category('n')} <> 'other')
)"""

ALL_RESULTS = f"""
all_rows AS (
  SELECT * FROM var_rows UNION ALL SELECT * FROM url_rows UNION ALL SELECT * FROM pkg_rows UNION ALL SELECT * FROM cfg_rows UNION ALL SELECT * FROM dom_rows
), cls AS (
  SELECT * REPLACE (CAST(score - CASE WHEN len(string_split_regex(trim(service_name), '\\s+')) > 2 THEN 3 ELSE 0 END AS INTEGER) AS score) FROM all_rows
  WHERE score - CASE WHEN len(string_split_regex(trim(service_name), '\\s+')) > 2 THEN 3 ELSE 0 END > 0
)"""
CLS = ", ".join([EV, VARIABLES, URLS, PACKAGES, CONFIGS, DOMAINS, ALL_RESULTS])
KEYED = """k AS (
  SELECT *, regexp_replace(regexp_replace(lower(service_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS key,
    CASE WHEN evidence_type IN ('import', 'npm_package') THEN 'import/npm' ELSE evidence_type END AS type_key FROM {source}
)"""
CK, RK = KEYED.format(source="cls"), KEYED.format(source="re")
RESULT_COLUMNS = "repo_id, ord, file, service_name, category, confidence, reason, CAST(score AS INTEGER) AS score, evidence_type"


def rows_of(kind: str, part: str) -> str:
    return f"WITH {CLS} SELECT {RESULT_COLUMNS} FROM cls WHERE evidence_type = '{kind}'"


ROOTED = "d AS (SELECT DISTINCT repo_id, key FROM k), r AS (SELECT a.repo_id, a.key, arg_min(b.key, length(b.key)) AS root FROM d a JOIN d b ON a.repo_id = b.repo_id AND (a.key = b.key OR starts_with(a.key, b.key || '-')) GROUP BY a.repo_id, a.key)"
ROOTS = f"WITH {RE}, {RK}, {ROOTED} SELECT * FROM r"

# The single-word vendors of the adapter form no prefixes and no brands but their own roots.
INVENTORY = f"""WITH {CLS}, {CK}, t AS (SELECT repo_id, key, type_key, max(score) AS s FROM k GROUP BY ALL),
g AS (SELECT repo_id, key, CAST(sum(s) AS INTEGER) AS final_score FROM t GROUP BY ALL),
n AS (SELECT repo_id, key, arg_max(service_name, (length(service_name), -ord)) AS name, coalesce(arg_min(category, (ord, reason)) FILTER (WHERE category <> 'other'), 'other') AS category FROM k GROUP BY ALL)
SELECT repo_id, key AS id, name, category, final_score, CASE WHEN final_score > 10 THEN 'high' ELSE 'low' END AS confidence, final_score <= 10 AS needs_review
FROM g JOIN n USING (repo_id, key) WHERE final_score >= 6 AND length(name) >= 3"""

NEXT = """CASE WHEN coalesce(billing_type, '') <> 'free' AND coalesce(period, '') NOT IN ('one-time', 'usage-based') THEN
  CASE WHEN last_renewed IS NULL THEN next_date
    WHEN period = 'monthly' THEN CAST(date_trunc('month', last_renewed) + to_months(1) AS DATE) + CAST(day(last_renewed) - 1 AS INTEGER)
    WHEN period = 'yearly' THEN CAST(date_trunc('month', last_renewed) + to_months(12) AS DATE) + CAST(day(last_renewed) - 1 AS INTEGER) END END"""
THRESHOLD = "CASE WHEN billing_type = 'automatic' AND period = 'yearly' THEN 60 WHEN billing_type = 'manual' AND period = 'monthly' THEN 7 WHEN billing_type = 'manual' AND period = 'yearly' THEN 30 END"
MONTHLY = "coalesce(CASE WHEN period = 'yearly' THEN amount / 12 WHEN period = 'monthly' THEN amount END, 0)"
YEARLY = "coalesce(CASE WHEN period = 'yearly' THEN amount WHEN period = 'monthly' THEN amount * 12 END, 0)"
FRONT, BACK = names(rules.FRONTEND_CATEGORIES), names(rules.BACKEND_CATEGORIES)
SIDE = f"CASE WHEN category IN ({FRONT}) THEN 'frontend' WHEN category IN ({BACK}) THEN 'backend' WHEN coalesce(url, '') <> '' THEN 'backend' ELSE 'frontend' END"
GROUP = "CASE WHEN category = 'auth' THEN 'auth' WHEN category IN ('database', 'storage') THEN 'data' END"
GRAPH = f"""{SE}, sided AS (SELECT *, {SIDE} AS side, {GROUP} AS gk FROM se),
flags AS (SELECT repo_id, bool_or(category IN ('hosting', 'cdn')) AND bool_or(side = 'frontend') AS f, bool_or(side = 'backend') AS b FROM sided GROUP BY repo_id),
sized AS (SELECT *, count(*) OVER (PARTITION BY repo_id, side, gk) AS m FROM sided),
pl AS (SELECT s.*, CASE WHEN side = 'frontend' THEN CASE WHEN f THEN 'frontend' WHEN b THEN 'api' ELSE 'user' END ELSE CASE WHEN b THEN 'api' ELSE 'user' END END AS sp, gk IS NOT NULL AND m >= 2 AS layered, f, b FROM sized s JOIN flags USING (repo_id))"""
PREV, CUR = "prev AS (SELECT * FROM se WHERE ord % 5 <> 0)", "cur AS (SELECT * REPLACE (CASE WHEN ord % 11 = 0 THEN 'shifted' ELSE category END AS category) FROM se WHERE ord % 7 <> 0)"
PURL = "'pkg:' || " + "CASE ecosystem " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.PURL_TYPES) + " ELSE ecosystem END || '/' || name || '@' || version"

CHECKED = f"""{SE}, x AS (SELECT *, {NEXT} AS nd, {THRESHOLD} AS th, plan IN ('paid', 'trial') AS pd FROM se),
y AS (SELECT *, date_diff('day', {AS_OF}, nd) AS days, pd AND billing_type <> 'free' AND period NOT IN ('usage-based', 'one-time') AS rec FROM x),
c AS (SELECT repo_id, count(*) FILTER (WHERE status IS NOT NULL) AS st, count(*) FILTER (WHERE status = 'zombie') AS z, count(th) AS tr,
  count(*) FILTER (WHERE th IS NOT NULL AND days < 0) AS od, count(*) FILTER (WHERE th IS NOT NULL AND days >= 0 AND days <= th) AS up, count(*) FILTER (WHERE pd) AS pd,
  count(*) FILTER (WHERE pd AND trim(coalesce(owner, '')) = '') AS noo, count(*) FILTER (WHERE pd AND NOT coalesce(amount > 0, false)) AS noa,
  count(*) FILTER (WHERE rec) AS rec, count(*) FILTER (WHERE rec AND nd IS NULL) AS nor FROM y GROUP BY repo_id),
checks AS (
  SELECT repo_id, unnest(['NO_CRITICAL_VULNS', 'NO_HIGH_VULNS', 'NO_ZOMBIE_SERVICES', 'NO_OVERDUE_RENEWALS', 'NO_UPCOMING_RENEWALS', 'ALL_PAID_HAVE_OWNER', 'ALL_PAID_HAVE_BILLING', 'ALL_PAID_HAVE_RENEWAL']) AS check_id,
    unnest(['security', 'security', 'security', 'security', 'security', 'completeness', 'completeness', 'completeness']) AS kind,
    unnest([0, 0, st, tr, tr, pd, pd, rec]) AS applies, unnest([0, 0, z, od, up, noo, noa, nor]) AS bad FROM c),
ch AS (SELECT repo_id, check_id, kind, CASE WHEN applies = 0 THEN 'unchecked' WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN applies > 0 THEN CAST(bad AS BIGINT) END AS affected FROM checks)"""

HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"

SQL: dict[str, str] = {
    "service_inventory": INVENTORY,
    "cls00_classify": f"WITH {CLS} SELECT {RESULT_COLUMNS} FROM cls",
    "cls01_env_var": rows_of("env_var", "var"),
    "cls02_url_host": rows_of("url", "url"),
    "cls03_npm": rows_of("npm_package", "pkg"),
    "cls04_import": rows_of("import", "pkg"),
    "cls05_config": rows_of("config_file", "cfg"),
    "cls06_ci_secret": rows_of("ci_secret", "var"),
    "cls07_domain": rows_of("domain", "dom"),
    "fn01_hosts": f"SELECT page_id, nullif({HOST}, '') AS host FROM pages",
    "fn02_ignored": f"SELECT page_id, {HOST} IN ({names(rules.IGNORED_DOMAINS)}) AS exact, NOT starts_with({HOST}, 'api.') AND ({' OR '.join(f'''{HOST} = '{d}' OR ends_with({HOST}, '.{d}')''' for d in rules.IGNORED_DOMAINS)}) AS suffix FROM pages",
    "fn04_apex": f"SELECT page_id, split_part(regexp_replace({HOST}, '^www\\.', ''), '.', 1) AS apex FROM pages",
    "fn08_title": f"SELECT p_partkey, {title('p_name')} AS title FROM part",
    "fn09_category": f"SELECT p_partkey, {category('p_name')} AS category FROM part",
    "fn13_key": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS key FROM part",
    "fn19_next_date": f"WITH {SE} SELECT id, {NEXT} AS next_billing FROM se",
    "fn21_threshold": f"WITH {SE} SELECT id, {THRESHOLD} AS threshold FROM se",
    "fn22_monthly": f"WITH {SE} SELECT id, round({MONTHLY}, 4) AS monthly, round({YEARLY}, 4) AS yearly FROM se",
    "fn24_version": f"WITH {DE} SELECT ord, regexp_replace(version, '^[\\^~>=<]', '') AS bare FROM de",
    "fn25_purl": f"WITH {DE} SELECT ord, {PURL} AS purl, regexp_replace(name, '[^a-zA-Z0-9.-]', '-', 'g') AS spdx FROM de",
    "fn27_uuid": "SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT p_partkey, sha256('seed:' || p_name) AS h FROM part)",
    "fn28_path_hash": "SELECT p_partkey, substr(sha256(p_name), 1, 16) AS hash FROM part",
    "fn31_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages",
    "fn36_badge": f"WITH {SE} SELECT id, CAST(date_diff('day', DATE '2024-01-01', next_date) AS INTEGER) AS days, CASE WHEN date_diff('day', DATE '2024-01-01', next_date) < 0 THEN 'OVERDUE' WHEN date_diff('day', DATE '2024-01-01', next_date) < 7 THEN 'URGENT' WHEN date_diff('day', DATE '2024-01-01', next_date) < 30 THEN 'SOON' END AS badge FROM se WHERE next_date IS NOT NULL",
    "agg01_best_per_type": f"WITH {CLS}, {CK} SELECT repo_id, key, type_key, max(score) AS score FROM k GROUP BY ALL",
    "agg02_final_score": f"WITH {CLS}, {CK} SELECT repo_id, key, CAST(sum(s) AS INTEGER) AS final_score FROM (SELECT repo_id, key, type_key, max(score) AS s FROM k GROUP BY ALL) GROUP BY ALL",
    "agg03_first_category": f"WITH {CLS}, {CK} SELECT repo_id, key, coalesce(arg_min(category, (ord, reason)) FILTER (WHERE category <> 'other'), 'other') AS category FROM k GROUP BY ALL",
    "agg04_longest_name": f"WITH {CLS}, {CK} SELECT repo_id, key, arg_max(service_name, (length(service_name), -ord)) AS name FROM k GROUP BY ALL",
    "agg05_reasons": f"WITH {RE}, {RK}, o AS (SELECT repo_id, key, reason, min(ord) AS o FROM k GROUP BY ALL) SELECT repo_id, key, string_agg(reason, '|' ORDER BY o, reason) AS reasons FROM o GROUP BY ALL",
    "agg06_best_evidence": f"WITH {RE}, {RK} SELECT repo_id, key, type_key, evidence_type, reason, score FROM k QUALIFY row_number() OVER (PARTITION BY repo_id, key, type_key ORDER BY score DESC, ord, reason) = 1",
    "agg07_dep_dedup": f"WITH {DE} SELECT repo_id, ecosystem, name, type, version, min(ord) OVER w AS ord FROM de WINDOW w AS (PARTITION BY repo_id, ecosystem, name) QUALIFY row_number() OVER (PARTITION BY repo_id, ecosystem, name ORDER BY CASE WHEN type = 'production' THEN 0 ELSE 1 END, ord) = 1",
    "agg08_by_category": f"WITH {SE} SELECT category, count(*) AS n FROM se GROUP BY ALL",
    "agg09_by_ecosystem": f"WITH {DE} SELECT ecosystem, count(*) AS n FROM de GROUP BY ALL",
    "agg10_confidence": f"WITH {SE} SELECT repo_id, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium, count(*) FILTER (WHERE confidence = 'low') AS low, count(*) FILTER (WHERE needs_review) AS to_review FROM se GROUP BY ALL",
    "agg11_cost_by_category": f"WITH {SE} SELECT category, round(sum({MONTHLY}), 2) AS total, count(*) AS n FROM se WHERE amount > 0 AND billing_type IS NOT NULL GROUP BY ALL",
    "agg12_totals": f"WITH {SE} SELECT repo_id, round(sum({MONTHLY}), 2) AS total_monthly, round(sum({YEARLY}), 2) AS total_yearly, count(*) AS paid FROM se WHERE amount > 0 AND billing_type IS NOT NULL GROUP BY ALL",
    "agg14_checks": f"WITH {CHECKED} SELECT * FROM ch",
    "agg15_score": f"WITH {CHECKED} SELECT repo_id, count(*) FILTER (WHERE status <> 'unchecked') AS total_checks, count(*) FILTER (WHERE status = 'pass') AS passing_checks, CAST(CASE WHEN count(*) FILTER (WHERE status <> 'unchecked') = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE status = 'pass') * 100.0 / count(*) FILTER (WHERE status <> 'unchecked') + 0.5) END AS INTEGER) AS score FROM ch GROUP BY ALL",
    "agg16_history_stats": f"WITH {HI} SELECT repo_id, min(score) AS lowest, max(score) AS highest, CAST(floor(avg(score) + 0.5) AS INTEGER) AS mean, arg_max(score, (ts, score)) AS latest, arg_min(score, (ts, score)) AS first, count(*) AS n, arg_max(score, (ts, score)) - arg_min(score, (ts, score)) AS change FROM hi GROUP BY ALL",
    "agg18_activity": f"WITH {SE} SELECT repo_id, count(*) FILTER (WHERE status = 'zombie') AS zombie, count(*) FILTER (WHERE status = 'stale') AS stale FROM se GROUP BY ALL",
    "agg21_sources": f"WITH {SE} SELECT repo_id, count(*) FILTER (WHERE source = 'inferred') AS inferred, count(*) FILTER (WHERE source = 'manual') AS manual FROM se GROUP BY ALL",
    "agg23_information": f"WITH {SE} SELECT repo_id, count(*) FILTER (WHERE plan = 'free') AS free, count(*) FILTER (WHERE plan = 'unknown') AS unknown, count(*) FILTER (WHERE billing_type = 'automatic' AND period = 'monthly') AS automatic_monthly FROM se GROUP BY ALL",
    "agg24_deps_by_type": f"WITH {DE} SELECT repo_id, type, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM de GROUP BY ALL",
    "jn01_prefix_merge": ROOTS,
    "jn03_generic_removal": f"WITH {RE}, x AS (SELECT repo_id, service_name AS name, category, lower(service_name) IN ({names(rules.GENERIC_SERVICES)}) AS g FROM re) SELECT DISTINCT repo_id, name, category FROM x a WHERE g AND EXISTS (SELECT 1 FROM x b WHERE b.repo_id = a.repo_id AND b.category = a.category AND NOT b.g)",
    "jn04_contains_join": f"WITH {EV}, s AS (SELECT DISTINCT repo_id, split_part(lower(value), '_', 1) AS needle FROM ev WHERE type = 'ci_secret') SELECT DISTINCT e.repo_id, s.needle AS id, e.file FROM ev e JOIN s ON e.repo_id = s.repo_id AND (contains(lower(e.value), s.needle) OR contains(lower(e.file), s.needle))",
    "jn05_last_activity": f"WITH {EV}, {CO}, s AS (SELECT DISTINCT repo_id, split_part(lower(value), '_', 1) AS id FROM ev WHERE type = 'ci_secret'), f AS (SELECT DISTINCT e.repo_id, s.id, e.file FROM ev e JOIN s ON e.repo_id = s.repo_id AND (contains(lower(e.value), s.id) OR contains(lower(e.file), s.id))), m AS (SELECT repo_id, file, max(ts) AS ts FROM co GROUP BY ALL), l AS (SELECT f.repo_id, f.id, max(m.ts) AS last_activity FROM f LEFT JOIN m USING (repo_id, file) GROUP BY ALL) SELECT repo_id, id, last_activity, CAST(floor(abs(epoch(TIMESTAMP '2024-06-30') - floor(epoch(last_activity))) / 86400) AS INTEGER) AS days, CASE WHEN floor(abs(epoch(TIMESTAMP '2024-06-30') - floor(epoch(last_activity))) / 86400) >= 180 THEN 'zombie' WHEN floor(abs(epoch(TIMESTAMP '2024-06-30') - floor(epoch(last_activity))) / 86400) >= 90 THEN 'stale' ELSE 'active' END AS status FROM l",
    "jn08_added": f"WITH {SE}, {PREV}, {CUR} SELECT repo_id, id, category FROM cur WHERE id NOT IN (SELECT id FROM prev)",
    "jn08_removed": f"WITH {SE}, {PREV}, {CUR} SELECT repo_id, id, category FROM prev WHERE id NOT IN (SELECT id FROM cur)",
    "jn09_changed": f"WITH {SE}, {PREV}, {CUR} SELECT c.repo_id, c.id, c.category, p.category AS previous_category FROM cur c JOIN prev p USING (repo_id, id) WHERE c.category <> p.category",
    "jn10_dep_diff": f"WITH {DE}, p AS (SELECT * FROM de WHERE ord % 5 <> 0), c AS (SELECT * FROM de WHERE ord % 7 <> 0) SELECT DISTINCT repo_id, ecosystem, name FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.repo_id = c.repo_id AND p.ecosystem = c.ecosystem AND p.name = c.name)",
    "jn12_merge": f"WITH {SE}, {PREV}, {CUR}, i AS (SELECT * FROM cur WHERE source = 'inferred'), m AS (SELECT * FROM prev WHERE ord % 9 = 0), o AS (SELECT id FROM se WHERE ord % 13 = 0) SELECT repo_id, id, category, owner, CASE WHEN id IN (SELECT id FROM o) THEN 'high' ELSE confidence END AS confidence FROM (SELECT i.repo_id, i.id, i.category, coalesce(nullif(p.owner, ''), i.owner) AS owner, i.confidence FROM i LEFT JOIN (SELECT * FROM prev WHERE source = 'inferred') p USING (repo_id, id) WHERE i.id NOT IN (SELECT id FROM m) UNION ALL SELECT repo_id, id, category, owner, confidence FROM m)",
    "win01_trend": f"WITH {HI} SELECT repo_id, ts, score, score - lag(score) OVER (PARTITION BY repo_id ORDER BY ts, score) AS delta FROM hi",
    "lim01_last_100": f"WITH {HI} SELECT repo_id, ts, score FROM hi QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, score DESC) <= 100",
    "gr02_virtual_nodes": f"WITH {GRAPH} SELECT repo_id, id, label, 'layer' AS type FROM (SELECT repo_id, 'user' AS id, 'User' AS label, true AS x FROM flags UNION ALL SELECT repo_id, 'frontend', 'Frontend', f FROM flags UNION ALL SELECT repo_id, 'api', 'Backend', b FROM flags) WHERE x",
    "gr03_layers": f"WITH {GRAPH} SELECT repo_id, id, CASE WHEN layered THEN 'layer-' || gk ELSE sp END AS parent FROM pl",
    "gr04_edges": f"WITH {GRAPH} SELECT repo_id, source, target, flow_type FROM (SELECT repo_id, 'user' AS source, 'frontend' AS target, 'data' AS flow_type FROM flags WHERE f UNION ALL SELECT repo_id, 'user', 'api', 'data' FROM flags WHERE b UNION ALL SELECT repo_id, 'frontend', 'api', 'data' FROM flags WHERE f AND b UNION ALL (SELECT DISTINCT repo_id, sp, 'layer-' || gk, 'data' FROM pl WHERE layered) UNION ALL SELECT repo_id, CASE WHEN layered THEN 'layer-' || gk ELSE sp END, 'svc-' || id, CASE category WHEN 'payments' THEN 'payment' WHEN 'auth' THEN 'auth' ELSE 'data' END FROM pl)",
    "sbom_purl": f"WITH {DE} SELECT repo_id, ord, {PURL} AS purl, CASE WHEN type = 'production' THEN 'required' ELSE 'optional' END AS scope FROM de",
    "flt01_default": f"WITH {SE} SELECT id FROM se WHERE confidence <> 'low' AND NOT needs_review",
    "flt02_facets": f"WITH {SE} SELECT id FROM se WHERE contains(lower(name), 'service 1') AND plan = 'paid' AND status = 'active'",
    "flt03_review": f"WITH {SE} SELECT id FROM se WHERE needs_review OR confidence = 'low'",
    "flt04_deps": f"WITH {DE} SELECT ord FROM de WHERE contains(lower(name), '-1') AND type = 'peer'",
    "set02_ecosystems": f"WITH {DE} SELECT repo_id, string_agg(DISTINCT e, ',' ORDER BY e) AS ecosystems FROM (SELECT repo_id, CASE ecosystem {' '.join(f'''WHEN '{a}' THEN '{b}' ''' for a, b in rules.ECOSYSTEM_OF_DEPENDENCY)} END AS e FROM de) GROUP BY ALL",
    "set03_id_difference": f"WITH {SE}, {PREV}, {CUR} SELECT 'added' AS kind, id FROM (SELECT id FROM cur EXCEPT SELECT id FROM prev) UNION ALL SELECT 'removed', id FROM (SELECT id FROM prev EXCEPT SELECT id FROM cur)",
}

# Queries whose SQL takes several steps.
BRAND = "CASE " + " ".join(f"WHEN starts_with(key, '{b}-') THEN '{b}'" for b in rules.KNOWN_BRANDS) + " END"
VARIANT = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.KEY_VARIANTS)
BRANDS = f"""WITH {RE}, {RK}, {ROOTED},
m AS (SELECT k.*, r.root FROM k JOIN r ON k.repo_id = r.repo_id AND k.key = r.key),
g AS (SELECT repo_id, root AS was, arg_max(service_name, (length(service_name), -ord)) FILTER (WHERE key = root) AS name, min(ord) FILTER (WHERE key = root) AS ord,
  coalesce(arg_min(category, (ord, reason)) FILTER (WHERE key = root AND category <> 'other'), arg_min(category, (ord, reason)) FILTER (WHERE category <> 'other'), 'other') AS category FROM m GROUP BY repo_id, root),
v AS (SELECT *, CASE was {VARIANT} ELSE was END AS key FROM g), b AS (SELECT *, coalesce({BRAND}, key) AS brand FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY repo_id, brand ORDER BY key = brand DESC, ord) AS i FROM b),
n AS (SELECT repo_id, brand, count(DISTINCT key) AS keys, bool_or(key = brand) AS rooted, bool_or(key <> brand) AS parts, count(*) AS c, arg_min(name, i) AS first, arg_min(was, i) AS was,
  coalesce(arg_min(category, i) FILTER (WHERE category <> 'other'), 'other') AS category FROM o GROUP BY repo_id, brand),
p AS (SELECT *, CASE WHEN c = 1 AND was IN ({names([a for a, _ in rules.KEY_VARIANTS])}) THEN {title(f"(CASE was {VARIANT} END)")} ELSE first END AS plain, {title("brand")} AS branded FROM n),
s AS (SELECT repo_id, brand, CAST(sum(x) AS INTEGER) AS score FROM (SELECT o.repo_id, o.brand, m.type_key, max(m.score) AS x FROM o JOIN m ON m.repo_id = o.repo_id AND m.root = o.was GROUP BY ALL) GROUP BY ALL)
SELECT p.repo_id, p.brand AS key, CASE WHEN NOT parts THEN plain WHEN rooted OR keys > 1 THEN branded WHEN len(string_split_regex(plain, '\\s+')) <= 2 THEN plain ELSE branded END AS name, category, score
FROM p JOIN s ON p.repo_id = s.repo_id AND p.brand = s.brand"""

STRUCTURE = f"""WITH {GRAPH}, e AS ({SQL["gr04_edges"].removeprefix(f"WITH {GRAPH} ")}),
v AS (SELECT repo_id, 'user' AS id FROM flags UNION ALL SELECT repo_id, 'frontend' FROM flags WHERE f UNION ALL SELECT repo_id, 'api' FROM flags WHERE b UNION ALL
  (SELECT DISTINCT repo_id, 'layer-' || gk FROM pl WHERE layered) UNION ALL SELECT repo_id, 'svc-' || id FROM pl),
a AS (SELECT repo_id, string_agg(id, ',' ORDER BY id) AS n FROM v GROUP BY 1), z AS (SELECT repo_id, string_agg(source || '-' || target, ',' ORDER BY source || '-' || target) AS e FROM e GROUP BY 1)
SELECT a.repo_id, n || '|' || coalesce(e, '') AS structure FROM a LEFT JOIN z ON a.repo_id = z.repo_id"""

# Calls of a channel in order: [accepted so far, accepted times in the window], folded from left to right.
CALLS = """WITH c AS (SELECT event_type AS channel, list([epoch_us(ts)] ORDER BY ts) AS calls FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
f AS (SELECT channel, len(calls) AS n, list_reduce(list_prepend([CAST(0 AS BIGINT)], calls), lambda a, x: CASE
    WHEN len(list_filter(a[2:], lambda t: x[1] - t < 3600000000)) < 3 THEN list_concat([a[1] + 1], list_filter(a[2:], lambda t: x[1] - t < 3600000000), x)
    ELSE list_concat([a[1]], list_filter(a[2:], lambda t: x[1] - t < 3600000000)) END) AS a FROM c)
SELECT channel, CAST(a[1] AS BIGINT) AS accepted, CAST(n - a[1] AS BIGINT) AS rejected FROM f"""

FOUND_COUNTS = f"{oracle_more.FOUND}, {oracle_more.COUNTS}"
DOCTOR = f"""{SE}, {FOUND_COUNTS}, q AS (SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(owner, '')) = '') AS no_owner, count(*) FILTER (WHERE plan = 'paid') AS paid,
  count(*) FILTER (WHERE plan = 'paid' AND next_date IS NULL) AS no_date, count(*) FILTER (WHERE needs_review) AS review, count(*) FILTER (WHERE confidence = 'low') AS low,
  count(*) FILTER (WHERE coalesce(category, '') = '') AS no_category, count(*) FILTER (WHERE plan = 'paid' AND coalesce(amount, 0) = 0) AS no_cost,
  coalesce(sum(CASE WHEN period = 'yearly' THEN amount / 12 ELSE amount END) FILTER (WHERE plan = 'paid'), 0) AS cost, repo_id % 3 <> 0 AS config, repo_id % 2 = 0 AS named FROM se GROUP BY repo_id),
w AS (SELECT q.*, coalesce(critical + high, 0) AS severe, coalesce(critical + high + medium + cnt.low + unknown, 0) AS vulns FROM q LEFT JOIN cnt ON q.repo_id = cnt.repo_id),
x(repo_id, section, check_id, applies, affected, level) AS (
  SELECT repo_id, 'configuration', 'config_found', true, CASE WHEN config THEN 0 ELSE 1 END, 'error' FROM w UNION ALL SELECT repo_id, 'configuration', 'config_valid', config, 0, 'error' FROM w
  UNION ALL SELECT repo_id, 'configuration', 'project_name', true, CASE WHEN named THEN 0 ELSE 1 END, 'error' FROM w UNION ALL SELECT repo_id, 'services', 'owners', true, no_owner, 'warning' FROM w
  UNION ALL SELECT repo_id, 'services', 'renewal_dates', paid > 0, no_date, 'error' FROM w UNION ALL SELECT repo_id, 'services', 'reviewed', true, review, 'warning' FROM w
  UNION ALL SELECT repo_id, 'services', 'confidence', true, low, 'warning' FROM w UNION ALL SELECT repo_id, 'services', 'categories', true, no_category, 'warning' FROM w
  UNION ALL SELECT repo_id, 'costs', 'documented', true, no_cost, 'error' FROM w UNION ALL SELECT repo_id, 'costs', 'total', cost > 0, 0, 'error' FROM w
  UNION ALL SELECT repo_id, 'security', 'vulnerabilities', true, vulns, CASE WHEN severe > 0 THEN 'error' ELSE 'warning' END FROM w),
doc AS (SELECT repo_id, section, check_id, CASE WHEN affected > 0 THEN level ELSE 'passed' END AS level, CAST(affected AS BIGINT) AS affected FROM x WHERE applies)"""

SCANNED = f"""{CHECKED}, {FOUND_COUNTS}, sec AS (SELECT ids.repo_id, critical, high FROM (SELECT DISTINCT repo_id FROM se) ids LEFT JOIN cnt ON ids.repo_id = cnt.repo_id),
full_ch AS (SELECT repo_id, status FROM ch WHERE check_id NOT IN ('NO_CRITICAL_VULNS', 'NO_HIGH_VULNS') UNION ALL
  SELECT repo_id, CASE WHEN v IS NULL THEN 'unchecked' WHEN v = 0 THEN 'pass' ELSE 'fail' END FROM (SELECT repo_id, unnest([critical, high]) AS v FROM sec)),
sc AS (SELECT repo_id, count(*) FILTER (WHERE status <> 'unchecked') AS t, count(*) FILTER (WHERE status = 'pass') AS p FROM full_ch GROUP BY 1)"""
SHIELD = "https://img.shields.io/badge/"
BADGES = f"""WITH {SCANNED}, z AS (SELECT sc.repo_id, CAST(CASE WHEN t = 0 THEN 0 ELSE floor(p * 100.0 / t + 0.5) END AS INTEGER) AS score, (SELECT count(*) FROM se WHERE se.repo_id = sc.repo_id) AS services,
    coalesce((SELECT critical + high + medium + low + unknown FROM cnt WHERE cnt.repo_id = sc.repo_id), 0) AS vulns, (SELECT count(*) FROM de WHERE de.repo_id = sc.repo_id) AS deps FROM sc),
b(repo_id, kind, url, label) AS (
  SELECT repo_id, 'score', 'Stack_Score-' || score || '%2F100-' || CASE WHEN score >= 80 THEN 'brightgreen' WHEN score >= 50 THEN 'yellow' ELSE 'red' END, 'Stack Score: ' || score || '/100' FROM z
  UNION ALL SELECT repo_id, 'services', 'svcgraph-' || services || '%20services-gold', 'Services: ' || services FROM z
  UNION ALL SELECT repo_id, 'vulnerabilities', 'Vulnerabilities-' || vulns || '_found-' || CASE WHEN vulns = 0 THEN '3d8c5e' ELSE 'c05050' END, 'Vulnerabilities: ' || vulns || ' found' FROM z
  UNION ALL SELECT repo_id, 'dependencies', 'Dependencies-' || deps || '_tracked-4a8ab0', 'Dependencies: ' || deps || ' tracked' FROM z
  UNION ALL SELECT repo_id, 'scanned', 'Scanned-2024--06--30-8090a6', 'Scanned: 2024-06-30' FROM z)
SELECT repo_id, kind, '{SHIELD}' || url AS url, '![' || label || ']({SHIELD}' || url || ')' AS markdown, '<img src="{SHIELD}' || url || '" alt="' || label || '" />' AS html FROM b"""

PURLED = f"{DE}, pu AS (SELECT *, {PURL} AS purl FROM de)"
SEED = "sha256('svcgraph:app')"
UUID = " || '-' || ".join(f"substr({SEED}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
CYCLONEDX = f"""WITH {PURLED} SELECT repo_id, '{{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"metadata":{{"timestamp":"2024-06-30","tools":[{{"vendor":"svcgraph","name":"svcgraph","version":"1"}}],"component":{{"type":"application","name":"app"}}}},"components":[' ||
  string_agg('{{"type":"library","name":"' || name || '","version":"' || version || '","purl":"' || purl || '","scope":"' || CASE WHEN type = 'production' THEN 'required' ELSE 'optional' END || '"}}', ',' ORDER BY ord) || ']}}' AS document FROM pu GROUP BY repo_id"""
SPDX = f"""WITH {PURLED} SELECT repo_id, '{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"app","documentNamespace":"https://spdx.org/spdxdocs/app-' || {UUID} || '","creationInfo":{{"created":"2024-06-30","creators":["Tool: svcgraph-1"]}},"packages":[' ||
  string_agg('{{"SPDXID":"SPDXRef-Package-' || regexp_replace(name, '[^a-zA-Z0-9.-]', '-', 'g') || '","name":"' || name || '","versionInfo":"' || version || '","downloadLocation":"NOASSERTION","externalRefs":[{{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":"' || purl || '"}}]}}', ',' ORDER BY ord) || ']}}' AS document FROM pu GROUP BY repo_id"""

SQL |= {
    "jn02_brands": BRANDS, "fn37_structure": STRUCTURE, "win04_rate_limit": CALLS, "agg19_doctor": f"WITH {DOCTOR} SELECT * FROM doc",
    "agg19_doctor_summary": f"WITH {DOCTOR} SELECT repo_id, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings, count(*) FILTER (WHERE level = 'passed') AS passed FROM doc GROUP BY 1",
    "snk06_cyclonedx": CYCLONEDX, "snk07_spdx": SPDX, "snk08_badges": BADGES,
}

SQL |= oracle_files.SQL | oracle_more.SQL
SQL |= {"win04_stream": SQL["win04_rate_limit"], "lim01_stream": SQL["lim01_last_100"]}


def _layers(edges: str, most: int = 6) -> str:
    """Ranks by a walk over all paths, then places rank by rank."""
    steps, done = [], ""
    for k in range(most):
        mean = "0.0" if not k else f"(SELECT avg(p.place) FROM e JOIN ({done}) p ON p.repo_id = e.repo_id AND p.id = e.source WHERE e.repo_id = r.repo_id AND e.target = r.id)"
        steps.append(f"m{k} AS (SELECT repo_id, id, rank, {mean} AS mean FROM r WHERE rank = {k}), p{k} AS (SELECT repo_id, id, rank, row_number() OVER (PARTITION BY repo_id ORDER BY mean NULLS FIRST, id) - 1 AS place FROM m{k})")
        done += f"{' UNION ALL ' if k else ''}SELECT repo_id, id, rank, place FROM p{k}"
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT repo_id, source, target FROM ({edges})), n AS (SELECT repo_id, source AS id FROM e UNION SELECT repo_id, target FROM e),
w(repo_id, id, depth) AS (SELECT repo_id, id, 0 FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo_id = n.repo_id AND e.target = n.id) UNION SELECT w.repo_id, e.target, w.depth + 1 FROM w JOIN e ON e.repo_id = w.repo_id AND e.source = w.id),
r AS (SELECT repo_id, id, max(depth) AS rank FROM w GROUP BY ALL), {", ".join(steps)} {done}"""


SQL |= {"gr05_layers": _layers(SQL["gr04_edges"])}


def _lines(document: str) -> str:
    """A bill of materials line by line, from the SQL of the whole one: its head, each component with a comma but the first, its end."""
    before, _, rest = document.partition(" ||\n  string_agg(")
    known, _, head = before.partition(" SELECT repo_id, ")
    item = rest.partition(", ',' ORDER BY ord)")[0]
    return f"""{known} SELECT DISTINCT repo_id, 0 AS section, 0::BIGINT AS place, {head} AS line FROM pu UNION ALL SELECT DISTINCT repo_id, 2, 0, ']}}' FROM pu
UNION ALL SELECT repo_id, 1, ord, CASE WHEN ord = min(ord) OVER (PARTITION BY repo_id) THEN '' ELSE ',' END || {item} FROM pu"""


SQL |= {"snk06_lines": _lines(CYCLONEDX), "snk07_lines": _lines(SPDX)}
SQL["snk01_lines"] = f"""WITH {SE} SELECT DISTINCT repo_id, 0 AS section, 0::BIGINT AS place, '[' AS line FROM se UNION ALL SELECT DISTINCT repo_id, 2, 0, ']' FROM se
UNION ALL SELECT repo_id, 1, ord, CASE WHEN ord = min(ord) OVER (PARTITION BY repo_id) THEN '' ELSE ',' END || '{{"id":"' || id || '","name":"' || name || '","category":"' || category || '","needs_review":' || needs_review || CASE WHEN url IS NULL THEN '' ELSE ',"url":"' || url || '"' END || '}}' FROM se"""
