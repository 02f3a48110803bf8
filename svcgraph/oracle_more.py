"""DuckDB SQL for queries_more, written apart from the operators."""

from __future__ import annotations

from .functions import rules
from .sources import adapters as A
from .sources import file_adapter as T

EV, DE, SE, HI = (f"{n} AS ({A.duckdb(x)})" for n, x in (("ev", A.EVIDENCE), ("de", A.DEPENDENCY), ("se", A.SERVICE), ("hi", A.HISTORY)))
MONTHLY = "coalesce(CASE WHEN period = 'yearly' THEN amount / 12 WHEN period = 'monthly' THEN amount END, 0)"
FOUND = f"""{DE}, k AS (SELECT *, CASE ecosystem {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.ADVISORY_ECOSYSTEMS)} END AS ae, regexp_replace(version, '^[\\^~>=<]', '') AS bare FROM de),
adv AS (SELECT DISTINCT ae, name, bare FROM k WHERE ae IS NOT NULL AND ord % 3 = 0),
f1 AS (SELECT * FROM k WHERE ae IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, ae, name ORDER BY ord) = 1),
found AS (
  SELECT f1.repo_id, f1.ecosystem, f1.name, f1.version, CASE WHEN i = 3 THEN 'unknown' ELSE 'A-' || f1.name || '-' || i END AS advisory,
    CASE WHEN i = 1 THEN 'No description' ELSE repeat('s', least(200, CAST(150 + 30 * i AS INT))) END AS summary, CASE i WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' WHEN 3 THEN 'unknown' ELSE 'high' END AS severity
  FROM f1 JOIN adv ON f1.ae = adv.ae AND f1.name = adv.name AND f1.bare = adv.bare, range(0, 5) t(i)
)"""
COUNTS = "cnt AS (SELECT repo_id, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "unknown")) + " FROM found GROUP BY repo_id)"
NODE = "SELECT repo_id, 'node' AS part, 'svc-' || id AS a, CAST(NULL AS STRING) AS b FROM se"
EDGE = "SELECT repo_id, 'edge', 'user', 'svc-' || id FROM se WHERE ord % 3 = 0"
ODD = "chr(1) || ' a' || chr(127) || name || chr(9) || ' tok_abcdef '"
REGISTRY = {"npm": "https://www.npmjs.com/package/", "pip": "https://pypi.org/project/", "cargo": "https://crates.io/crates/", "composer": "https://packagist.org/packages/", "go": "https://pkg.go.dev/", "dart": "https://pub.dev/packages/", "maven": "https://search.maven.org/search?q=", "gradle": "https://search.maven.org/search?q=", "gem": "https://rubygems.org/gems/", "nuget": "https://www.nuget.org/packages/"}

SQL: dict[str, str] = {
    "jn18_advisories": f"WITH {FOUND} SELECT * FROM found",
    "agg13_severities": f"WITH {FOUND}, {COUNTS} SELECT * FROM cnt",
    "flt09_gate": f"WITH {SE}, {FOUND}, r AS (SELECT repo_id, bool_or(needs_review) AS n FROM se GROUP BY 1), b AS (SELECT repo_id, bool_or(severity IN ('critical', 'high')) AS x FROM found GROUP BY 1) SELECT coalesce(r.repo_id, b.repo_id) AS repo_id, CASE WHEN coalesce(x, false) THEN 1 WHEN coalesce(n, false) THEN 2 ELSE 0 END AS exit_code FROM r FULL JOIN b ON r.repo_id = b.repo_id",
    "jn19_badges": f"WITH {FOUND} SELECT ord, (SELECT count(*) FROM found f WHERE f.repo_id = de.repo_id AND f.ecosystem = de.ecosystem AND f.name = de.name) AS advisories FROM de",
    "agg14_checks_scanned": f"WITH {SE}, {FOUND}, {COUNTS}, r AS (SELECT DISTINCT repo_id FROM se), j AS (SELECT r.repo_id, cnt.critical, cnt.high FROM r LEFT JOIN cnt ON r.repo_id = cnt.repo_id), x AS (SELECT repo_id, 'NO_CRITICAL_VULNS' AS check_id, critical AS n FROM j UNION ALL SELECT repo_id, 'NO_HIGH_VULNS', high FROM j) SELECT repo_id, check_id, 'security' AS kind, CASE WHEN n IS NULL THEN 'unchecked' WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, n AS affected FROM x",
    "jn15_missing_nodes": f"WITH {SE} {NODE} WHERE ord % 2 = 1 UNION ALL SELECT repo_id, 'edge', 'user', 'svc-' || id FROM se WHERE ord % 2 = 1",
    "jn16_saved_graph": f"""WITH {SE}, n AS (SELECT repo_id, 'svc-' || id AS id FROM se WHERE ord % 2 = 0 AND (repo_id % 10 <> 3 OR ord % 4 = 0) OR ord % 10 = 1),
d AS (SELECT repo_id, 'svc-' || id AS source, 'svc-' || id AS target FROM se WHERE ord % 5 = 1)
SELECT repo_id, 'node' AS part, id AS a, CAST(NULL AS STRING) AS b FROM n UNION ALL {EDGE} AND ord % 2 = 0
UNION ALL SELECT repo_id, 'edge', source, target FROM d WHERE EXISTS (SELECT 1 FROM n WHERE n.repo_id = d.repo_id AND n.id = source)""",
    "jn16_saved_nodes": f"""WITH {SE}
SELECT repo_id, 'svc-' || id AS id, CASE WHEN ord % 4 = 0 AND ord % 8 <> 0 THEN 'L-' || name ELSE name END AS label, CASE WHEN ord % 12 = 0 THEN 'cdn' ELSE 'service' END AS type, id AS service_id,
  CASE WHEN ord % 4 <> 0 THEN category WHEN ord % 16 = 0 THEN 'saved' END AS category, CASE WHEN ord % 4 <> 0 THEN plan END AS plan, confidence, CASE WHEN ord % 4 <> 0 THEN url END AS url, CASE WHEN ord % 4 = 0 THEN 'n' END AS note,
  CASE WHEN ord % 4 <> 0 THEN source END AS source, CAST(NULL AS STRING) AS layer_color, CASE WHEN repo_id % 10 = 3 THEN 1.0::DOUBLE END AS x, CASE WHEN repo_id % 10 = 3 THEN 2.0::DOUBLE END AS y
FROM se WHERE ord % 2 = 0 AND (repo_id % 10 <> 3 OR ord % 4 = 0)
UNION ALL SELECT repo_id, 'svc-' || id, name, 'external', NULL, NULL, 'unknown', 'high', NULL, 'n', 'manual', NULL, 1.0, 2.0 FROM se WHERE ord % 10 = 1""",
    "jn17_retyped": f"""WITH {SE} SELECT repo_id, v.e AS source, 'svc-' || id AS target, CASE WHEN ord % 5 = 0 AND v.e = 'user' THEN 'auth' ELSE 'data' END AS flow_type FROM se, (VALUES ('user'), ('api')) v(e) WHERE ord % 3 = 0""",
    "jn20_labelled": f"WITH {SE} SELECT repo_id, 'user' AS source, 'svc-' || id AS target, 'data' AS flow_type, 'user' AS source_label, CASE WHEN ord % 2 = 0 THEN name ELSE 'svc-' || id END AS target_label FROM se WHERE ord % 3 = 0",
    "gr06_without": f"WITH {SE} {NODE} WHERE ord % 7 <> 0 UNION ALL {EDGE} AND ord % 7 <> 0",
    "gr07_overlaid": f"WITH {SE} SELECT repo_id, id, CASE WHEN ord % 4 = 0 THEN 'edited' ELSE category END AS category, CASE WHEN ord % 4 = 0 THEN 'high' ELSE confidence END AS confidence FROM se WHERE ord % 8 <> 0 UNION ALL SELECT repo_id, 'n-' || id, 'added', 'high' FROM se WHERE ord % 9 = 0",
    "jn13_model_merge": f"""WITH {SE}
SELECT repo_id, id, name, CASE WHEN ord % 3 = 0 AND category = 'other' THEN 'ai' ELSE category END AS category,
  CASE WHEN ord % 6 = 0 AND confidence <> 'high' THEN 'high' WHEN ord % 3 = 0 AND confidence = 'low' THEN 'medium' ELSE confidence END AS confidence,
  CASE WHEN ord % 6 = 0 AND confidence <> 'high' OR ord % 3 = 0 AND confidence = 'low' THEN false ELSE needs_review END AS needs_review,
  'scan' || CASE WHEN ord % 3 = 0 THEN '|model' ELSE '' END || CASE WHEN ord % 6 = 0 THEN '|again' ELSE '' END AS reasons FROM se
UNION ALL SELECT repo_id, 'x-' || id, 'New', CASE WHEN ord % 20 = 0 THEN 'cdn' ELSE 'other' END, CASE WHEN ord % 20 = 0 THEN 'medium' ELSE 'low' END, ord % 20 <> 0, CASE WHEN ord % 20 = 0 THEN 'model|more' ELSE 'model' END FROM se WHERE ord % 10 = 0""",
    "jn14_config_overlay": f"""WITH {SE}, c AS (SELECT repo_id, id, name, ord FROM se WHERE ord % 11 = 0), m AS (SELECT s.repo_id, s.id, min(c.ord) AS o FROM se s JOIN c ON c.repo_id = s.repo_id AND (c.id = s.id OR c.name = s.name) GROUP BY ALL)
SELECT se.repo_id, se.id, CASE WHEN o IS NOT NULL THEN 'c' || o ELSE owner END AS owner, CASE WHEN o IS NOT NULL THEN 'free' ELSE plan END AS plan FROM se LEFT JOIN m ON m.repo_id = se.repo_id AND m.id = se.id""",
    "jn22_relevant_files": f"""WITH {EV}, x AS (SELECT DISTINCT repo_id, split_part(lower(value), '_', 1) AS needle FROM ev WHERE type = 'ci_secret'),
f AS (SELECT x.repo_id, CASE WHEN x.repo_id % 2 = 0 THEN needle ELSE 'no-' || needle END AS id, e.file, min(e.ord) AS o FROM x JOIN ev e ON e.repo_id = x.repo_id AND contains(lower(e.value), x.needle) GROUP BY ALL)
SELECT repo_id, id, file, CAST(row_number() OVER (PARTITION BY repo_id, id ORDER BY o, file) AS INT) AS k FROM f QUALIFY k <= 3""",
    "jn23_restored": f"""WITH {SE}, x AS (SELECT repo_id, id, name, EXISTS (SELECT 1 FROM se c WHERE c.ord % 6 = 1 AND c.repo_id = se.repo_id AND c.name = se.name) AS back FROM se WHERE confidence = 'low')
SELECT repo_id, CASE WHEN back THEN 'service' ELSE 'discarded' END AS part, CASE WHEN back THEN replace(lower(name), ' ', '-') ELSE id END AS item, name FROM x""",
    "ai01_keep": f"WITH {SE}, x AS (SELECT *, ord % 3 = 0 AND repo_id % 5 <> 0 AS k, bool_or(ord % 3 = 0 AND repo_id % 5 <> 0) OVER (PARTITION BY repo_id) AS any_kept FROM se) SELECT repo_id, id FROM x WHERE k OR NOT any_kept",
    "ai02_actions": f"""WITH {SE}, keep AS (SELECT repo_id, min(ord) AS k FROM se WHERE confidence <> 'high' AND ord % 7 = 0 GROUP BY 1), o AS (SELECT se.*, k FROM se LEFT JOIN keep USING (repo_id) WHERE confidence <> 'high'),
taken AS (SELECT repo_id, string_agg('r-' || id, '|' ORDER BY ord) AS t FROM o WHERE ord % 5 = 0 AND ord <> k GROUP BY 1)
SELECT repo_id, id, category, confidence, needs_review, 'r-' || id AS reasons FROM se WHERE confidence = 'high'
UNION ALL SELECT repo_id, id, CASE WHEN ord % 3 = 0 AND ord % 9 <> 0 THEN 'email' ELSE category END, CASE WHEN ord % 4 = 1 THEN 'low' ELSE confidence END, CASE WHEN ord % 4 = 1 THEN true ELSE needs_review END,
  'r-' || id || CASE WHEN ord = k THEN coalesce('|' || t, '') ELSE '' END
FROM o LEFT JOIN taken USING (repo_id) WHERE (ord % 5 <> 0 OR k IS NULL OR ord = k) AND ord % 13 <> 0""",
    "jn07_activity": f"WITH {SE} SELECT repo_id, id, CASE WHEN ord % 2 = 0 THEN ord END AS days FROM se",
    "src09_snapshots": "SELECT p_partkey AS repo_id, 'a' || p_size AS id, 'email' AS category FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'b', NULL FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 <> 0",
    "src10_histories": "SELECT p_partkey AS repo_id, CAST(0 AS INT) AS at, CAST(p_size AS INT) AS score FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT p_partkey, 1, 1 FROM part WHERE p_partkey % 3 = 2",
    "src07_configurations": "SELECT p_partkey AS repo_id, CAST(0 AS INT) AS ord, CASE WHEN p_partkey % 4 = 2 THEN 's' ELSE 'b' END || p_size AS id, 'o' AS owner FROM part",
    "set05_evidence_files": f"WITH {EV} SELECT DISTINCT repo_id, file FROM ev",
    "lim05_batches": f"WITH {DE}, x AS (SELECT *, CAST((row_number() OVER (PARTITION BY repo_id ORDER BY ord) - 1) // 100 AS INT) AS batch FROM de) SELECT repo_id, batch, count(*) AS n, min(ord) AS first FROM x GROUP BY ALL",
    "flt05_discarded": f"WITH {SE} SELECT id FROM se WHERE contains(lower(name), 'ice 9') AND plan = 'paid'",
    "agg17_reasons": f"WITH {SE} SELECT plan AS reason, count(*) AS n FROM se GROUP BY ALL",
    "fn15_rank": f"WITH {SE} SELECT id, CAST(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS INT) AS rank FROM se",
    "fn20_renewed": f"WITH {SE} SELECT id, DATE '2024-02-29' AS last_renewed, DATE '2025-03-01' AS next_date FROM se WHERE billing_type = 'manual' AND period = 'yearly'",
    "fn29_review": f"WITH {SE} SELECT id, CASE WHEN confidence = 'high' THEN false ELSE ord % 3 = 0 OR category = 'other' OR ord % 2 = 1 END AS review FROM se",
    "fn30_band": f"WITH {HI} SELECT event_id, CASE WHEN score >= 80 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS band FROM hi",
    "fn32_sanitized": r"""SELECT page_id, trim(left(regexp_replace(' ' || html, '[\x00-\x1F\x7F]', '', 'g'), 200)) AS clean FROM pages""",
    "fn33_redacted": r"""SELECT page_id, CASE WHEN split_part(url, '/', 3) = '' THEN url || ' failed: ' || html ELSE replace(url || ' failed: ' || html, split_part(url, '/', 3), left(split_part(url, '/', 3), 4) || '****') END AS message FROM pages""",
    "fn34_traversal": r"""SELECT page_id, list_contains(string_split_regex(CASE page_id % 4 WHEN 0 THEN url || '/../x' WHEN 1 THEN url || '..' WHEN 2 THEN url || chr(92) || '..' ELSE url END, '[/\\]'), '..') AS unsafe FROM pages""",
    "fn35_budget": f"""WITH {SE}, b AS (SELECT DISTINCT repo_id, CASE WHEN repo_id % 5 <> 0 THEN (repo_id + 1) * 100000.0 ELSE 0 END AS m, CASE WHEN repo_id % 3 = 0 THEN 50 ELSE 80 END AS th FROM se),
t AS (SELECT repo_id, sum({MONTHLY}) AS spent FROM se WHERE amount > 0 AND billing_type IS NOT NULL GROUP BY 1), x AS (SELECT b.repo_id, th, coalesce(spent, 0) AS spent, CASE WHEN m > 0 THEN coalesce(spent, 0) / m * 100 END AS p FROM b LEFT JOIN t ON b.repo_id = t.repo_id)
SELECT repo_id, round(spent, 2) AS spent, round(p, 4) AS percent, CASE WHEN p > 100 THEN 'red' WHEN p >= th THEN 'yellow' ELSE 'green' END AS colour FROM x""",
    "fn38_registry": f"WITH {DE} SELECT ord, CASE ecosystem {' '.join(f'''WHEN '{a}' THEN '{b}' ''' for a, b in REGISTRY.items())} END || name AS url FROM de",
    "fn39_slugs": r"""SELECT page_id, regexp_matches(split_part(url, '/', 4) || '/' || split_part(url, '/', 5), '^[a-zA-Z0-9_.\-]+/[a-zA-Z0-9_.\-]+$') AS slug,
CASE page_id % 3 WHEN 2 THEN regexp_matches(lower(url), '^https?://[^/?#:]') ELSE false END AS base FROM pages""",
    "agg22_share": f"WITH {SE}, {DE}, a AS (SELECT repo_id, count(*) AS services, CAST(floor(sum(coalesce(CASE WHEN period = 'yearly' THEN amount / 12 ELSE amount END, 0)) + 0.5) AS BIGINT) AS monthly_cost FROM se GROUP BY 1), b AS (SELECT repo_id, count(*) AS n FROM de GROUP BY 1) SELECT a.repo_id, services, coalesce(n, 0) AS dependencies, monthly_cost FROM a LEFT JOIN b ON a.repo_id = b.repo_id",
    "flt08_notifications": f"""WITH {SE}, x AS (SELECT repo_id, name, CAST(date_diff('day', DATE '2000-01-01', next_date) AS INT) AS days FROM se WHERE next_date IS NOT NULL), y AS (SELECT *, count(*) OVER (PARTITION BY repo_id) AS n FROM x WHERE days BETWEEN 1 AND 30)
SELECT repo_id, name || ' renews in ' || days || ' days' AS message FROM y WHERE n <= 3 UNION ALL SELECT repo_id, count(*) || ' renewals coming up: ' || string_agg(name, ', ' ORDER BY days, name) FROM y WHERE n > 3 GROUP BY repo_id""",
    "snk02_markdown": f"""WITH {SE}, {DE}, v AS (SELECT * FROM se WHERE confidence <> 'low' AND NOT needs_review), c AS (SELECT repo_id, category, min(ord) AS block FROM v GROUP BY ALL),
r AS (SELECT repo_id FROM v UNION SELECT repo_id FROM de), n AS (SELECT repo_id, count(*) AS n FROM de GROUP BY ALL), z AS (SELECT *, '- **' || name || '** (last activity: ' || coalesce(strftime(last_renewed, '%Y-%m-%d'), 'unknown') || CASE WHEN ord % 3 = 0 THEN ', ' || (ord % 400) || ' days ago' ELSE '' END || ')' AS item FROM v WHERE status IN ('zombie', 'stale')),
a AS (SELECT * FROM se WHERE ord % 40 = 0), last AS (SELECT 9223372036854775807 AS e),
lines(repo_id, section, block, place, line) AS (
  SELECT repo_id, 0, 0, unnest([-5, -4, -3, -2]), unnest(['# Services - ' || repo_id, '', 'Generated on 2024-06-30', '']) FROM r
  UNION ALL SELECT repo_id, 1, block, unnest([-5, -4, -3, -2, e]), unnest(['## ' || upper(category[1:1]) || category[2:], '', '| Service | Plan | Confidence |', '|---|---|---|', '']) FROM c, last
  UNION ALL SELECT repo_id, 1, block, ord, '| ' || name || ' | ' || plan || ' | ' || confidence || ' |' FROM v JOIN c USING (repo_id, category)
  UNION ALL SELECT repo_id, 2, 0, unnest([-5, -4, -3, -2, e]), unnest(['## Dependencies (' || n || ')', '', '| Name | Version | Type | Ecosystem |', '|---|---|---|---|', '']) FROM n, last
  UNION ALL SELECT repo_id, 2, 0, ord, '| ' || name || ' | ' || version || ' | ' || type || ' | ' || ecosystem || ' |' FROM de
  UNION ALL SELECT DISTINCT repo_id, 3, 0, unnest([-3, -2]), unnest(['## Zombie Services', '']) FROM z
  UNION ALL SELECT DISTINCT repo_id, 3, CASE status WHEN 'zombie' THEN 1 ELSE 2 END, unnest([-3, -2, e]), unnest([CASE status WHEN 'zombie' THEN '### Zombie (6+ months inactive)' ELSE '### Stale (3-6 months inactive)' END, '', '']) FROM z, last
  UNION ALL SELECT repo_id, 3, CASE status WHEN 'zombie' THEN 1 ELSE 2 END, ord, item FROM z
  UNION ALL SELECT DISTINCT repo_id, 4, 0, unnest([-6, -5, -4, -3, -2, e][2:]), unnest(['## Stack Alternatives', '', '| Service | Alternative | Type | Savings | Reason |', '|---|---|---|---|---|', '']) FROM a, last
  UNION ALL SELECT repo_id, 4, 0, ord, '| ' || name || ' | Alt | open | ' || CASE WHEN ord % 80 <> 0 THEN '$5' ELSE '-' END || ' | r |' FROM a
  UNION ALL SELECT repo_id, 5, 0, -2, '---' FROM r)
SELECT repo_id, CAST(section AS INT) AS section, CAST(block AS BIGINT) AS block, CAST(place AS BIGINT) AS place, line FROM lines""",
    "snk04_html": f"WITH {SE} SELECT repo_id, '<table>' || chr(10) || string_agg('<tr><td>' || name || '</td><td>' || category || '</td><td>' || plan || '</td></tr>', chr(10) ORDER BY category, name, plan) || chr(10) || '</table>' AS document FROM se GROUP BY repo_id",
}

P = "CAST(p_size AS STRING)"
READABLE = "FROM part WHERE p_partkey % 5 IN (0, 1, 4)"
SQL |= {
    "src11_git_activity": f"SELECT * FROM ({A.duckdb(A.COMMIT)}) WHERE repo_id IN (1, 4, 7, 12)",
    "src12_advisories": SQL["jn18_advisories"],
    "snk02_documents": SQL["snk02_markdown"].rpartition("SELECT repo_id, CAST(section")[0] + "SELECT CAST(repo_id AS VARCHAR) AS document, row_number() OVER (PARTITION BY repo_id ORDER BY section, block, place) - 1 AS n, line FROM lines",
    "src08_services": f"SELECT p_partkey AS repo_id, CAST(0 AS INT) AS ord, 's' || {P} AS id, 'S' || {P} AS name, 'email' AS category {READABLE} UNION ALL SELECT p_partkey, 1, 'x', 'X', NULL {READABLE}",
    "src08_rejects": "SELECT p_partkey AS repo_id, CASE p_partkey % 5 WHEN 2 THEN '{oops' ELSE '[1]' END AS body, CASE p_partkey % 5 WHEN 2 THEN 'not JSON' ELSE 'no object' END AS reason FROM part WHERE p_partkey % 5 IN (2, 3)",
    "src13_nodes": f"""SELECT p_partkey AS repo_id, 'svc-s' || {P} AS id, 'S' || {P} AS label, 'database' AS type, 's' || {P} AS service_id {READABLE}
UNION ALL SELECT p_partkey, 'n' || p_partkey, 'N', 'external', NULL {READABLE} UNION ALL SELECT p_partkey, 'svc-x', 'X', 'external', 'x' {READABLE} UNION ALL SELECT p_partkey, 'user', 'User', 'layer', NULL {READABLE}""",
    "src13_edges": f"SELECT p_partkey AS repo_id, 'n' || p_partkey AS source, 'svc-s' || {P} AS target, 'data' AS flow_type {READABLE} UNION ALL SELECT p_partkey, 'user', 'svc-x', 'data' {READABLE}",
    "ai07_budget": """WITH f AS (SELECT CAST(doc_id % 50 AS INT) AS repo_id, 'p' || doc_id AS path, doc_id AS ord, CASE WHEN len(string_split(text, chr(10))) > 5 THEN array_to_string(string_split(text, chr(10))[1:5], chr(10)) || chr(10) || '[... truncated]' ELSE text END AS content FROM documents),
c AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY repo_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE content IS NOT NULL),
k AS (SELECT repo_id, path, CASE WHEN before + length(content) <= 5000 THEN content ELSE left(content, CAST(5000 - before AS INT)) || chr(10) || '[... truncated]' END AS content FROM c WHERE before + length(content) <= 5000 OR 5000 - before > 200)
SELECT repo_id, path, length(content) AS n, md5(content) AS digest FROM k""",
    "srt06_priority_files": f"""WITH w AS (SELECT DISTINCT repo_id, path FROM ({A.duckdb(T.WALK)}) x WHERE regexp_matches(path, '[^/]\\.(ts|tsx|js|jsx|py|go|rs)$'))
SELECT repo_id, path, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY (contains(path, 'lib/') OR contains(path, 'api/') OR contains(path, 'config')) DESC, string_split(path, '/')) AS INT) AS k FROM w QUALIFY k <= 4""",
    "jn21_context": f"WITH {SE} SELECT repo_id, id, CASE WHEN ord % 3 = 0 THEN 'u1' END AS usage, CASE WHEN ord % 3 = 0 THEN 'optional' END AS level, CASE WHEN ord % 3 = 0 THEN '' END AS warnings FROM se",
    "srt01_by_name": f"WITH {DE}, x AS (SELECT repo_id, CASE WHEN ord % 2 = 0 THEN upper(name) ELSE name END AS name, ord FROM de) SELECT repo_id, name, ord, row_number() OVER (PARTITION BY repo_id ORDER BY name COLLATE en, ord) - 1 AS place FROM x",
    "srt01_by_type": f"WITH {DE} SELECT repo_id, type, ord, row_number() OVER (PARTITION BY repo_id ORDER BY type COLLATE en DESC, ord) - 1 AS place FROM de",
}

SEED = A.duckdb(T.SEED)
SQL |= {
    "snk09_snapshot": f"WITH {SE} SELECT repo_id, id, CASE WHEN repo_id % 3 = 0 THEN 'new' ELSE category END AS category FROM se",
    "snk10_history": f"WITH {HI} SELECT repo_id, ts, score FROM hi QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, score DESC) <= 100",
    "snk11_encrypted": f"WITH {SE} SELECT id, owner, true AS hidden FROM se",
    "src17_scan": f"""SELECT CAST(k AS INT) AS repo_id, 'npm_package' AS type, 'p' || b AS value, 'packages/' || a || '/package.json' AS file FROM ({SEED})
UNION ALL SELECT CAST(k AS INT), 'npm_package', 'p' || b, a || '/package.json' FROM ({SEED})""",
    "lim03_packages": f"""SELECT CAST(k % 3 AS INT) AS repo_id, 'npm-workspaces' AS kind, 'packages/p' || k AS package FROM ({SEED}) x WHERE EXISTS (SELECT 1 FROM ({SEED}) y WHERE y.k < 3 AND y.k = x.k % 3)
QUALIFY row_number() OVER (PARTITION BY x.k % 3 ORDER BY 'packages/p' || k) <= 500""",
    "mut02_manual": f"WITH {SE} {NODE} WHERE ord % 4 = 0 OR ord % 6 = 0 UNION ALL SELECT repo_id, 'edge', 'user', 'svc-' || id FROM se WHERE ord % 3 = 0 AND ord % 4 = 0 OR ord % 6 = 0 AND ord % 4 <> 0",
    "mut03_updated": f"""WITH {SE} SELECT repo_id, id, CASE WHEN ord % 10 = 0 THEN 'other' WHEN ord % 5 = 0 THEN 'email' ELSE category END AS category, CASE WHEN ord % 15 = 0 THEN 'high' WHEN ord % 5 = 0 THEN 'medium' ELSE confidence END AS confidence,
CASE WHEN ord % 15 = 0 THEN false WHEN ord % 10 = 0 THEN true WHEN ord % 5 = 0 THEN false ELSE needs_review END AS needs_review FROM se""",
    "mut06_budgets": """SELECT p_partkey AS repo_id, CASE WHEN p_partkey % 12 = 0 THEN 9.0 WHEN p_partkey % 3 = 0 THEN 7.0 ELSE p_size END::DOUBLE AS monthly, CASE WHEN p_partkey % 3 = 0 THEN 50.0 ELSE 80.0 END::DOUBLE AS threshold
FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND (p_partkey % 6 <> 0 OR p_partkey % 12 = 0)""",
    "snk03_summary": f"WITH {SE}, c AS (SELECT repo_id, category, count(*) AS n FROM se GROUP BY ALL) SELECT repo_id, string_agg(category || ': ' || n, chr(10) ORDER BY n DESC, category) AS document FROM c GROUP BY ALL",
    "snk12_diff": f"WITH {SE}, x AS (SELECT repo_id, id, CASE WHEN ord % 5 = 0 THEN 'added' ELSE 'removed' END AS kind FROM se WHERE (ord % 5 = 0) <> (ord % 7 = 0)) SELECT repo_id, string_agg('- ' || kind || ': ' || id, chr(10) ORDER BY kind, id) AS document FROM x GROUP BY ALL",
}
