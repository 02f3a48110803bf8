"""DuckDB SQL for the queries over repository files: what each template holds, told from the part table and not by parsing."""

from __future__ import annotations

from .functions import rules
from .sources import adapters as A
from .sources import file_adapter as T

SEED = A.duckdb(T.SEED)
REPO = "CAST(k % 20 AS INT)"

# query -> (type, value, line) of its evidence
EVIDENCE: dict[str, list[tuple[str, str, int | None]]] = {
    "tvf01_package_json": [("npm_package", "§a-§b", None), ("npm_package", "react", None), ("npm_package", "dev-§b", None), ("npm_package", "peer-§a", None)],
    "tvf02_env": [("env_var", "§A_KEY", 2), ("env_var", "API_URL", 3), ("url", "https://api.§a.io/v§v", 3), ("env_var", "SITE", 4), ("env_var", "MAIN_DATABASE_URL", 6), ("domain", "postgresql", 6)],
    "tvf03_compose": [("domain", "§a", None), ("domain", "postgres", None), ("config_file", "docker-service:§a", None), ("config_file", "docker-service:db§b", None)],
    "tvf04_workflow": [("config_file", "github-actions", None), ("ci_secret", "§A_TOKEN", None), ("ci_secret", "DEPLOY_KEY_ID", None), ("config_file", "action:acme/§a", None)],
    "tvf05_config_names": [("config_file", "vercel.json", None)],
    "tvf06_source": [("import", "@§a/sdk", 1), ("url", "https://api.§a.io/v§v", 2), ("domain", "api.§a.io", 2), ("env_var", "APP_SECRET", 3), ("import", "lodash-§b", 4)],
    "tvf07_content_lines": [("url", "https://c§b.io/", 3), ("domain", "c§b.io", 3)],
    "tvf13_terraform": [("config_file", "terraform:§a", None), ("config_file", "terraform:q§b", None), ("config_file", "terraform:google", None)],
    "tvf14_csproj": [("import", "§A.Lib", None), ("import", "T§b", None)],
    "tvf15_appsettings": [("domain", "sqlserver", None), ("env_var", "STRIPE_APIKEY", None), ("env_var", "STRIPE_APIKEY", None), ("url", "https://api.§a.io/", None)],
    "tvf16_web_config": [("domain", "sqlserver", None), ("env_var", "§A_KEY", None), ("url", "https://api.§a.io/", None)],
    "tvf17_pom": [("import", "lib-§b", None), ("import", "junit", None)],
    "tvf18_gradle": [("import", "lib-§b", None), ("import", "u§b", None)],
    "tvf19_properties": [("domain", "mysql", None), ("domain", "redis", None), ("env_var", "§A_KEY", None), ("url", "https://api.§a.io/", None)],
    "tvf20_application_yml": [("domain", "postgresql", None), ("domain", "redis", None), ("domain", "rabbitmq", None), ("url", "https://api.§a.io/v§v", None)],
    "tvf21_gemfile": [("import", "rails", None), ("import", "§a-§b", None), ("import", "pry", None), ("import", "rspec-§b", None)],
    "tvf22_database_yml": [("domain", "mysql", None), ("domain", "postgresql", None), ("domain", "redis", None)],
    "tvf23_composer": [("import", "lib", None), ("import", "§a/lib", None), ("import", "unit§b", None), ("import", "unit§b", None)],
}

# query -> (name, version, type, ecosystem) of its dependencies
DEPENDENCIES: dict[str, list[tuple[str, str, str, str]]] = {
    "tvf01_package_json": [("§a-§b", "^§v.0", "production", "npm"), ("react", "1", "production", "npm"), ("dev-§b", "~§v", "development", "npm"), ("peer-§a", "*", "peer", "npm")],
    "tvf08_requirements": [("flask-§b", "2.§v", "production", "pip"), ("§a", "*", "production", "pip")],
    "tvf09_pyproject": [("§a", "*", "production", "pip"), ("lib-§b", "*", "production", "pip")],
    "tvf10_setup_py": [("§a", "*", "production", "pip"), ("lib-§b", "*", "production", "pip")],
    "tvf11_cargo": [("§a", "1.§v", "production", "cargo"), ("tokio", "2", "production", "cargo"), ("d-§b", "3", "development", "cargo")],
    "tvf12_go_mod": [("g.com/§a", "v1.§v.0", "production", "go"), ("c.d/e§b", "v0.1.0", "production", "go")],
    "tvf14_csproj": [("§A.Lib", "§v.0", "production", "nuget"), ("T§b", "*", "production", "nuget"), ("Tool", "1", "development", "nuget")],
    "tvf17_pom": [("org.§a:lib-§b", "§v.1", "production", "maven"), ("junit:junit", "*", "development", "maven")],
    "tvf18_gradle": [("org.§a:lib-§b", "1.§v", "production", "gradle"), ("j:u§b", "*", "development", "gradle")],
    "tvf21_gemfile": [("rails", "~> §v", "production", "gem"), ("§a-§b", "*", "production", "gem"), ("pry", "*", "development", "gem"), ("rspec-§b", "*", "production", "gem")],
    "tvf23_composer": [("§a/lib", "^§v", "production", "composer"), ("unit§b", "2", "development", "composer")],
    "tvf24_pipfile": [("§a", "*", "production", "pip"), ("test-§b", "*", "development", "pip")],
    "tvf25_setup_cfg": [("§a", "*", "production", "pip"), ("lib-§b", "*", "production", "pip")],
}


def made(query: str) -> str:
    path = T.text(T.TEMPLATES[query][0])
    null, rows = "CAST(NULL AS STRING)", []
    for kind, value, line in EVIDENCE.get(query, []):
        rows.append(f"SELECT {REPO} AS repo_id, {path} AS file, 'evidence' AS part, '{kind}' AS type, {T.text(value)} AS value, CAST({'NULL' if line is None else line} AS INT) AS line, {null} AS version, {null} AS ecosystem FROM seed")
    for name, version, kind, ecosystem in DEPENDENCIES.get(query, []):
        rows.append(f"SELECT {REPO} AS repo_id, {path} AS file, 'dependency' AS part, '{kind}' AS type, {T.text(name)} AS value, CAST(NULL AS INT) AS line, {T.text(version)} AS version, '{ecosystem}' AS ecosystem FROM seed")
    return f"WITH seed AS ({SEED}) " + " UNION ALL ".join(rows)


def files(rows: list) -> str:
    return f"files AS ({A.duckdb(T.files_sql(rows, 'CAST(k AS INT)'))})"


def names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


PARTS = "string_split(path, '/')"
many = f"files AS ({A.duckdb(T.files_sql(T.MANIFESTS))})"


def entries(path: str, when: str, *rows: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {REPO} AS repo_id, {T.text(path)} AS file, {at} AS pos, {T.text(n)} AS name, {T.text(v)} AS version, '{kind}' AS type, '{eco}' AS ecosystem FROM ({SEED}) WHERE {when}" for at, (n, v, kind, eco) in enumerate(rows))


listed = "listed AS (" + " UNION ALL ".join([
    entries("d§k/package.json", "true", *DEPENDENCIES["tvf01_package_json"]), entries("d§k/requirements.txt", "k % 5 = 0", *DEPENDENCIES["tvf08_requirements"]),
    entries("d§k/sub-§b/package.json", "k % 3 = 0", ("dev-§b", "§k", "production", "npm"), ("react", "§v", "development", "npm")),
    entries("vendored/§k/package.json", "k % 2 = 0", ("react", "v§v", "production", "npm"), ("vendored-§k", "1", "production", "npm")),
]) + ")"
KINDS = " ".join(f"WHEN {i} THEN " + (f"'{kind}'" if kind else "NULL") for i, (_, kind) in enumerate(T.KIND_NAMES))
SQL: dict[str, str] = {name: made(name) for name in T.TEMPLATES if name != "tvf26_env_map"} | {
    "tvf26_env_map": f"WITH seed AS ({SEED}) SELECT {REPO} AS repo_id, {T.text('d§k/.env')} AS file, 'A' AS key, CAST(b AS STRING) AS value FROM seed UNION ALL SELECT {REPO}, {T.text('d§k/.env')}, 'B', a FROM seed",
    "src01_walk": f"""
SELECT repo_id, path FROM ({A.duckdb(T.WALK)}) w
WHERE len(list_filter({PARTS}, lambda x: x IN ({names(rules.EXCLUDED_DIRS)}) OR (x[1:1] = '.' AND x NOT IN ({names(rules.ALLOWED_DOT_NAMES)})))) = 0 AND len({PARTS}) <= {rules.MAX_DEPTH + 1}
  AND NOT (ends_with(path, '.test.ts') OR ends_with(path, '.spec.jsx'))""",
    "src02_gitignore": f"""
WITH {files(T.IGNORES)}
SELECT repo_id, path FROM files WHERE path <> '.gitignore' AND NOT CASE WHEN repo_id % 2 = 0 THEN path IN ('a.log', 'B.LOG', 'out/a.js', 'out/keep.js', 'out/deep/er/b.js', 'tmp1/x') WHEN repo_id % 4 <> 3 THEN path IN ('docs/a/b.md', 'src/a.txt') ELSE false END""",
    "src06_kinds": f"SELECT CAST(p_partkey AS INT) AS repo_id, CASE p_partkey % {len(T.KIND_NAMES)} {KINDS} END AS kind FROM part WHERE CASE p_partkey % {len(T.KIND_NAMES)} {KINDS} END IS NOT NULL",
    "src15_workspaces": f"""
WITH seed AS ({SEED})
SELECT CAST(k AS INT) AS repo_id, CASE k % 3 WHEN 0 THEN 'npm-workspaces' WHEN 1 THEN 'pnpm' ELSE 'turborepo' END AS kind, 'packages/' || a AS package FROM seed
UNION ALL SELECT CAST(k AS INT), CASE k % 3 WHEN 0 THEN 'npm-workspaces' ELSE 'pnpm' END, 'tools/cli' FROM seed WHERE k % 3 <> 2""",
    "fn05_own_names": f"""
WITH seed AS ({SEED})
SELECT CAST(k AS INT) AS repo_id, CASE WHEN k % 3 = 0 THEN a || CAST(b AS STRING) WHEN k % 3 = 2 THEN 'alias' || CAST(b AS STRING) WHEN k % 4 <> 0 THEN 'team' || a || 'webapp' END AS own_domain,
  CASE WHEN k % 2 = 0 THEN 'Stack ' || CAST(b AS STRING) WHEN k % 4 <> 0 THEN '@Team/' || upper(a[1:1]) || a[2:] || ' Web App' END AS project_name
FROM seed""",
    "fn07_ecosystems": f"""
WITH seed AS ({SEED})
SELECT {REPO} AS repo_id, string_agg(DISTINCT e, ',' ORDER BY e) AS ecosystems FROM (
  SELECT k, unnest(['node', 'python', 'go']) AS e FROM seed) GROUP BY ALL""",
    "src01_walk_order": f"""
WITH {many}, w AS (SELECT DISTINCT repo_id, path FROM files WHERE NOT starts_with(path, '.git'))
SELECT repo_id, path AS file, row_number() OVER (ORDER BY repo_id, string_split(path, '/')) - 1 AS rank FROM w""",
    "src02_inventory": f"""
WITH {many}, {listed}
SELECT repo_id, file, name, version, type FROM listed WHERE NOT (repo_id % 2 = 0 AND starts_with(file, 'vendored/'))""",
    "agg07_walk_dedup": f"""
WITH {many}, {listed}
SELECT repo_id, ecosystem, name, version, type, file FROM listed WHERE NOT (repo_id % 2 = 0 AND starts_with(file, 'vendored/'))
QUALIFY row_number() OVER (PARTITION BY repo_id, ecosystem, name ORDER BY type <> 'production', string_split(file, '/'), pos) = 1""",
}
