"""Repository files made from the driver's part table: one small file of a kind for each part, as SQL that Spark and DuckDB run alike.

Test inputs, no part of the engine. In a template §a is the part's brand as a word, §A the same in capitals, §b a number
below 97, §v the part's size and §k its key. The SQL of a template spells out every sign that either engine would read otherwise.
"""

from __future__ import annotations

import re

COLUMNS = {"a": "a", "A": "upper(a)", "b": "CAST(b AS STRING)", "v": "CAST(v AS STRING)", "k": "CAST(k AS STRING)"}
SEED = "SELECT p_partkey AS k, replace(lower(p_brand), '#', '') AS a, p_partkey % 97 AS b, p_size AS v FROM {part}"


def text(template: str) -> str:
    """The template as an SQL string expression over SEED's columns."""
    parts = []
    for piece in re.findall(r"§[aAbvk]|[A-Za-z0-9 _.,:;/@<>=()\[\]~^*!#|+-]+|.", template, re.DOTALL):
        parts.append(COLUMNS[piece[1]] if piece[0] == "§" else f"chr({ord(piece)})" if not re.match(r"[A-Za-z0-9 _.,:;/@<>=()\[\]~^*!#|+-]", piece) else f"'{piece}'")
    return " || ".join(parts) if parts else "''"


#: query -> (path, content) of the file that it parses
TEMPLATES = {
    "tvf01_package_json": ("d§k/package.json", '{"name":"§a","dependencies":{"§a-§b":"^§v.0","react":"1"},"devDependencies":{"dev-§b":"~§v"},"peerDependencies":{"peer-§a":"*"}}'),
    "tvf02_env": ("d§k/.env", "# X=1\n§A_KEY=abc\nAPI_URL=https://api.§a.io/v§v\nSITE=https://github.com/x\n=bad\nMAIN_DATABASE_URL=postgres://h/§b\n"),
    "tvf03_compose": ("d§k/docker-compose.yml", "services:\n  §a:\n    image: '§a:§v'\n  db§b:\n    image: postgres:15\n\nvolumes:\n  x:\n"),
    "tvf04_workflow": ("d§k/.github/workflows/ci.yml", "jobs:\n  uses: acme/§a@v§v\n  uses: local\n  env: ${{ secrets.§A_TOKEN }}\n  run: echo $DEPLOY_KEY_ID\n"),
    "tvf05_config_names": ("d§k/vercel.json", "{}"),
    "tvf06_source": ("d§k/src/f.ts", 'import x from "@§a/sdk"\nfetch("https://api.§a.io/v§v")\nconst k = process.env.APP_SECRET\nrequire("./own"); require("lodash-§b")\nfetch("https://github.com/x")\n'),
    "tvf07_content_lines": ("d§k/src/g.tsx", '<a href="https://docs.§a.io/">\n// fetch("https://b§b.io/")\naxios.get("https://c§b.io/")\n * fetch("https://d§b.io/")\n'),
    "tvf08_requirements": ("d§k/requirements.txt", "flask-§b==2.§v\n# no\n-r other\n§a[x]>=1\n"),
    "tvf09_pyproject": ("d§k/pyproject.toml", '[project]\nname = "n"\ndependencies = ["§a>=1", "lib-§b"]\n'),
    "tvf10_setup_py": ("d§k/setup.py", "setup(install_requires=['§a==1', \"lib-§b\"])\n"),
    "tvf11_cargo": ("d§k/Cargo.toml", '[dependencies]\n§a = "1.§v"\ntokio = { version = "2" }\n[dev-dependencies]\nd-§b = "3"\n'),
    "tvf12_go_mod": ("d§k/go.mod", "module m\nrequire (\n\tg.com/§a v1.§v.0\n)\nrequire c.d/e§b v0.1.0\n"),
    "tvf13_terraform": ("d§k/main.tf", 'provider "§a" {}\nprovider "random" {}\nresource "google_x" "y" {}\nq§b = { source = "hashi/q" }\n'),
    "tvf14_csproj": ("d§k/x.csproj", '<PackageReference Include="§A.Lib" Version="§v.0" /><PackageReference Include="T§b"/><DotNetCliToolReference Include="Tool" Version="1"/>'),
    "tvf15_appsettings": ("d§k/appsettings.json", '{"ConnectionStrings":{"Main":"Server=§a"},"Stripe":{"ApiKey":"abcdef§b"},"Base":[{"Url":"https://api.§a.io/"}]}'),
    "tvf16_web_config": ("d§k/web.config", '<add name="d" connectionString="Data Source=§a" /><add key="§A_KEY" value="x" /><add key="Site" value="https://api.§a.io/" /><add key="plain" value="y" />'),
    "tvf17_pom": ("d§k/pom.xml", "<dependency><groupId>org.§a</groupId><artifactId>lib-§b</artifactId><version>§v.1</version></dependency><dependency><groupId>junit</groupId><artifactId>junit</artifactId><scope>test</scope></dependency>"),
    "tvf18_gradle": ("d§k/build.gradle", "implementation 'org.§a:lib-§b:1.§v'\ntestImplementation 'j:u§b'\nfoo 'x:y:z'\n"),
    "tvf19_properties": ("d§k/application.properties", "spring.datasource.url=jdbc:mysql://h/§a\nspring.redis.host=r§b\n§a.api-key=1\nx.url=https://api.§a.io/\n"),
    "tvf20_application_yml": ("d§k/application.yml", "spring:\n  datasource:\n    url: jdbc:postgresql://h/§a\n  redis:\n    host: r\n  rabbitmq:\n  endpoint: https://api.§a.io/v§v\n"),
    "tvf21_gemfile": ("d§k/Gemfile", "gem 'rails', '~> §v'\ngem '§a-§b'\ngem 'pry', group: :development\ngroup :test do\n  gem 'rspec-§b'\nend\n"),
    "tvf22_database_yml": ("d§k/config/database.yml", "default:\n  adapter: mysql2\n  url: 'postgres://h/§a'\n  cache: redis://r§b\n"),
    "tvf23_composer": ("d§k/composer.json", '{"require":{"php":"8","ext-x":"1","§a/lib":"^§v"},"require-dev":{"unit§b":"2"}}'),
    "tvf24_pipfile": ("d§k/Pipfile", '[packages]\n§a = "*"\n# c = 1\n[dev-packages]\ntest-§b = "*"\n[requires]\npy = "3"\n'),
    "tvf25_setup_cfg": ("d§k/setup.cfg", "[options]\ninstall_requires =\n  §a>=5\n  lib-§b\n[x]\ny = 1\n"),
    "tvf26_env_map": ("d§k/.env", "A=1\nB='§a'\n# C=2\nA=\"§b\"\n"),
}


def files_sql(rows: list[tuple[str, str, str]], repo: str = "CAST(k % 20 AS INT)") -> str:
    """repo_id, path, content, size of (path, content, condition) templates for every part."""
    one = lambda path, content, when: f"SELECT {repo} AS repo_id, {text(path)} AS path, {text(content)} AS content FROM seed WHERE {when}"
    return f"WITH seed AS ({SEED}) SELECT repo_id, path, content, CAST(length(content) AS BIGINT) AS size FROM (" + " UNION ALL ".join(one(*r) for r in rows) + ") f"


#: The walk's input: every folder and ending together, over all parts.
WALK = """
SELECT repo_id, path, CAST('x' AS STRING) AS content, CAST(1 AS BIGINT) AS size FROM (
  SELECT CAST(p_partkey % 20 AS INT) AS repo_id, CASE p_partkey % 8 WHEN 0 THEN 'src' WHEN 1 THEN 'node_modules/m' WHEN 2 THEN '.git' WHEN 3 THEN '.github/workflows'
    WHEN 4 THEN 'a/dist/b' WHEN 5 THEN 'lib/__tests__' WHEN 6 THEN 'a/b/c/d/e/f/g/h/i/j/k/l/m/n/o' ELSE 'a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p' END || '/'
    || CASE p_partkey % 3 WHEN 0 THEN '.hidden' WHEN 1 THEN 'f' ELSE 'g' END || CAST(p_partkey AS STRING)
    || CASE p_size % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.py' WHEN 3 THEN '.spec.jsx' ELSE '.md' END AS path
  FROM {part}
) w
"""

#: Every name that the dispatch knows, and some that it doesn't, by part.
KIND_NAMES = [
    ("package.json", "package_json"), (".env.local", "env"), ("docker-compose.yaml", "compose"), (".github/workflows/x.yml", "workflow"), (".gitlab-ci.yml", "workflow"), ("netlify.toml", "config_name"),
    ("requirements.txt", "requirements"), ("pyproject.toml", "pyproject"), ("setup.py", "setup_py"), ("Cargo.toml", "cargo"), ("go.mod", "go_mod"), ("q.csproj", "csproj"), ("appsettings.Dev.json", "appsettings"),
    ("web.config", "web_config"), ("pom.xml", "pom"), ("build.gradle.kts", "gradle"), ("application-dev.properties", "properties"), ("application.yaml", "application_yml"), ("Gemfile", "gemfile"),
    ("config/database.yml", "database_yml"), ("composer.json", "composer"), ("Pipfile", "pipfile"), ("setup.cfg", "setup_cfg"), ("m.tf", "terraform"), ("x.kt", "source"), ("x.md", None), ("database.yml", None), (".env.d/x.yml", None),
]

#: Files at a repository's root that tell its names; a repository for each part.
NAMES = [
    (".env", "OTHER=1\nNEXT_PUBLIC_URL=https://www.§a§b.io/x\n", "k % 3 = 0"), ("vercel.json", '{"alias":["https://alias§b.dev"]}', "k % 3 <> 1"),
    ("package.json", '{"name":"@team/§a-web_app"}', "k % 4 <> 0"), ("stack.config.json", '{"project":{"name":"Stack §b"}}', "k % 2 = 0"), ("src/.env", "NEXT_PUBLIC_URL=https://no.io", "k % 5 = 0"),
]

#: A workspace for each part, of three kinds.
WORKSPACES = [
    ("package.json", '{"workspaces":["packages/*","tools/cli"]}', "k % 3 = 0"), ("pnpm-workspace.yaml", "packages:\n  - 'packages/*' # all\n  - tools/cli\n", "k % 3 = 1"), ("turbo.json", "{}", "k % 3 <> 0"),
    ("packages/§a/package.json", '{"dependencies":{"p§b":"1"}}', "true"), ("packages/.x/package.json", "{}", "true"), ("tools/cli/Cargo.toml", "", "true"), ("apps/z/readme.md", "", "true"), ("other/z/package.json", "{}", "k % 2 = 0"),
]

#: Each repository has its own ignore file: the even ones keep one of the logs.
IGNORES = [
    (".gitignore", "# made\n*.log\n!keep.log\n/out/\n!out/keep.js\n!/out/deep/\ntmp?/x\n", "k % 2 = 0"), (".gitignore", "docs/**\n[ab].txt\n", "k % 2 = 1 AND k % 4 <> 3"),
    ("a.log", "", "true"), ("src/keep.log", "", "true"), ("out/a.js", "", "true"), ("out/keep.js", "", "true"), ("out/deep/er/b.js", "", "true"), ("B.LOG", "", "true"), ("src/out/a.js", "", "true"), ("tmp1/x", "", "true"), ("docs/a/b.md", "", "true"), ("src/a.txt", "", "true"), ("src/c.txt", "", "true"),
]

#: Manifests of several folders in each repository; the even ones leave a folder out.
MANIFESTS = [
    (".gitignore", "vendored/\n!vendored/package.json\n", "k < 20 AND k % 2 = 0"), ("d§k/package.json", TEMPLATES["tvf01_package_json"][1], "true"), ("d§k/sub-§b/package.json", '{"devDependencies":{"react":"§v"},"dependencies":{"dev-§b":"§k"}}', "k % 3 = 0"),
    ("vendored/§k/package.json", '{"dependencies":{"react":"v§v","vendored-§k":"1"}}', "k % 2 = 0"), ("d§k/requirements.txt", TEMPLATES["tvf08_requirements"][1], "k % 5 = 0"),
]
