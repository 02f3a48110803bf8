import pytest
from pyspark.sql import functions as F

from svcgraph.operators import grouping, parsers
from svcgraph.operators.ordering import walk_ranks
from svcgraph.plans.inventory import inventory_of_files
from svcgraph.sources import repo

from .conftest import rows

FILES = "repo_id string, path string, content string, size long"


def table(spark, files, repo_id="r"):
    return spark.createDataFrame([(repo_id, p, c, len(c)) for p, c in files.items()], FILES)


def evidence(spark, path, content, project=None):
    return rows(parsers.evidence_of(repo.walked(table(spark, {path: content})), project), "type", "value")


def deps(spark, path, content):
    return rows(parsers.dependencies_of(repo.walked(table(spark, {path: content}))), "name", "version", "type")


def test_dotenv(spark):
    got = evidence(spark, ".env", "STRIPE_KEY=a\r\n# X=1\nAPI_URL=https://api.stripe.com/v1\nSHOP=https://www.shop.io\nDATABASE_URL=postgres://u@h/d\n=bad", F.lit("shop"))
    assert got == [("domain", "postgresql"), ("env_var", "API_URL"), ("env_var", "DATABASE_URL"), ("env_var", "SHOP"), ("env_var", "STRIPE_KEY"), ("url", "https://api.stripe.com/v1")]


def test_compose_block_stops_at_a_blank_line(spark):
    got = evidence(spark, "docker-compose.yml", "services:\n  db:\n    image: postgres:15\n\n  late:\n    image: 'redis'\n")
    assert got == [("config_file", "docker-service:db"), ("domain", "postgres"), ("domain", "redis")]


def test_source_lines(spark):
    code = 'import a from "@sentry/node"\nfetch("https://api.github.com/x")\n<a href="https://real.io/">\n// fetch("https://b.io/")\naxios.get("https://fonts.gstatic.com/x")\nconst k = process.env.STRIPE_KEY\nrequire("./own"); require("lodash")'
    assert evidence(spark, "src/a.ts", code) == [("domain", "api.github.com"), ("env_var", "STRIPE_KEY"), ("import", "@sentry/node"), ("import", "lodash"), ("url", "https://api.github.com/x")]


@pytest.mark.parametrize("path, content, want", [
    ("package.json", '{"dependencies":{"a":"1"},"devDependencies":{"b":"2"},"peerDependencies":{"c":"3"}}', [("a", "1", "production"), ("b", "2", "development"), ("c", "3", "peer")]),
    ("package.json", "{bad", []),
    ("requirements.txt", "flask==2.0\n# x\n-r y\nq[z]==1\n", [("flask", "2.0", "production"), ("q", "*", "production")]),
    ("pyproject.toml", '[project]\ndependencies = ["a>=1", "b"]', [("a", "*", "production"), ("b", "*", "production")]),
    ("setup.py", "install_requires=['a[x]', 'b']", []),
    ("Cargo.toml", '[dependencies]\nserde = "1"\ntokio = { version = "2" }\n[dev-dependencies]\nx = "3"\n', [("serde", "1", "production"), ("tokio", "2", "production"), ("x", "3", "development")]),
    ("go.mod", "require (\n g.com/a v1.2.3\n)\nrequire c.d/e v0.1.0", [("c.d/e", "v0.1.0", "production"), ("g.com/a", "v1.2.3", "production")]),
    ("a.csproj", '<PackageReference Include="S" Version="4"/><PackageReference Include="T"/>', [("S", "4", "production"), ("T", "*", "production")]),
    ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><scope>test</scope></dependency>", [("g:a", "*", "development")]),
    ("build.gradle", "implementation 'g:a:1'\nimplementation(\"x:y:2\")\n", [("g:a", "1", "production")]),
    ("Gemfile", "gem 'rails', '~> 7'\ngem 'pry', group: :development\n", [("pry", "*", "development"), ("rails", "~> 7", "production")]),
    ("composer.json", '{"require":{"php":"8","ext-x":"1","a/b":"1"},"require-dev":{"c":"2"}}', [("a/b", "1", "production"), ("c", "2", "development")]),
    ("Pipfile", '[packages]\nflask = "*"\n[dev-packages]\npytest = "*"\n[x]\nq = 1', [("flask", "*", "production"), ("pytest", "*", "development")]),
    ("setup.cfg", "[options]\ninstall_requires =\n  stripe>=5\n  redis\n[x]\ny = 1", [("redis", "*", "production"), ("stripe", "*", "production")]),
])
def test_dependencies(spark, path, content, want):
    assert deps(spark, path, content) == want


def test_an_address_is_looked_for_once_a_line(spark):
    rows_ = parsers.evidence_of(repo.walked(table(spark, {"a.ts": ""})), only=["source"])
    plan = rows_._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("baseURL") <= 4  # it grew with every use of the address and of its host


def test_own_names_read_the_variables_once(spark):
    files = {".env": "A=1\nNEXT_PUBLIC_URL=\nAPP_URL=https://www.First.io\nSITE_URL='https://x.io'\nSITE_URL=\"https://shop.dev/a\"\n", ".env.local": "PUBLIC_URL=https://second.io", "package.json": '{"name":"a-b"}', "stack.config.json": '{"project":{"name":""}}'}
    named = parsers.project_names(table(spark, files))
    assert rows(named) == [("r", "first", "A B")]  # APP_URL comes before SITE_URL in the order of variables
    assert rows(parsers.project_names(table(spark, {k: v for k, v in files.items() if k != ".env"}))) == [("r", "second", "A B")]
    assert rows(parsers.project_names(table(spark, {".env": files[".env"].replace("APP_URL", "B")}))) == [("r", "shop", None)]
    assert rows(table(spark, files).where("path = '.env'").select(parsers.env_map(F.col("content"))["SITE_URL"])) == [("https://shop.dev/a",)]
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("regexp_extract") <= 12  # the dotenv text stood in the plan for every variable and every use of its value


def test_settings_walk(spark):
    got = evidence(spark, "appsettings.Dev.json", '{"ConnectionStrings":{"Default":"Server=x"},"Stripe":{"ApiKey":"abcdefgh","List":[{"Url":"https://x.io/a"}]}}')
    assert got == [("domain", "sqlserver"), ("env_var", "STRIPE_APIKEY"), ("env_var", "STRIPE_APIKEY"), ("url", "https://x.io/a")]
    assert evidence(spark, "appsettings.json", "{bad") == []


def test_settings_of_any_number_and_depth(spark):
    deep = '{"a":[' * 120 + '{"Url":"https://x.io/a","U":""}' + "]}" * 120
    assert evidence(spark, "appsettings.json", deep) == [("url", "https://x.io/a")]
    assert rows(parsers.settings_leaves(table(spark, {"f": '[{"":{"k":"1","n":[2,null,"lost"]}},"lost"]'}).select("repo_id", F.col("path").alias("file"), F.lit(0).alias("ord0"), "content")), "prefix", "key", "value") == [("", "k", "1")]
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        many = spark.range(50).select("id", F.lit("appsettings.json").alias("path"), F.lit('{"S":{"ApiKey":"abcdefgh"}}').alias("content"), F.lit(1).cast("long").alias("size")).withColumnRenamed("id", "repo_id")
        assert parsers.evidence_of(repo.walked(many)).count() == 100
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_other_evidence(spark):
    assert evidence(spark, "application.properties", "spring.datasource.url=jdbc:postgresql://x\nstripe.api-key=1") == [("domain", "postgresql"), ("env_var", "STRIPE_KEY")]
    assert evidence(spark, "main.tf", 'provider "aws" {}\nprovider "random" {}\nresource "google_x" "y" {}') == [("config_file", "terraform:aws"), ("config_file", "terraform:google")]
    assert evidence(spark, ".github/workflows/a.yml", "x: ${{ secrets.NPM_TOKEN }}\nuses: a/b@v1") == [("ci_secret", "NPM_TOKEN"), ("config_file", "action:a/b"), ("config_file", "github-actions")]
    assert evidence(spark, "vercel.json", "{}") == [("config_file", "vercel.json")]


def test_walk_and_ignore(spark):
    files = {"a.ts": "", "node_modules/x/b.ts": "", "src/c.test.ts": "", ".hidden/d.ts": "", ".env": "", "out/e.ts": "", "keep/out.ts": "", ".gitignore": "out/\n*.log\n!important.log\n# c\n"}
    assert rows(repo.walked(repo.without_ignored(table(spark, files))), "path") == [(".env",), ("a.ts",), ("keep/out.ts",)]


@pytest.mark.parametrize(
    ("content", "ignored", "kept"),
    [
        ("out/\n!out/keep.js", ["out/keep.js", "out/a/b.js"], ["keep.js", "src/outer/x"]),  # nothing below an ignored folder comes back
        ("*.log\n!keep.log", ["a.log", "d/B.LOG"], ["keep.log", "d/keep.log", "log"]),
        ("/dist\nbuild/*\n!build/ok", ["dist/x", "build/no/y"], ["src/dist/x", "build/ok/z"]),
        ("docs/**\n**/tmp?\n[ab].txt", ["docs/a/b.md", "x/y/tmp1/f", "a.txt", "q/b.txt"], ["docs.md", "tmp", "c.txt"]),
        ("name/", ["name/f", "x/name/f"], ["name", "x/name"]),  # a file is no folder
        ("\\#x\n\\!y\n# z\n  \n[", ["#x", "!y", "["], ["z"]),
        ("*\n!*/\n!*.ts", ["a.md", "d/e/b.md"], ["a.ts", "d/e/b.ts"]),
    ],
)
def test_ignore_tree(spark, content, ignored, kept):
    tree = repo.IgnoreTree(content)
    assert [p for p in ignored + kept if tree.ignored(p)] == ignored
    files = table(spark, {".gitignore": content} | {p: "" for p in ignored + kept}).union(table(spark, {p: "" for p in ignored}, "other"))
    for share in (200_000, 2):
        got = repo.ignored_paths(files, share)
        assert rows(got.where("path <> '.gitignore'"), "repo_id", "path") == sorted(("r", p) for p in ignored)
    assert repo.without_ignored(files.limit(0)).count() == 0


def test_order_follows_the_walk(spark):
    files = table(spark, {"b/package.json": '{"dependencies":{"x":"2","y":"1"}}', "a.d/package.json": '{"dependencies":{"x":"3"}}', "a/package.json": '{"dependencies":{"x":"1"}}', "a/z/package.json": '{"dependencies":{"y":"9"}}'})
    got = parsers.extract_dependencies(repo.walked(files.repartition(3)))
    assert [(r.file, r.name) for r in got.orderBy("ord").collect()] == [("a/package.json", "x"), ("a/z/package.json", "y"), ("a.d/package.json", "x"), ("b/package.json", "x"), ("b/package.json", "y")]
    assert rows(grouping.unique_dependencies(got), "name", "version") == [("x", "1"), ("y", "9")]
    many = spark.range(20_000).select((F.col("id") % 3).alias("repo_id"), F.concat(F.lit("p"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(15_000)).cast("string"), 6, "0")).alias("path"))
    ranked = walk_ranks(many.repartition(8)).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(len(ranked))) and [(r.repo_id, r.file) for r in ranked] == sorted({(r.repo_id, r.path) for r in many.collect()})


def test_workspaces(spark):
    files = {"package.json": '{"workspaces":["packages/*"]}', "packages/a/package.json": "{}", "packages/b/readme": "", "lerna.json": "{}", "apps/c/package.json": "{}"}
    assert rows(repo.workspace_packages(table(spark, files))) == [("r", "npm-workspaces", "packages/a")]
    pnpm = {"pnpm-workspace.yaml": "packages:\n  - 'apps/*'\n", "apps/c/go.mod": ""}
    assert rows(repo.workspace_packages(table(spark, pnpm))) == [("r", "pnpm", "apps/c")]


def test_whole_inventory_of_files(spark):
    files = {"package.json": '{"name":"shop","dependencies":{"stripe":"^1","react":"18"}}', ".env.example": "STRIPE_SECRET_KEY=x\nNODE_ENV=y\nSENTRY_DSN=z"}
    out = inventory_of_files(table(spark, files))
    assert rows(out["services"], "id", "category", "final_score") == [("sentry", "monitoring", 7), ("stripe", "payments", 8)]
    assert rows(out["ecosystems"], "repo_id", "ecosystems") == [("r", ["node"])]
    ignored = inventory_of_files(table(spark, files | {".gitignore": ".env*\nlib/\n!lib/package.json", "lib/package.json": '{"dependencies":{"redis":"1"}}'}))
    assert rows(ignored["evidences"], "file", "value") == [("package.json", "react"), ("package.json", "stripe")] and rows(ignored["dependencies"], "name") == [("react",), ("stripe",)]
    empty = inventory_of_files(table(spark, {"x": ""}).limit(0))
    assert empty["services"].count() == 0


def test_ignore_files_of_one_text_are_compiled_once():
    a, b = repo.IgnoreTree("*.log\n!keep.log\n"), repo.IgnoreTree("*.log\n!keep.log\n")
    assert a.rules is b.rules and a.folders is not b.folders
    assert [a.ignored(p) for p in ("x/a.log", "keep.log", "x")] == [True, False, False]
