import random

from pyspark.sql import functions as F

from svcgraph.functions import rules
from svcgraph.operators import grouping
from svcgraph.operators.classify import classify

from .conftest import rows

EVIDENCE = "repo_id int, type string, value string, file string, line int, ord long"
RESULT = "repo_id int, service_name string, category string, confidence string, reason string, score int, evidence_type string, ord long"


def scores(spark, pairs, project=None):
    df = spark.createDataFrame([(1, t, v, "f", 1, i) for i, (t, v) in enumerate(pairs)], EVIDENCE)
    return rows(classify(df, project), "service_name", "score", "evidence_type")


def test_variables(spark):
    got = scores(spark, [("env_var", "STRIPE_SECRET_KEY"), ("env_var", "NODE_ENV"), ("env_var", "IS_E2E"), ("env_var", "ENABLE_STRIPE_URL"), ("env_var", "ZEBRA_TIMEOUT"), ("ci_secret", "ZEBRA_TIMEOUT"), ("env_var", "${X}"), ("env_var", "FOO_IDENTITY"), ("env_var", "API_KEY")])
    assert got == [("Enable Stripe", 6, "env_var"), ("Foo", 2, "env_var"), ("Stripe", 7, "env_var"), ("Zebra Timeout", 3, "ci_secret")]


def test_other_types(spark):
    got = scores(spark, [("url", "https://api.stripe.com"), ("npm_package", "@sentry/node"), ("npm_package", "fs"), ("import", "lodash/fp"), ("config_file", "action:docker/x"), ("config_file", "action:foo/x"), ("config_file", "now.json"), ("config_file", "fly.toml"), ("domain", "mailhog"), ("domain", "zebra.io"), ("domain", "cdn.segment.io"), ("what", "x"), ("url", None)])
    assert got == [("Docker Hub", 10, "config_file"), ("Fly.io", 10, "config_file"), ("Lodash", 1, "import"), ("MailHog", 5, "domain"), ("Segment", 5, "domain"), ("Sentry", 1, "npm_package"), ("Stripe", 5, "url")]


def test_project_and_phrase_penalties(spark):
    assert scores(spark, [("config_file", "docker-service:calcom-web"), ("config_file", "docker-service:a b c")], F.lit("cal.com")) == [("A B C", 7, "config_file")]
    assert scores(spark, [("ci_secret", "CAL_TOKEN"), ("ci_secret", "CALX_TOKEN")], F.lit("cal.com")) == [("Calx", 8, "ci_secret")]


def infer(spark, results):
    data = [(1, n, c, "low", f"r{i}", s, t, i) for i, (n, c, s, t) in enumerate(results)]
    services, discarded = grouping.infer_services(spark.createDataFrame(data, RESULT))
    return rows(services, "id", "name", "category", "final_score", "confidence"), rows(discarded, "name", "reason", "score")


def test_max_per_type_then_sum(spark):
    kept, lost = infer(spark, [("Stripe", "payments", 7, "env_var"), ("Stripe", "payments", 1, "npm_package"), ("Redis", "database", 1, "import"), ("Redis", "database", 6, "url"), ("Redis", "database", 10, "domain"), *[("Framer Motion", "other", 1, "import")] * 5])
    assert kept == [("redis", "Redis", "database", 17, "high"), ("stripe", "Stripe", "payments", 8, "low")]
    assert lost == [("Framer Motion", "low_score", 1)]


def test_exactly_ten_is_low_and_types_are_one(spark):
    kept, lost = infer(spark, [("Zebra", "other", 10, "config_file"), ("Quagga", "other", 4, "import"), ("Quagga", "other", 5, "npm_package")])
    assert kept == [("zebra", "Zebra", "other", 10, "low")] and lost == [("Quagga", "low_score", 5)]


def test_prefix_merge_and_brands(spark):
    kept, _ = infer(spark, [("Upstash", "database", 1, "import"), ("Upstash Ratelimit", "other", 1, "npm_package"), ("Upstash", "database", 7, "env_var"), ("Docker Hub", "infra", 10, "config_file"), ("Dockerhub", "infra", 6, "url")])
    assert kept == [("docker", "Docker Hub", "infra", 16, "high"), ("upstash", "Upstash", "database", 8, "low")]
    kept, _ = infer(spark, [("Cloudflare Sitekey", "cdn", 7, "env_var"), ("Cloudflare Use Turnstile", "cdn", 6, "url"), ("GitHub Actions", "cicd", 10, "config_file"), ("Vercel Use Botid In Booker", "hosting", 7, "env_var")])
    assert kept == [("cloudflare", "Cloudflare", "cdn", 13, "high"), ("github", "GitHub Actions", "cicd", 10, "low"), ("vercel", "Vercel", "hosting", 7, "low")]


def test_generic_entries_give_way(spark):
    kept, lost = infer(spark, [("Database", "database", 10, "env_var"), ("PostgreSQL", "database", 10, "domain"), ("Email From", "email", 8, "env_var")])
    assert [k[1] for k in kept] == ["Email From", "PostgreSQL"] and lost == [("Database", "generic_term", 10)]


def test_roots_against_a_sequential_model(spark):
    """The shortest present dash-prefix, as merging keys pair by pair gives it."""
    rng = random.Random(5)
    data, want = [], []
    for repo in range(60):
        keys = sorted({"-".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 7))})
        data += [(repo, k) for k in keys]
        want += [(repo, k, min((p for p in keys if k == p or k.startswith(p + "-")), key=len)) for k in keys]
    got = grouping.prefix_roots(spark.createDataFrame(data, "repo_id int, key string"))
    assert rows(got, "repo_id", "key", "root") == sorted(want, key=repr)


def test_dependencies_prefer_production(spark):
    deps = spark.createDataFrame([(1, "npm", "a", "1", "development", 1), (1, "npm", "a", "2", "production", 2), (1, "npm", "b", "1", "peer", 3), (1, "npm", "b", "2", "development", 4)], "repo_id int, ecosystem string, name string, version string, type string, ord long")
    assert rows(grouping.unique_dependencies(deps), "name", "version", "type", "ord") == [("a", "2", "production", 1), ("b", "1", "peer", 3)]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], EVIDENCE)
    services, discarded = grouping.infer_services(classify(empty))
    assert services.count() == 0 and discarded.count() == 0
    assert len(rules.GENERIC_NAMES) == len(set(rules.GENERIC_NAMES))
