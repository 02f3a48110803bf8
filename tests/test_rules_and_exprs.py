from datetime import date

import pytest
from pyspark.sql import functions as F

from svcgraph.functions import exprs as E


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lit(*values):
    return [F.lit(v) for v in values]


def test_hosts_and_ignored_domains(spark):
    assert one(spark, *[E.host_of(F.lit(u)) for u in ("https://API.Stripe.com/v1", "http://localhost/x", "http://10.0.0.1/", "nonsense")]) == ("api.stripe.com", None, None, None)
    assert one(spark, E.is_ignored_exact(F.lit("x.fbcdn.net")), E.is_ignored_suffix(F.lit("x.fbcdn.net")), E.is_ignored_suffix(F.lit("api.github.com"))) == (False, True, False)
    assert one(spark, E.apex(F.lit("https://www.shop.io/a")), E.apex(F.lit("Shop.io")), E.is_own_domain(F.lit("api.x.com"), F.lit("API"))) == ("shop", "shop", True)


def test_names(spark):
    assert one(spark, E.title_case(F.lit("my_db-main x")), E.service_key(F.lit(" Docker Hub! ")), E.format_project_name(F.lit("simple-test-app")), E.format_project_name(F.lit("test"))) == ("My Db Main X", "docker-hub", "SimpleApp", "App")


@pytest.mark.parametrize("name, category", [("cdn", "cicd"), ("Stripe", "payments"), ("sentry", "monitoring"), ("zebra", "other"), ("google-analytics", "analytics")])
def test_categories_are_ordered_and_unanchored(spark, name, category):
    assert one(spark, E.category_of(F.lit(name))) == (category,)


def test_months_overflow_and_billing(spark):
    nxt = lambda k, p, d, n=None: E.next_billing_date(F.lit(k), F.lit(p), F.lit(d).cast("date"), F.lit(n).cast("date"))
    got = one(spark, nxt("manual", "monthly", "2026-01-31"), nxt("manual", "yearly", "2024-02-29"), nxt("free", "monthly", "2026-01-31"), nxt("manual", "one-time", "2026-01-31"), nxt("manual", "monthly", None, "2026-05-01"))
    assert got == (date(2026, 3, 3), date(2025, 3, 1), None, None, date(2026, 5, 1))
    assert one(spark, *[E.renewal_threshold(F.lit(k), F.lit(p)) for k, p in (("automatic", "yearly"), ("manual", "monthly"), ("manual", "yearly"), ("automatic", "monthly"))]) == (60, 7, 30, None)
    assert one(spark, E.monthly_amount(F.lit("yearly"), F.lit(120.0)), E.monthly_amount(F.lit("one-time"), F.lit(5.0)), E.monthly_amount_reported(F.lit("one-time"), F.lit(5.0))) == (10.0, 0.0, 5.0)


def test_severity_first_positive_score_then_label(spark):
    def of(*scores):
        return E.severity(F.from_json(F.lit("[" + ",".join(f'{{"score":{a},"severity":{b}}}' for a, b in scores) + "]"), "array<struct<score:double,severity:string>>"))

    assert one(spark, of((0, "null"), (7.5, "null"), (9.9, "null")), of(("null", '"MODERATE"')), of(), of((3.9, "null"))) == ("high", "medium", "unknown", "low")


def test_package_urls_and_ids(spark):
    assert one(spark, E.purl(*lit("npm", "@a/b", "1")), E.purl(*lit("gradle", "g:a", "*")), E.purl(*lit("nuget", "x", "2"))) == ("pkg:npm/%40a/b@1", "pkg:maven/g:a", "pkg:nuget/x@2")
    assert one(spark, E.strip_version_prefix(F.lit(">=1.2")), E.spdx_id(F.lit("@a/b_c")), E.html_escape(F.lit("<a&'\">"))) == ("=1.2", "-a-b-c", "&lt;a&amp;&#39;&quot;&gt;")


def test_activity_badges_and_checks(spark):
    assert one(spark, *[E.activity_status(F.lit(n).cast("int")) for n in (None, 89, 90, 180)]) == ("active", "active", "stale", "zombie")
    assert one(spark, *[E.renewal_badge(F.lit(n)) for n in (-1, 6, 29, 30)]) == ("OVERDUE", "URGENT", "SOON", None)
    assert one(spark, E.valid_slug(F.lit("a/b")), E.valid_slug(F.lit("a/b\n")), E.has_traversal(F.lit("a/../b")), E.safe_base_url(F.lit("http://169.254.1.1/")), E.safe_base_url(F.lit("https://x.io"))) == (True, False, True, False, True)
    assert one(spark, E.redact_token(*lit("bad abcdefgh!", "abcdefgh")), E.sanitize_prompt(F.lit("a\x00b \t")), E.should_review(*lit("low", "email"), F.lit(0))) == ("bad abcd****!", "ab", False)


def test_trim_is_unicode_and_crlf_safe(spark):
    assert one(spark, E.trim(F.lit(" x\r"))) == ("x",)
