import json
import random
import time
from datetime import date, datetime

from pyspark.sql import functions as F

from svcgraph.operators import facts, graph, health, history, reports
from svcgraph.operators.containment import containing

from .conftest import rows

SERVICE = "repo_id int, id string, name string, category string, plan string, confidence string, needs_review boolean, owner string, url string, status string, source string, billing_type string, period string, amount double, next_date date, last_renewed date"
BLANK = dict.fromkeys([f.split()[0] for f in SERVICE.split(", ")])


def service(**fields):
    return {**BLANK, "repo_id": 1, "plan": "unknown", "category": "other", "source": "inferred", **fields}


def services(spark, *made):
    return spark.createDataFrame([tuple(m[f.split()[0]] for f in SERVICE.split(", ")) for m in made], SERVICE)


def test_graph_routes_layers_and_edges(spark):
    s = services(spark, service(id="v", name="V", category="hosting"), service(id="p", name="P", category="database"), service(id="s3", name="S", category="storage"), service(id="st", name="St", category="payments"), service(id="a", name="A", category="auth"), service(id="o", name="O", url="https://o"), service(repo_id=2, id="x", name="X"))
    repos = s.select("repo_id").union(spark.createDataFrame([(3,)], "repo_id int")).distinct()
    assert rows(graph.edges(s), "repo_id", "source", "target", "flow_type") == sorted([
        (1, "user", "frontend", "data"), (1, "user", "api", "data"), (1, "frontend", "api", "data"), (1, "api", "layer-data", "data"), (1, "layer-data", "svc-p", "data"),
        (1, "layer-data", "svc-s3", "data"), (1, "api", "svc-st", "payment"), (1, "frontend", "svc-a", "auth"), (1, "frontend", "svc-v", "data"), (1, "api", "svc-o", "data"), (2, "user", "svc-x", "data"),
    ], key=repr)
    nodes = graph.nodes(repos, s)
    assert rows(nodes.where("repo_id = 3"), "id") == [("user",)] and nodes.where("id = 'svc-p' AND type = 'database'").count() == 1
    left, links = graph.without(nodes, graph.edges(s), spark.createDataFrame([(1, "api")], "repo_id int, id string"))
    assert left.where("id = 'api'").count() == 0 and links.where("source = 'api' OR target = 'api'").count() == 0
    typed = graph.retyped(graph.edges(s), spark.createDataFrame([(1, "p", "auth")], "repo_id int, service_id string, flow_type string"))
    assert rows(typed.where("target = 'svc-p'"), "flow_type") == [("auth",)]
    made, new = graph.missing_nodes(s, nodes.where("id <> 'svc-p'"))
    assert rows(made, "id") == [("svc-p",)] and rows(new, "source", "target") == [("user", "svc-p")]
    assert graph.labelled(graph.edges(s), nodes).where("source_label = 'Backend' AND target_label = 'St'").count() == 1
    saved = spark.createDataFrame([(1, "user", None, "User", "layer", 1.0, 2.0), (1, "note", None, "Note", "layer", 3.0, 4.0)], "repo_id int, id string, service_id string, label string, type string, x double, y double")
    ends = spark.createDataFrame([(1, "note", "user", "data"), (1, "note", "gone", "data")], "repo_id int, source string, target string, flow_type string")
    all_nodes, all_edges = graph.with_saved(nodes, graph.edges(s), saved, ends)
    assert rows(all_nodes.where("x IS NOT NULL"), "id") == [("note",)] and all_edges.where("source = 'note'").count() == 1  # not all are saved: the rest is laid out anew


def test_activity(spark):
    s = services(spark, service(id="stripe", name="Stripe"), service(id="zz", name="Zz"), service(repo_id=2, id="big", name="Big"))
    ev = spark.createDataFrame([(1, "STRIPE_KEY", "a.ts"), (1, "x", "src/stripe.ts"), *[(2, "big", f"{i}.ts") for i in range(51)]], "repo_id int, value string, file string")
    commits = spark.createDataFrame([(1, "a.ts", datetime(2024, 1, 1)), (1, "src/stripe.ts", datetime(2024, 3, 1)), (2, "elsewhere", datetime(2024, 6, 29))], "repo_id int, file string, ts timestamp")
    got = rows(facts.last_activity(s, ev, commits, F.lit("2024-06-30")), "id", "days", "status")
    assert got == [("big", 1, "active"), ("stripe", 121, "stale"), ("zz", None, "active")]


def test_health(spark):
    s = services(
        spark, service(id="a", plan="paid", owner="me", billing_type="manual", period="monthly", amount=5.0, last_renewed=date(2026, 2, 15)),
        service(id="b", plan="trial", owner=" ", status="zombie"), service(id="c", plan="free", billing_type="free"),
    )
    got = {r.check_id: (r.status, r.affected) for r in health.health_checks(s, F.lit("2026-03-18")).collect()}
    assert got == {"NO_CRITICAL_VULNS": ("unchecked", None), "NO_HIGH_VULNS": ("unchecked", None), "NO_ZOMBIE_SERVICES": ("fail", 1), "NO_OVERDUE_RENEWALS": ("fail", 1), "NO_UPCOMING_RENEWALS": ("pass", 0), "ALL_PAID_HAVE_OWNER": ("fail", 1), "ALL_PAID_HAVE_BILLING": ("fail", 1), "ALL_PAID_HAVE_RENEWAL": ("fail", 1)}
    vulns = spark.createDataFrame([(1, 0, 2)], "repo_id int, critical long, high long")
    checks = health.health_checks(s, F.lit("2026-03-18"), vulns)
    assert rows(health.health_score(checks), "score", "total_checks", "passing_checks") == [(25, 8, 2)]
    none = health.health_score(health.health_checks(services(spark, service(id="x")), F.lit("2026-03-18")))
    assert rows(none, "score", "total_checks") == [(0, 0)]


def test_costs_budget_and_renewals(spark):
    s = services(spark, service(id="a", name="A", category="email", billing_type="manual", period="yearly", amount=120.0, next_date=date(2026, 3, 20)), service(id="b", name="B", category="email", billing_type="automatic", period="monthly", amount=5.0, next_date=date(2026, 3, 18)), service(id="c", name="C", billing_type="manual", period="one-time", amount=9.0))
    assert rows(health.cost_by_category(s), "category", "total", "n") == [("email", 15.0, 2), ("other", 0.0, 1)]
    assert rows(health.totals(s), "total_monthly", "total_yearly", "paid") == [(15.0, 180.0, 3)]
    budget = spark.createDataFrame([(1, 10.0, None), (2, 5.0, 50)], "repo_id int, monthly double, threshold int")
    assert rows(health.budget_status(s, budget), "repo_id", "percent", "remaining", "colour") == [(1, 150.0, -5.0, "red"), (2, 0.0, 5.0, "green")]
    assert rows(health.renewals(s, F.lit("2026-03-18")), "id", "days", "badge") == [("a", 2, "URGENT"), ("b", 0, "URGENT")]
    assert rows(health.notifications(s, F.lit("2026-03-18")), "message") == [("A renews in 2 days",)]
    again = health.renewed(s.where("id = 'b'"), F.lit("2026-01-31"))
    assert rows(again, "next_date") == [(date(2026, 3, 3),)]


def test_vulnerabilities_and_gate(spark):
    deps = spark.createDataFrame([(1, "gradle", "g:a", "^1.0", "production", 1), (1, "maven", "g:a", "1.0", "production", 2), (1, "what", "q", "1", "production", 3)], "repo_id int, ecosystem string, name string, version string, type string, ord long")
    advisories = spark.createDataFrame([("Maven", "g:a", "1.0", i, f"V{i}", "s" * 300, [(0.0 if i else 9.1, "low")]) for i in range(7)], "advisory_ecosystem string, name string, version string, at int, id string, summary string, scores array<struct<score:double,severity:string>>")
    found = facts.vulnerable(deps, advisories)
    assert found.count() == 5 and rows(found.where("advisory = 'V0'"), "ecosystem", "severity", F.length("summary")) == [("gradle", "critical", 200)]
    counts = facts.severity_counts(found)
    assert rows(counts, "critical", "low") == [(1, 4)]
    s = services(spark, service(id="a", needs_review=False), service(repo_id=2, id="b", needs_review=True), service(repo_id=3, id="c", needs_review=False))
    assert rows(facts.gate(found, s)) == [(1, 1), (2, 2), (3, 0)]


def test_differences_merges_and_model_actions(spark):
    a = services(spark, service(id="a", category="email", owner="me"), service(id="b", confidence="low"), service(id="m", source="manual"))
    b = services(spark, service(id="b", confidence="medium"), service(id="c"), service(id="a", category="data", url="u"))
    deps = spark.createDataFrame([(1, "npm", "x")], "repo_id int, ecosystem string, name string")
    assert rows(facts.stack_diff(a, b, deps, deps.limit(0)), "change_kind", "entity") == [("added", "c"), ("changed", "a"), ("changed", "b"), ("dep_removed", "npm:x"), ("removed", "m")]
    over = spark.createDataFrame([(1, "c", "high")], "repo_id int, id string, confidence string")
    assert rows(facts.merge_services(b, a.where("id = 'm'"), over, a), "id", "category", "owner", "confidence") == [("a", "data", "me", None), ("b", "other", None, "medium"), ("c", "other", None, "high"), ("m", "other", None, None)]
    kept = facts.keep_listed(a, spark.createDataFrame([(1, "a")], "repo_id int, id string"))
    assert rows(kept, "id") == [("a",)] and facts.keep_listed(a, spark.createDataFrame([(1, "zz")], "repo_id int, id string")).count() == 3
    actions = spark.createDataFrame([(1, "a", "category", "ai"), (1, "b", "confidence", " HIGH "), (1, "m", "remove", None), (1, "a", "confidence", "sure")], "repo_id int, id string, action string, value string")
    assert rows(facts.apply_actions(a, actions), "id", "category", "confidence", "needs_review") == [("a", "ai", None, None), ("b", "other", "high", False)]
    shape = "repo_id int, id string, name string, category string, confidence string, needs_review boolean, reasons array<string>"
    own, new = spark.createDataFrame([(1, "a", "A", "other", "low", True, ["r"])], shape), spark.createDataFrame([(1, "a", "A", "email", "medium", None, ["s"]), (1, "n", "N", None, None, None, None), (1, None, "x", None, None, None, None)], shape)
    assert rows(facts.merge_model(own, new)) == [(1, "a", "A", "email", "medium", False, ["r", "s"]), (1, "n", "N", "other", "medium", False, [])]
    config = spark.createDataFrame([(1, "zz", "A", "boss", "paid", 1), (1, "a", "other", "late", "free", 2)], "repo_id int, id string, name string, owner string, plan string, ord long")
    assert rows(facts.overlay_config(services(spark, service(id="a", name="A")), config), "owner", "plan") == [("boss", "paid")]
    lost = spark.createDataFrame([(1, "Foo Bar", "low_score", 3, "other"), (1, "Q", "low_score", 1, "other")], "repo_id int, name string, reason string, score int, category string")
    back, rest = facts.restore(lost, lost.where("name = 'Q'"))
    assert rows(back, "id") == [("q",)] and rows(rest, "name") == [("Foo Bar",)]


def test_overlays(spark):
    base = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "repo_id int, id string, owner string")
    changes = spark.createDataFrame([(1, "a", "new", False, 2), (1, "a", "old", False, 1), (1, "b", None, True, 1), (1, "c", "added", False, 1)], "repo_id int, id string, owner string, deleted boolean, ts int")
    assert rows(graph.overlaid(base, changes, ["repo_id", "id"])) == [(1, "a", "new"), (1, "c", "added")]


def test_history(spark):
    h = spark.createDataFrame([(1, datetime(2024, 1, 1 + i % 28, i // 28), i) for i in range(101)], "repo_id int, ts timestamp, score int")
    assert history.kept(h).count() == 100
    small = spark.createDataFrame([(1, datetime(2024, 1, d), s) for d, s in ((1, 50), (2, 70), (3, 65))], "repo_id int, ts timestamp, score int")
    assert rows(history.trend(small), "delta") == [(-5,), (20,), (None,)]
    assert rows(history.stats(small), "lowest", "highest", "mean", "latest", "change", "n") == [(50, 70, 62, 65, 15, 3)]
    calls = spark.createDataFrame([("c", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 2, 9, 10, 11)], "channel string, ts timestamp")
    assert rows(history.accepted_calls(calls, 10, 2)) == [("c", 4, 2)]


def test_reports(spark, tmp_path):
    deps = spark.createDataFrame([(1, "npm", "@a/b", "^1", "production", 2), (1, "pip", "c", "*", "peer", 1)], "repo_id int, ecosystem string, name string, version string, type string, ord long")
    document = reports.cyclonedx(deps, F.lit("app"), F.lit("t")).first().document
    assert document.index('"pkg:pypi/c"') < document.index('"pkg:npm/%40a/b@^1"') and '"scope":"optional"' in document
    assert '"SPDXID":"SPDXRef-Package--a-b"' in reports.spdx(deps, F.lit("app"), F.lit("t")).first().document
    s = services(spark, service(id="a", name="<A|>", category="email", plan="paid"))
    assert "&lt;A|&gt;" in reports.services_html(s).first().document
    assert '"id":"a"' in reports.services_json(s).first().document and reports.summary_lines(s).first().document == "email: 1"
    badge = spark.createDataFrame([(1, 80, 3, 0, 2, "2024-01-02")], "repo_id int, score int, services int, vulnerabilities int, dependencies int, scanned string")
    got = {r.kind: r.url for r in reports.badge_urls(badge).collect()}
    assert got["score"].endswith("Stack_Score-80%2F100-brightgreen") and got["scanned"].endswith("Scanned-2024--01--02-8090a6")
    key = F.lit(b"0123456789abcdef")
    hidden = reports.encrypted(spark.createDataFrame([("me", 1)], "owner string, x int"), key)
    assert hidden.first().owner != "me" and reports.decrypted(hidden, key).first().owner == "me"
    path = str(tmp_path / "snap")
    reports.write_snapshot(spark.createDataFrame([(1, "a"), (2, "b")], "repo_id int, id string"), path)
    reports.write_snapshot(spark.createDataFrame([(1, "c")], "repo_id int, id string"), path)
    assert rows(spark.read.parquet(path), "repo_id", "id") == [(1, "c"), (2, "b")]


def test_doctor_and_counts(spark):
    s = services(spark, service(id="a", name="A", plan="paid", needs_review=True, confidence="low"))
    repos = spark.createDataFrame([(1, True, True, "p"), (2, False, False, None)], "repo_id int, has_config boolean, config_valid boolean, project_name string")
    vulns = spark.createDataFrame([(1, 1, 0, 0, 0, 0)], "repo_id int, critical long, high long, medium long, low long, unknown long")
    got = {(r.repo_id, r.check_id): r.level for r in health.doctor(s, repos, vulns).collect()}
    assert got[1, "renewal_dates"] == "error" and got[1, "owners"] == "warning" and got[1, "vulnerabilities"] == "error" and got[2, "config_found"] == "error" and got[2, "detected"] == "warning"
    assert (2, "owners") not in got and (2, "config_valid") not in got
    assert health.default_view(s).count() == 0 and health.to_review(s).count() == 1 and health.facets(s, "a", activity="active").count() == 1


def test_limited_calls_with_pauses(spark):
    import random

    r, expected, made = random.Random(5), {}, []
    for channel in ("hot", "slow", "quiet"):
        t, times = 0, []
        for _ in range(400 if channel == "hot" else 60):
            t += r.choice([0, 1, 2, 3, 9, 10, 11, 40]) if channel != "quiet" else 10
            times.append(t)
        recent, yes = [], 0
        for t in times:
            recent = [x for x in recent if t - x < 10]
            if len(recent) < 2:
                recent.append(t)
                yes += 1
        expected[channel] = (channel, yes, len(times) - yes)
        made += [(channel, t) for t in times]
    r.shuffle(made)
    calls = spark.createDataFrame([*made, (None, 1), ("hot", None)], "channel string, t long").selectExpr("channel", "timestamp_seconds(t) AS ts")
    assert rows(history.accepted_calls(calls, 10, 2)) == sorted(expected.values())
    assert rows(history.accepted_calls(calls.limit(0), 10, 2)) == []


def test_containing_equals_a_nested_comparison(spark):
    r = random.Random(3)
    sign = lambda n: "".join(r.choice("abcé.😀") for _ in range(n))
    needles = [(r.randrange(3), sign(r.randrange(6))) for _ in range(150)] + [(0, None), (0, ""), (7, "a")]
    hays = [(r.randrange(3), sign(r.randrange(12))) for _ in range(200)] + [(1, None), (0, ""), (8, "a")]
    got = containing(spark.createDataFrame(needles, "repo_id int, needle string"), spark.createDataFrame(hays, "repo_id int, hay string"), ["repo_id"])
    assert sorted(map(tuple, got.collect())) == sorted({(k, n, h) for k, n in needles for j, h in hays if k == j and n is not None and h is not None and n in h})


def test_contains_join_of_many_services_in_one_repository(spark):
    """10^5 services against 10^5 values of one repository: a nested comparison would be 10^10."""
    s = spark.range(100_000).select((F.col("id") % 1).alias("repo_id"), F.concat(F.lit("s"), "id").alias("id"), F.concat(F.lit("Name"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("name"))
    ev = spark.range(100_000).select((F.col("id") % 1).alias("repo_id"), F.concat(F.lit("X_NAME"), F.lpad((F.col("id") * 3).cast("string"), 7, "0"), F.lit("_KEY")).alias("value"), F.concat(F.lit("f"), F.col("id") % 1000).alias("file"), F.col("id").alias("ord"))
    began = time.monotonic()
    assert facts.service_files(s, ev).count() == 33_334
    assert time.monotonic() - began < 120
    assert "NestedLoop" not in facts.service_files(s, ev)._jdf.queryExecution().toString() and "Cartesian" not in facts.service_files(s, ev)._jdf.queryExecution().toString()


def test_relevant_files_and_activity_as_the_analysis_has_them(spark):
    s = spark.createDataFrame([(1, "sendgrid", "Send Grid", "inferred", None), (1, "stripe", "Stripe", "inferred", "own.ts"), (1, "m", "Stripe", "manual", None)], "repo_id int, id string, name string, source string, inferred_from string")
    ev = spark.createDataFrame([(1, "SENDGRID_KEY", "z.ts", 1), (1, "x", "stripe/z.ts", 2), (1, "stripe", "c.ts", 9), (1, "my.Stripe", "d.ts", 3), (1, "stripe2", "a.ts", 5), (1, "stripe", "b.ts", 4), (1, "stripe", "d.ts", 8)], "repo_id int, value string, file string, ord int")
    got = facts.relevant_files(s.where("id <> 'm'"), ev)
    assert rows(got, "id", "k", "file") == [("sendgrid", 1, "z.ts"), ("stripe", 1, "d.ts"), ("stripe", 2, "b.ts"), ("stripe", 3, "a.ts")]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    commits = spark.createDataFrame([(1, "own.ts", datetime(2024, 5, 1)), (1, "z.ts", datetime(2024, 1, 1))], "repo_id int, file string, ts timestamp")
    active = facts.last_activity(s, ev, commits, F.to_timestamp(F.lit("2024-05-02")))
    assert rows(active, "id", "days", "status") == [("sendgrid", None, "active"), ("stripe", 1, "active")]  # activity goes by the name as it is


def test_model_actions_as_the_analysis_has_them(spark):
    shape = "repo_id int, id string, name string, category string, confidence string, needs_review boolean, reasons array<string>"
    own = spark.createDataFrame([(1, "a", "A", "other", "low", True, ["ra"]), (1, "b", "B", "email", "medium", False, ["rb"]), (1, "h", "H", "ai", "high", False, ["rh"]), (2, "b", "B", "email", "low", True, None)], shape)
    merge = lambda *rows_: facts.apply_actions(own, spark.createDataFrame(rows_, "repo_id int, id string, action string, value string"))
    for to in ("zzz", "h", "b"):  # absent, fixed, itself
        assert merge((1, "b", "merge", to)).count() == 4
    assert rows(merge((1, "b", "merge", "a")).where("repo_id = 1"), "id", "reasons") == [("a", ["ra", "rb"]), ("h", ["rh"])]
    assert merge((1, "h", "merge", "a"), (1, "h", "remove", None)).count() == 4
    new = spark.createDataFrame([(1, "n", "N", None, "low", None, ["1"], 1), (1, "n", "N2", "cdn", "high", None, ["2"], 2), (1, "n", "N3", "data", "medium", None, ["3"], 3), (1, "a", "A", "other", "medium", None, None, 1)], shape + ", ord int")
    got = rows(facts.merge_model(own, new).where("repo_id = 1 AND id IN ('a', 'n')"), "id", "name", "category", "confidence", "needs_review", "reasons")
    assert got == [("a", "A", "other", "medium", False, ["ra"]), ("n", "N", "cdn", "high", False, ["1", "2", "3"])]


def test_saved_graph_enriches_and_keeps(spark):
    made = spark.createDataFrame([(1, "user", "User", "layer", None), (1, "svc-a", "A", "external", "a"), (1, "svc-b", "B", "external", "b")], "repo_id int, id string, label string, type string, service_id string")
    saved = spark.createDataFrame([(1, "user", "Me", "cdn", None, None, "red", 1.0, 1.0), (1, "svc-a", None, "cdn", "mine", "x", None, 2.0, 2.0), (1, "svc-gone", "Gone", None, "ai", None, None, 3.0, 3.0)], "repo_id int, id string, label string, type string, category string, note string, layer_color string, x double, y double")
    links = spark.createDataFrame([(1, "user", "svc-a", "data")], "repo_id int, source string, target string, flow_type string")
    own = spark.createDataFrame([(1, "a", "email", "free", "low", "u"), (1, "b", "data", "paid", None, "v")], "repo_id int, id string, category string, plan string, confidence string, url string")
    nodes, _ = graph.with_saved(made, links, saved, links, own)
    got = {r.id: r for r in nodes.collect()}
    assert (got["user"].label, got["user"].type, got["user"].layer_color, got["user"].x) == ("Me", "layer", "red", None)
    assert (got["svc-a"].label, got["svc-a"].type, got["svc-a"].category, got["svc-a"].confidence, got["svc-a"].note) == ("A", "cdn", "mine", "low", "x")
    assert (got["svc-b"].category, got["svc-b"].plan, got["svc-b"].confidence, got["svc-b"].url) == ("data", "paid", "high", "v")
    assert (got["svc-gone"].type, got["svc-gone"].plan, got["svc-gone"].source, got["svc-gone"].service_id, got["svc-gone"].x) == ("external", "unknown", "manual", None, 3.0)
    whole, _ = graph.with_saved(made.where("id <> 'svc-b'"), links, saved, links, own)
    assert rows(whole, "id", "x") == [("svc-a", 2.0), ("svc-gone", 3.0), ("user", 1.0)]


def test_documents_in_lines_are_the_whole_ones(spark):
    deps = spark.createDataFrame([(1, "npm", '@a/"b', "^1", "production", 2), (1, "pip", "c", "*", "peer", 1), (2, "go", "x", "v1", "production", 5)], "repo_id int, ecosystem string, name string, version string, type string, ord long")
    for whole, lines in ((reports.cyclonedx, reports.cyclonedx_lines), (reports.spdx, reports.spdx_lines)):
        want = {r.repo_id: json.loads(r.document) for r in whole(deps, F.lit("app"), F.lit("t")).collect()}
        got = {}
        for r in sorted(lines(deps, F.lit("app"), F.lit("t")).collect(), key=lambda r: (r.section, r.place)):
            got[r.repo_id] = got.get(r.repo_id, "") + r.line + "\n"
        assert {k: json.loads(v) for k, v in got.items()} == want



def test_an_overlay_joins_the_first_of_a_name_alone(spark):
    """Services and configured ones that share a name don't meet in all pairs."""
    many = [service(id=f"a{i}", name="A" if i % 2 else "B") for i in range(20)]
    config = spark.createDataFrame([(1, "x", "A", 5, "late"), (1, "y", "A", 2, "first"), (1, "a3", "Z", 1, "own"), (1, "a5", "Z", 9, "later"), (1, "z", "A", 7, None)], "repo_id int, id string, name string, ord int, owner string")
    out = facts.overlay_config(services(spark, *many), config)
    want = {f"a{i}": "own" if i == 3 else "first" if i % 2 else None for i in range(20)}
    base = {r.id: r.owner for r in services(spark, *many).collect()}
    assert {r.id: r.owner for r in out.collect()} == {k: v or base[k] for k, v in want.items()}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3  # two of them below the joins
