"""Recorded logs and answers, documents in parts, migrations, layers, budgets, sorting, cancellation."""

import json
import threading
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from svcgraph.operators import health, layout, prompts
from svcgraph.plans.cancel import cancel, cancellable
from svcgraph.sources import recorded, stored

from .conftest import rows

ATTEMPTS: dict[str, int] = {}


def flaky(path, url):
    """A transport that refuses twice, and one batch of which is down."""
    if "batch=down" in path:
        raise OSError("unreachable")
    n = ATTEMPTS[path] = ATTEMPTS.get(path, 0) + 1
    if "batch=busy" in path or n < 3:
        raise recorded.Refused
    return recorded.read_text(path, url)


def put(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_git_logs(spark, tmp_path):
    put(tmp_path, "repo_id=1/log", "lost.ts\n2024-05-01T10:00:00+02:00\n\nsrc/a.ts\nb c.ts\n\n2024-04-01T00:00:00Z\n\nsrc/a.ts\n2024-99-99T00:00:00Z\n")
    put(tmp_path, "repo_id=2/log", "2024-01-01T00:00:00Z\n\nx\n")
    put(tmp_path, "repo_id=3/_SUCCESS", "no")
    recorded.register(spark)
    df = spark.read.format("git_log").option("filesPerTask", "1").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    got = {(r.repo_id, r.file): r.ts for r in df.groupBy("repo_id", "file").agg(F.max("ts").alias("ts")).collect()}
    assert got.keys() == {(1, "src/a.ts"), (1, "b c.ts"), (1, "2024-99-99T00:00:00Z"), (2, "x")}
    assert got[1, "src/a.ts"].replace(tzinfo=timezone.utc) == datetime(2024, 5, 1, 8, tzinfo=timezone.utc)
    one = df.where("repo_id = 2")
    assert one.rdd.getNumPartitions() == 1 and rows(one, "file") == [("x",)]
    assert spark.read.format("git_log").load(str(tmp_path / "none")).count() == 0


def test_answers_with_refusals_and_failures(spark, tmp_path):
    package = {"package": {"name": "n", "ecosystem": "npm"}, "version": "1"}
    found = {"id": "A", "details": "long", "severity": [{"score": 9.5}], "aliases": ["C"], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "2"}]}]}], "references": [{"url": "http://r"}]}
    answer = json.dumps({"queries": [package, package, package], "results": [{"vulns": [found, {"summary": "s"}]}, {}, None]})
    for name, text in (("ok", answer), ("down", answer), ("busy", answer), ("bad", "{")):
        put(tmp_path, f"batch={name}/part", text)
    recorded.register(spark)
    read = spark.read.format("advisory_answers").option("transport", "tests.test_sources_and_prompts:flaky").option("retryDelay", "0.01")
    got = read.load(str(tmp_path)).collect()
    assert sorted((r.batch, r.ok) for r in got) == [("bad", False), ("busy", False), ("down", False), ("ok", True), ("ok", True)]
    assert {r.batch: r.error for r in got if not r.ok}["down"] == "OSError: unreachable"
    first, second = sorted((r for r in got if r.ok), key=lambda r: r.at)
    assert (first.id, first.summary, first.fixed_version, first.url, first.aliases, first.scores[0].score) == ("A", "long", "2", "http://r", ["C"], 9.5)
    assert (second.id, second.summary, second.fixed_version) == (None, "s", None)
    assert read.load(str(tmp_path)).where("batch = 'down'").count() == 1
    waits = []
    with pytest.raises(recorded.Refused):
        recorded.with_retries(lambda: (_ for _ in ()).throw(recorded.Refused()), wait=waits.append)
    assert waits == [1.0, 2.0, 3.0]


def test_documents_in_ordered_parts(spark, tmp_path):
    lines = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("repo"), F.col("id").alias("n"), F.concat(F.lit("line é "), "id").alias("line"))
    folder = str(tmp_path / "docs")
    recorded.write_documents(lines.repartition(5), "repo", ["n"], folder, 6)
    parts = recorded.read_documents(spark, folder)
    texts = {}
    for r in sorted(parts.collect(), key=lambda r: (r.document, r.place)):
        texts[r.document] = texts.get(r.document, "") + r.text
    want = {}
    for r in lines.orderBy("n").collect():
        want[r.repo] = want.get(r.repo, "") + r.line + "\n"
    assert texts == want and parts.where("document = 'hot'").count() > 1
    broken = lines.withColumn("line", F.when(F.col("n") == 29_999, F.raise_error(F.lit("stop"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="stop"):
        recorded.write_documents(broken, "repo", ["n"], str(tmp_path / "other"), 6)
    assert recorded.read_documents(spark, str(tmp_path / "other")).count() == 0
    assert not list((tmp_path / "other").glob("manifest-*")) and recorded.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_migrations_run_in_order(spark):
    raw = spark.createDataFrame([(1, '{"version":"0","a":[1],"x":{"y":null}}'), (2, '{"version":"1","b":2}'), (3, '{"c":3}'), (4, "nope"), (5, None), (6, '"text"'), (7, '{"version":"9","a":1}')], "repo_id int, body string")
    good, bad = stored.migrated(raw, [stored.renamed("0", "1", {"a": "b"}), stored.renamed("1", "2", {"b": "c"})], current="2")
    got = {r.repo_id: (json.loads(r.j), r.version) for r in good.select("repo_id", F.to_json("body").alias("j"), "version").collect()}
    assert {k: v[0].get("c") for k, v in got.items()} == {1: [1], 2: 2, 3: 3, 7: None} and {v[1] for v in got.values()} == {"2"}
    assert got[1][0]["x"] == {"y": None} and rows(bad, "repo_id", "reason") == [(4, "not JSON"), (5, "not JSON"), (6, "no object")]
    assert stored.migrated(raw.limit(0), [])[0].count() == 0


def test_layers(spark):
    edges = spark.createDataFrame([(1, "u", "b"), (1, "u", "a"), (1, "a", "x"), (1, "b", "y"), (1, "u", "y"), (1, "y", "x"), (2, "p", "q"), (2, "q", "p"), (1, "a", "a")], "repo_id int, source string, target string")
    nodes = spark.createDataFrame([(1, i) for i in ("u", "a", "b", "x", "y", "alone")] + [(2, "p"), (2, "q"), (2, "z")], "repo_id int, id string")
    got = {(r.repo_id, r.id): (r.rank, r.place) for r in layout.layered(nodes, edges).collect()}
    assert got[1, "u"] == (0, 1) and got[1, "alone"] == (0, 0) and got[1, "a"][0] == got[1, "b"][0] == 1 and got[1, "y"][0] == 2 and got[1, "x"][0] == 3
    assert got[2, "p"][0] == got[2, "q"][0] == got[2, "z"][0] == 0 and len(got) == 9
    assert layout.layered(nodes.limit(0), edges.limit(0)).count() == 0


def test_ranks_follow_no_path_twice(spark):
    """A ladder of 24 rungs has 2^24 paths; each rung is met once a depth. A cycle that something leads to ends after `most` edges, and a start must be a node."""
    ladder = [(1, f"{a}{k}", f"{b}{k + 1}") for k in range(24) for a in "xy" for b in "xy"]
    cycle = [(2, "s", "a"), (2, "a", "b"), (2, "b", "a"), (2, "b", "end"), (3, "gone", "n"), (3, "m", "o"), (3, "o", "n")]
    edges = spark.createDataFrame(ladder + cycle, "repo_id int, source string, target string")
    nodes = spark.createDataFrame(sorted({(r, x) for r, a, b in ladder + cycle for x in (a, b) if x != "gone"}), "repo_id int, id string")
    got = {(r.repo_id, r.id): r.rank for r in layout.ranks(nodes, edges, 26).collect()}
    assert all(got[1, f"{a}{k}"] == k for k in range(25) for a in "xy")
    assert (got[2, "s"], got[2, "a"], got[2, "b"], got[2, "end"]) == (0, 25, 26, 25) and (got[3, "o"], got[3, "n"]) == (1, 2) and len(got) == len(set(got))


def test_budget_ends_at_the_first_overflow(spark):
    files = spark.createDataFrame([(1, f"f{i}", i, "x" * n) for i, n in enumerate((100, 0, 300, 700, 5))] + [(2, "f", 0, "y" * 2000), (3, "f", 0, None), (4, "a", 0, "z" * 900), (4, "b", 1, "z" * 300), (4, "c", 2, "z")], "repo_id int, path string, ord int, content string")
    got = {(r.repo_id, r.path): r.content for r in prompts.within_budget(files.repartition(4), 1000, 200).collect()}
    assert sorted(got) == [(1, "f0"), (1, "f1"), (1, "f2"), (1, "f3"), (2, "f"), (4, "a")]
    assert got[1, "f3"] == "x" * 600 + prompts.MARK and got[2, "f"] == "y" * 1000 + prompts.MARK and got[4, "a"] == "z" * 900
    long = spark.createDataFrame([("\n".join("abc"),)], "c string").select(prompts.first_lines(F.col("c"), 2).alias("c")).first().c
    assert long == "a\nb" + prompts.MARK


def test_priority_and_sorting(spark):
    files = spark.createDataFrame([(1, p) for p in ("z.ts", "a.md", "b.py", "x/lib/q.js", "src/api/k.go", "c.rs", "d.tsx", "lib.d/.ts")], "repo_id int, path string")
    assert rows(prompts.priority_files(files), "k", "path") == [(1, "src/api/k.go"), (2, "x/lib/q.js"), (3, "b.py"), (4, "c.rs")]
    assert "WindowGroupLimit" in prompts.priority_files(files)._jdf.queryExecution().toString()
    deps = spark.createDataFrame([(1, n, i) for i, n in enumerate(("b", "A", "a", "B", "é", "z", "a"))], "repo_id int, name string, ord int")
    order = [r.ord for r in health.sorted_dependencies(deps).orderBy("place").collect()]
    assert order == [2, 6, 1, 0, 3, 4, 5]
    assert [r.ord for r in health.sorted_dependencies(deps, descending=True).orderBy("place").collect()] == [5, 4, 3, 0, 1, 2, 6]


def test_one_of_two_plans_is_stopped(spark):
    results = {}

    def work(tag, n):
        try:
            with cancellable(spark, tag):
                results[tag] = spark.range(0, n, 1, 2).agg(F.sum(F.length(F.sha2(F.col("id").cast("string").cast("binary"), 512)))).first()[0]
        except Exception as error:  # the stopped one
            results[tag] = error

    threads = [threading.Thread(target=work, args=a) for a in (("long", 10**11), ("short", 100))]
    for t in threads:
        t.start()
    threads[1].join(60)
    until = time.monotonic() + 60
    while threads[0].is_alive() and time.monotonic() < until:
        cancel(spark, "short")
        cancel(spark, "long")
        time.sleep(0.5)
    threads[0].join(60)
    assert results["short"] == 12_800 and isinstance(results["long"], Exception) and not spark.sparkContext.getJobTags()
