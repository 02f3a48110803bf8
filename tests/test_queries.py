"""Each query over made files and facts against its SQL at the smallest scale."""

import decimal
import re
from pathlib import Path

import duckdb
import pytest

from svcgraph import oracle, oracle_files, oracle_more, queries

SF = "/root/testdata/sf0.001"
STEPS = {"jn02_brands", "fn37_structure", "win04_rate_limit", "agg19_doctor", "snk06_cyclonedx", "snk07_spdx", "snk08_badges"}
NAMES = sorted({*oracle_files.SQL, *oracle_more.SQL, *STEPS})


def plain(value):
    return round(float(value), 6) if isinstance(value, (float, decimal.Decimal)) else value


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, database, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = database.execute(oracle.SQL[name])
    named = [x[0] for x in result.description]
    assert sorted(named) == columns
    assert got == sorted((tuple(plain(dict(zip(named, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert re.fullmatch("[a-z0-9_]+", name)


def test_made_files_are_dealt_to_many_tasks(spark):
    """The part table is one row group; what its rows stand for is not parsed in one task."""
    from svcgraph import queries_files

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert all(made.rdd.getNumPartitions() > 1 for made in (queries_files.template(spark, SF, "tvf06_source"), queries_files.files(spark, SF, queries_files.T.NAMES[:1])))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_bodies_are_dealt_and_read_twice(spark):
    """Imported graphs parse each stored configuration for its nodes and for its services, not again for every join."""
    from svcgraph import queries_sources

    assert "RepartitionByExpression" in queries_sources.bodies(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert queries_sources.imported(spark, SF)[0]._jdf.queryExecution().optimizedPlan().toString().count("schema_of_variant") <= 4
