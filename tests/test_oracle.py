"""Every query against its SQL twin on the smallest tables, and its plan."""

import math

import duckdb
import pytest

from glyphfold.catalog import load
from glyphfold.schemas import TABLES

from conftest import SMALL

QUERIES, ORACLE = load()


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLE[name])
    assert rows_by_name(df.columns, df.collect()) == rows_by_name(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name", ["flagship_redact_and_prove", "win6_style_runs", "agg6_median", "jon5_requirements", "snk2_fingerprint"]
)
def test_same_with_other_partitions(spark, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(rows_by_name(*(lambda df: (df.columns, df.collect()))(QUERIES[name](spark, SMALL))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
