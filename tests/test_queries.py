import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tarn import queries
from tarn.operators import distinct

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in queries.TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_equals_its_sql(spark, oracle, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = oracle.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderpriority IN ('1-URGENT')").select("o_orderkey", "o_orderpriority")
    plan = plan_of(df)
    assert re.search(r"PushedFilters: \[.*In\(o_orderpriority|PushedFilters: \[.*EqualTo\(o_orderpriority", plan)
    assert "o_totalprice" not in plan


def test_small_sides_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan_of(queries.broadcast_hint(spark, SF))
    assert "LeftSemi" in plan_of(queries.dpp_prune(spark, SF))


def test_exact_percentiles_are_not_kept_for_each_distinct_value(spark):
    """A buffer of every sketch and percentile for each (flag, part) takes too long on large tables."""
    lines = re.findall(r"ObjectHashAggregate.*", plan_of(queries.queries()["agg_approx_distinct"](spark, SF)))
    assert lines and not [x for x in lines if re.search(r"keys=\[[^\]]*l_partkey", x)]
    spark.read.parquet(f"{SF}/lineitem.parquet").createOrReplaceTempView("lineitem")
    got = queries.queries()["agg_approx_distinct"](spark, SF)
    want = spark.sql(queries.PAIRS["agg_approx_distinct"][0])
    assert got.schema == want.schema
    assert sorted(got.collect()) == sorted(want.collect())


def test_distinct_values_counted_apart(spark):
    rows = [("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("a", None, 9.0), (None, 3, 4.0), (None, 3, 5.0), ("b", None, 6.0)]
    df = spark.createDataFrame(rows, "k string, v int, x double")
    got = distinct.counted_apart(df, ["k"], "v", "n", F.median("x").alias("m"), F.count(F.lit(1)).alias("c"))
    assert got.columns == ["k", "m", "c", "n"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 2.5, 4, 2), (None, 4.5, 2, 1), ("b", 6.0, 1, 0)], key=repr)
    assert distinct.counted_apart(df.limit(0), ["k"], "v", "n", F.median("x").alias("m")).collect() == []
