"""Hot keys take another plan and give the same rows; plans hold no step that cannot scale."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyfold.functions.skew import (
    OrderedRows,
    measure,
    previous,
    row_number,
    running_last,
    running_max,
    running_sum,
)
from tallyfold.operators import erasure
from tallyfold.operators.payments import classify_events, resolve_object
from tallyfold.operators.requests import build_chat_requests
from tallyfold.operators.rows import lookup


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one key, some to a null key."""
    draw = random.Random(5)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{draw.randrange(40)}")
        rows.append((key, draw.randrange(60), i, draw.choice([None, draw.randrange(-9, 9)])))
    return spark.createDataFrame(rows, "k string, ts int, id int, v int")


def as_set(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_measure(skewed, hot):
    assert measure(skewed, "k").values is None
    with hot(50):
        found = measure(skewed, "k")
        assert [r.k for r in found.values.collect()] == ["hot"] and found.rows == 300
        assert found.limit == 50


def jobs_while(spark, build):
    """The number of Spark jobs that building a query runs."""
    spark.sparkContext.setJobGroup("building", "building")
    try:
        build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))


def test_joins_run_no_job_while_they_are_built(spark):
    make = spark.createDataFrame
    users = make([("a", "a@b.co")], "user_id string, email string")
    payments = make([("p", "paid", "a")], "id string, status string, user_id string")
    events = make([("p", "t")], "object_id string, secret_token string")
    tables = {"users": make([("a",)], "id string"), "award_entrants": make([("a", "R")], "user_id string, ref string"),
              "award_entries": make([("R", "x")], "ref string, html string")}
    chain = [c for c in erasure.CHAIN if c[0] in tables]
    turns = make([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    limits = make([(1, "5")], "conv_id long, max_tokens string")

    def build():
        resolve_object(events, payments, payments.limit(0))
        classify_events(events, payments, payments.limit(0), make([("a", "r")], "user_id string, provider_ref string"))
        erasure.erase(tables, users.select("user_id"), chain=chain)
        erasure.residuals(tables, make([("users", "a")], "table string, key string"), chain)
        build_chat_requests(turns, limits)
        lookup(payments, users.select("user_id"), ["id"], "user_id")

    assert jobs_while(spark, build) == 0


def test_adaptive_execution_splits_a_skewed_key(spark):
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 60_000, 1, 8).selectExpr("if(id % 3 = 0, -1, id) object_id", "id", "md5(string(id)) body")
        objects = spark.range(60_000).selectExpr("id - 1 id", "'paid' status", "id user_id")
        joined = resolve_object(rows, objects, objects.limit(0))
        assert joined.groupBy().count().first()[0] == 60_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in names:
            spark.conf.unset(name)


@pytest.mark.parametrize("limit", [100, 20, 3])
def test_ordered_rows(skewed, hot, limit):
    order = [F.desc("ts"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v")
    plain = skewed.withColumns(
        {
            "n": F.row_number().over(w).cast("long"), "s": F.sum(v).over(up), "m": F.max(v).over(up),
            "l": F.last(v, ignorenulls=True).over(up), "p": F.lag(v).over(w),
        }
    )
    with hot(limit):
        scan = OrderedRows(skewed, "k", order)
        assert scan.heavy is not None
        scan.add(n=row_number(), s=running_sum(v), m=running_max(v), l=running_last(v), p=previous(v))
        slices = scan.heavy.groupBy("_slice").count().agg(F.max("count"), F.count("*")).first()
        assert slices[1] > 1 and slices[0] < 300
        assert as_set(scan.rows()) == as_set(plain)


@pytest.mark.parametrize("n", [2_000, 8_000])
def test_slices_stay_as_small_as_the_table_grows(spark, hot, n):
    rows = spark.range(0, n, 1, 4).selectExpr("id % 2 k", "id", "id * 7919 % 1000 v")
    with hot(100):
        scan = OrderedRows(rows, "k", ["id"]).add(n=row_number(), s=running_sum(F.col("v")), m=running_max(F.col("v")), p=previous(F.col("v")))
        sizes = scan.heavy.groupBy("_slice").count().agg(F.max("count"), F.count("*")).first()
        assert sizes[0] <= 3 * 100 and sizes[1] >= n // 300
        found = scan.rows()
        w = Window.partitionBy("k").orderBy("id")
        want = rows.withColumns({"n": F.row_number().over(w).cast("long"), "s": F.sum("v").over(w), "m": F.max("v").over(w), "p": F.lag("v").over(w)})
        assert as_set(found) == as_set(want)
        whole = OrderedRows(rows, [], ["id"], slice_all=True).add(n=row_number(), l=running_last(F.when(F.col("id") % 900 == 0, F.col("id"))))
        assert all(r.n == r.id + 1 and r.l == r.id // 900 * 900 for r in whole.rows().collect())


def test_whole_table_order(skewed, hot):
    with hot(100):
        ranked = OrderedRows(skewed, [], ["id"], slice_all=True).add(n=row_number()).rows()
        assert all(r.n == r.id + 1 for r in ranked.collect())


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filtered(spark):
    plan = physical(entry.queries()["f1_lookup"](spark, "/root/testdata/sf0.001"))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "o_totalprice" not in plan and "c_acctbal" not in plan


def test_access_shuffles_payments_once(spark):
    """Replay removal, stacking and the upsert share one hash of the payments by user.

    Beyond it only one row per user moves: the two user tables, and the new state after the
    outer join, whose merged key is hashed again.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(entry.queries()["e1_access_asof"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"FileScan parquet .*o_custkey", plan)) == 1
    assert len(re.findall(r"FileScan parquet .*c_custkey", plan)) == 2
    assert len(re.findall(r"\bExchange\b", plan)) == 1 + 2 + 1


def test_prizes_limit_before_the_shuffle(spark):
    assert "WindowGroupLimit" in physical(entry.queries()["j3_award_prizes"](spark, "/root/testdata/sf0.001"))
