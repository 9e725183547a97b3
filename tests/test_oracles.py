"""Every registered query against its SQL twin, also with every key treated as hot.

Their plans may hold no join without keys, no Python worker and no window over a whole table.
"""

import re

import oracle
import pytest

import __spark_entry__ as entry
from tallyfold.plans import catalog

DATA = "/root/testdata"
NAMES = sorted(catalog.QUERIES)  # the corpus queries have tests of their own


@pytest.fixture(scope="module")
def connections():
    return {sf: oracle.connect(f"{DATA}/{sf}") for sf in ("sf0.01", "sf0.001")}


# Numbering a whole table carries totals across its slices: one row per slice, not the table.
ACROSS_SLICES = {"s2_read_export", "s3_export_pages"}


SQL_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def check_plan(df, name):
    plan = df._jdf.queryExecution().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan
    whole = re.findall(r"windowspecdefinition\([^,()]*\b(?:ASC|DESC)\b", plan)
    assert all("_slice" in w for w in whole) and (not whole or name in ACROSS_SLICES)


def compare(spark, con, name, sf):
    df = entry.queries()[name](spark, f"{DATA}/{sf}")
    check_plan(df, name)
    described = con.execute("describe " + entry.oracle_sql()[name]).fetchall()
    assert {c: SQL_TYPE[t] for c, t in df.dtypes} == {r[0]: r[1] for r in described}
    left = oracle.spark_rows(df)
    assert oracle.difference(left, oracle.sql_rows(con, entry.oracle_sql()[name])) is None


def test_every_query_has_a_twin():
    assert set(NAMES) == set(catalog.SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connections, name):
    compare(spark, connections["sf0.01"], name, "sf0.01")


@pytest.mark.parametrize("name", NAMES)
def test_query_with_hot_keys(spark, connections, hot, name):
    with hot(3):
        compare(spark, connections["sf0.001"], name, "sf0.001")


def test_entry(spark):
    rows = {r.access: r.users for r in entry.entry(spark).collect()}
    assert set(rows) <= {"subscribed", "trial", "none"} and sum(rows.values()) == 150


def test_numbers_of_the_blueprint(spark):
    """Counts stated in FIXTURES.md for sf0.01."""
    folder = f"{DATA}/sf0.01"
    run = {n: q for n, q in entry.queries().items()}

    def counts(name, column):
        return {r[column]: r["count"] for r in run[name](spark, folder).groupBy(column).count().collect()}

    assert counts("e1_access_asof", "access") == {"subscribed": 685, "trial": 272, "none": 543}
    assert counts("a1_decide_submissions", "decision") == {
        "late": 129, "too_large": 11, "short": 12, "stats": 71, "accepted": 27,
    }
    assert counts("r2_refund_decision", "decision") == {
        "invalid": 11237, "late": 3382, "refund": 112, "exported": 12,
    }
    assert counts("d3_stale_writes", "stale")[True] == 7266
    outcomes = counts("p1_classify_events", "outcome")
    assert outcomes.pop("already") + outcomes.pop("activated") == 2171
    assert outcomes == {"bad_token": 984, "no_id": 179, "unverifiable": 2220, "not_paid": 4446}
    assert counts("t5_derive_expired", "status") == {"active": 685, "expired": 587}
    leaks = run["a3_scan_pii"](spark, folder)
    assert [leaks.where(c).count() for c in ("has_national_id", "has_mobile", "has_email", "has_any")] == [18, 2, 11, 26]
    assert run["e7_price_asof"](spark, folder).where("price >= 0").count() == 1826
    assert run["s6_expired_snapshots"](spark, folder).count() == 16
    removed = run["x1_erase"](spark, folder).where("table_name = 'lineitem'").first()
    assert removed.rows == 60000 and removed.rows_left + removed.removed == 60000
    assert run["r5_outages"](spark, folder).count() == 56
    assert run["r4_charge_anomalies"](spark, folder).count() == 1774
    assert run["j5_exact_copies"](spark, folder).count() == 1000 - 927
