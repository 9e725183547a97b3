"""Scans, exports, reconciliation and snapshots."""

import datetime as dt
import json

import pytest
from pyspark.sql import types as T

from tallyfold.operators.constraints import audit_keys
from tallyfold.operators.rows import check_writes, lookup, visible_rows
from tallyfold.schemas import KEYS
from tallyfold.session import shared_dir
from tallyfold.sources.export import expired_snapshots, export_pages, read_export, write_export, write_snapshot
from tallyfold.sources.reconcile import export_totals, reconcile
from tallyfold.sources.tables import read_tables

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def test_defaults_fill_absent_values(spark, tmp_path):
    make = spark.createDataFrame
    make([("u", None), ("v", "active")], "user_id string, status string").write.parquet(f"{tmp_path}/subscriptions.parquet")
    make([("u", None, 5)], "user_id string, state string, version long").write.parquet(f"{tmp_path}/app_state.parquet")
    make([("u", "R")], "user_id string, ref string").write.parquet(f"{tmp_path}/award_entrants.parquet")
    make([("R", "x")], "ref string, html string").write.parquet(f"{tmp_path}/award_entries.parquet")
    make([("u",)], "id string").write.parquet(f"{tmp_path}/users.parquet")
    tables = read_tables(spark, str(tmp_path))
    assert {r.user_id: r.status for r in tables["subscriptions"].collect()} == {"u": "free", "v": "active"}
    state = tables["app_state"].first()
    assert (state.state, state.version) == ("{}", 5) and state.created_at is not None
    entry = tables["award_entries"].first()
    assert (entry.replaced, entry.suspects, entry.stats, entry.status) == (0, [], "{}", "received")
    audit = {(r.table, r.rule): (r.bad_keys, r.bad_rows) for r in audit_keys(tables, KEYS).collect()}
    assert audit[("subscriptions", "unique(user_id)")] == (0, 0)
    assert audit[("subscriptions", "foreign(user_id)")] == (1, 1)


def test_read_export_forms(spark, tmp_path):
    path = tmp_path / "export.json"
    lines = [
        json.dumps([{"id": "a", "n": 1}, {"id": "b", "n": 2}]), "", "   ", "[]",
        json.dumps({"users": [{"id": "c"}], "total": 1}), " " + json.dumps([{"id": "d", "extra": True}]),
    ]
    path.write_text("\n".join(lines))
    rows = {(r.id, r.n) for r in read_export(spark, str(path), ROW).collect()}
    assert rows == {("a", 1), ("b", 2), ("c", None), ("d", None)}
    path.write_text('[{"id": "a", "n": 1}\n')
    with pytest.raises(Exception):
        read_export(spark, str(path), ROW).collect()


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:03d}", i * 7) for i in range(123)], ROW)
    write_export(df, "id", f"{tmp_path}/e", size=50)
    text = spark.read.text(f"{tmp_path}/e").collect()
    assert sorted(len(json.loads(r.value)) for r in text) == [23, 50, 50]
    back = read_export(spark, f"{tmp_path}/e", ROW)
    assert reconcile(df, back, "id").count() == 0
    assert export_totals(df).first() == export_totals(back).first()
    with pytest.raises(Exception):
        write_export(df, "id", f"{tmp_path}/e")
    pages = export_pages(df, "id", 50).collect()
    assert all(r.rank == r.n // 7 + 1 and r.page == (r.rank - 1) // 50 for r in pages)


def test_reconcile(spark):
    schema = "id int, a string, b string"
    source = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, "x", "y"), (4, "d", "d"), (4, "e", "e")], schema)
    other = spark.createDataFrame([(1, None, "x"), (2, "x", "y"), (5, "x", "y"), (4, "e", "e"), (4, "d", "d")], schema)
    assert {r.id: r.status for r in reconcile(source, other, "id").collect()} == {1: "changed", 3: "missing", 5: "extra"}


def test_snapshots(spark, tmp_path):
    df = spark.range(3)
    path = write_snapshot(df, str(tmp_path), "20240101-000000")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        write_snapshot(df, str(tmp_path), "20240101-000000")
    now = dt.datetime(2024, 2, 1, 12, tzinfo=dt.timezone.utc)
    ages = [dt.timedelta(days=14), dt.timedelta(days=15) - dt.timedelta(seconds=1), dt.timedelta(days=15)]
    manifest = spark.createDataFrame([(i, now - a) for i, a in enumerate(ages)], "i int, stamp timestamp")
    assert [r.i for r in expired_snapshots(manifest, "2024-02-01 12:00:00").collect()] == [2]


def test_rows(spark):
    df = spark.createDataFrame([("u", 1), ("v", 2), (None, 3)], "owner string, n int")
    assert [r.n for r in lookup(df, "u", ["n"], "owner").collect()] == [1]
    many = spark.createDataFrame([("u",), ("u",), ("w",), (None,)], "k string")
    assert [r.n for r in lookup(df, many, ["n"], "owner").collect()] == [1]
    assert [r.n for r in visible_rows(df, many, "owner").collect()] == [1]
    assert visible_rows(df, many, None).count() == 0
    changes = spark.createDataFrame(
        [("insert", "u", "u"), ("insert", "u", "v"), ("update", None, "u"), ("delete", "u", "u")],
        "operation string, user_id string, caller string",
    )
    split = check_writes(changes, {"insert": "user_id", "update": "user_id"})
    assert [tuple(r) for r in split["accepted"].collect()] == [("insert", "u", "u")]
    assert split["rejected"].count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/tmp"}
    assert shared_dir(Session()) == "hdfs://shared/tmp"
