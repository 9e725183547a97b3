"""Streams over several micro-batches give what the batch operators give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold.operators.payments import activate, suppress_replays
from tallyfold.operators.submissions import decide_submissions
from tallyfold.plans.flows import free_subscriptions
from tallyfold.streaming.monitor import session_counts, tumbling_counts
from tallyfold.streaming.payments import activation, drop_redeliveries, subscriptions_after
from tallyfold.streaming.run import drain, drain_batches
from tallyfold.streaming.submissions import decide_stream

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def paid_rows():
    """Payments over 40 days with immediate redeliveries, a late repeat and an A,B,A pattern."""
    rows = []
    for day in range(40):
        user, at = f"u{day % 3}", START + dt.timedelta(days=day)
        rows.append((user, f"r{day}", at))
        if day % 4 == 0:
            rows.append((user, f"r{day}", at + dt.timedelta(hours=1)))
    rows += [("u0", "A", START + dt.timedelta(days=50 + i)) for i in (0, 2)]
    rows.append(("u0", "B", START + dt.timedelta(days=51)))
    return rows


def write_days(spark, folder, rows, schema, time):
    """One file per ten days, in time order."""
    df = spark.createDataFrame(rows, schema)
    for part in range(8):
        low, high = START + dt.timedelta(days=10 * part), START + dt.timedelta(days=10 * part + 10)
        some = [r for r in rows if low <= r[time] < high]
        if some:
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
    return df


def read_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


SCHEMA = "user_id string, ref string, paid_at timestamp"


@pytest.mark.parametrize("dedupe", ["last", "all"])
def test_activation_equals_batch(spark, tmp_path, dedupe):
    paid = write_days(spark, f"{tmp_path}/in", paid_rows(), SCHEMA, 2)
    users = spark.createDataFrame([(f"u{i}",) for i in range(4)], "id string")
    initial = free_subscriptions(users)
    apply = activation(f"{tmp_path}/state", initial, dedupe="last")
    drain_batches(read_stream(spark, f"{tmp_path}/in", SCHEMA), apply, f"{tmp_path}/progress")
    if dedupe == "all":
        # A retried batch writes the same rows again.
        last = paid.where(F.col("paid_at") >= F.lit(START + dt.timedelta(days=50)))
        apply(last, 4)
    state = subscriptions_after(spark, f"{tmp_path}/state", initial)
    kept = suppress_replays(paid, "last", order=("paid_at", "ref"))
    want = activate(initial, kept)
    cols = ["user_id", "status", "expires_at", "provider_ref"]
    assert sorted(map(tuple, state.select(cols).collect()), key=repr) == sorted(
        map(tuple, want.select(cols).collect()), key=repr
    )


def test_redeliveries(spark, tmp_path):
    paid = write_days(spark, f"{tmp_path}/in", paid_rows(), SCHEMA, 2)
    stream = read_stream(spark, f"{tmp_path}/in", SCHEMA)
    out = drain(drop_redeliveries(stream, ["user_id", "ref"], "paid_at", "30 days"), f"{tmp_path}/out")
    want = suppress_replays(paid, "all", order=("paid_at", "ref"))
    cols = ["user_id", "ref"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_decisions(spark, tmp_path):
    schema = "user_id string, round string, received_at timestamp, html string, stats string"
    good = '{"evidence": 9, "students": 2, "workPairs": 3}'
    rows = [(f"u{i}", "r", START + dt.timedelta(days=i), "x" * (490 + i), good) for i in range(0, 60, 3)]
    subs = write_days(spark, f"{tmp_path}/in", rows, schema, 2)
    rounds = spark.createDataFrame([("r", True, "2024-02-10T00:00:00Z")], "round string, open boolean, closes_at string")
    out = drain(decide_stream(read_stream(spark, f"{tmp_path}/in", schema), rounds).drop("html"), f"{tmp_path}/out")
    want = decide_submissions(subs, rounds)
    cols = ["user_id", "decision"]
    got = sorted(map(tuple, out.select(cols).collect()))
    assert got == sorted(map(tuple, want.select(cols).collect()))
    assert {d for _, d in got} == {"short", "accepted", "late"}


def test_counts(spark, tmp_path):
    paid = write_days(spark, f"{tmp_path}/in", paid_rows(), SCHEMA, 2)
    stream = read_stream(spark, f"{tmp_path}/in", SCHEMA)
    daily = drain(tumbling_counts(stream, "user_id", "paid_at"), f"{tmp_path}/daily")
    # The watermark ends at 51 days and 23 hours, so day 50 is the last that closes.
    want = paid.groupBy("user_id", F.to_date("paid_at").alias("d")).count()
    got = daily.select("user_id", F.to_date("starts_at"), "n")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [t for t in map(tuple, want.collect()) if t[1] <= dt.date(2024, 2, 20)], key=repr
    )
    sessions = drain(session_counts(stream, "user_id", "paid_at", gap="2 hours"), f"{tmp_path}/sessions")
    assert sessions.agg(F.max("n")).first()[0] == 2
