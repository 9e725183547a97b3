"""Edge rows of access, payments and state documents."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.operators.access import access_asof, derive_expired
from tallyfold.operators.payments import (
    activate,
    classify_events,
    invoice_requests,
    latest_periods,
    price_asof,
    stack_periods,
    suppress_replays,
    upsert_latest,
)
from tallyfold.operators.state import bootstrap_rows, profile_state, replay_versions, stale_writes
from tallyfold.plans.flows import free_subscriptions

NOW = dt.datetime(2024, 6, 1)
DAY = dt.timedelta(days=1)


def utc(x):
    return x.replace(tzinfo=dt.timezone.utc)


def access(spark, users, subs, **kw):
    u = spark.createDataFrame(users, "id string, created_at timestamp")
    s = spark.createDataFrame(subs, "user_id string, status string, expires_at timestamp")
    return {r.user_id: r.access for r in access_asof(u, s, "2024-06-01 00:00:00", **kw).collect()}


def test_access_edges(spark):
    old = utc(NOW - 100 * DAY)
    users = [(n, old) for n in ("endless", "at_end", "after", "cancelled", "free")] + [
        ("young", utc(NOW - 10 * DAY + dt.timedelta(microseconds=1))),
        ("ten", utc(NOW - 10 * DAY)),
        ("unknown", None),
    ]
    subs = [
        ("endless", "active", None),
        ("at_end", "active", utc(NOW)),
        ("after", "active", utc(NOW + dt.timedelta(seconds=1))),
        ("cancelled", "cancelled", utc(NOW + DAY)),
        ("free", "free", None),
    ]
    expected = {
        "endless": "subscribed", "at_end": "none", "after": "subscribed", "cancelled": "none",
        "free": "none", "young": "trial", "ten": "none", "unknown": "none",
    }
    assert access(spark, users, subs) == expected
    assert access(spark, users, subs, policy="published") == expected | {"cancelled": "subscribed"}
    with pytest.raises(ValueError):
        access(spark, users, subs, policy="other")


def test_expired(spark):
    subs = spark.createDataFrame(
        [("a", "active", utc(NOW)), ("b", "active", None), ("c", "cancelled", utc(NOW))],
        "user_id string, status string, expires_at timestamp",
    )
    got = {r.user_id: r.status for r in derive_expired(subs, "2024-06-01").collect()}
    assert got == {"a": "expired", "b": "active", "c": "cancelled"}


def fold(times, period=365):
    """The handler's rule, one payment after the other."""
    end, ends = None, []
    for t in times:
        base = t if end is None else max(t, end)
        end = base + dt.timedelta(days=period)
        ends.append(end)
    return ends


def fold_years(times):
    end, ends = None, []
    for t in times:
        base = t if end is None else max(t, end)
        leap = base.month == 2 and base.day == 29
        end = base.replace(year=base.year + 1, day=28 if leap else base.day)
        ends.append(end)
    return ends


def stacked(spark, times, **kw):
    paid = spark.createDataFrame(
        [("u", i, utc(t)) for i, t in enumerate(times)], "user_id string, ref long, paid_at timestamp"
    )
    rows = stack_periods(paid, **kw).orderBy("paid_at", "ref")
    return [
        dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=r.expires_ms) for r in rows.collect()
    ]


def test_stack_edges(spark):
    first = dt.datetime(2020, 2, 29, 8)
    end = first + dt.timedelta(days=365)
    times = [first, first, end - DAY, end + dt.timedelta(days=365), dt.datetime(2030, 1, 1)]
    assert stacked(spark, times) == fold(times)
    assert stacked(spark, times, year="calendar") == fold_years(times)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.datetimes(dt.datetime(2016, 1, 1), dt.datetime(2028, 12, 31)).map(
            lambda x: x.replace(microsecond=0)
        ),
        min_size=1, max_size=12,
    )
)
def test_stack_is_the_fold(spark, hot, times):
    times = sorted([*times, dt.datetime(2024, 2, 29), dt.datetime(2024, 2, 29)])
    for year, plain in (("days365", fold), ("calendar", fold_years)):
        assert stacked(spark, times, year=year) == plain(times)
    with hot(3):
        assert stacked(spark, times) == fold(times)
        assert stacked(spark, times, year="calendar") == fold_years(times)


def test_stack_two_plans_and_current_end(spark):
    paid = spark.createDataFrame(
        [("u", 1, utc(NOW), 30), ("u", 2, utc(NOW + DAY), 365), ("v", 3, utc(NOW), 30)],
        "user_id string, ref long, paid_at timestamp, days int",
    )
    current = spark.createDataFrame([("u", utc(NOW + 10 * DAY))], "user_id string, expires_at timestamp")
    ends = latest_periods(stack_periods(paid, period=F.col("days"), current=current))
    got = {r.user_id: r.expires_at.replace(tzinfo=None) for r in ends.collect()}
    assert got == {"u": NOW + (10 + 30 + 365) * DAY, "v": NOW + 30 * DAY}


def test_replays(spark):
    refs = ["A", "A", "B", "A", None, None]
    rows = [("u", r, utc(NOW + i * DAY), i) for i, r in enumerate(refs)]
    events = spark.createDataFrame(rows, "user_id string, ref string, received_at timestamp, n long")

    def kept(**kw):
        done = suppress_replays(events, order=("received_at", "n"), **kw)
        return sorted(r.n for r in done.collect())

    assert kept() == [0, 2, 3, 4]
    assert kept(mode="all") == [0, 2, 4]
    stored = spark.createDataFrame([("u", "A")], "user_id string, provider_ref string")
    assert kept(stored=stored) == [2, 3, 4]
    assert kept(mode="all", stored=stored) == [2, 4]
    again = suppress_replays(events, order=("received_at", "n"))
    assert suppress_replays(again, order=("received_at", "n")).count() == again.count()


def test_classify(spark):
    events = spark.createDataFrame(
        [
            (1, None, "bad"), (2, None, "t"), (3, "", "t"), (4, "nowhere", "t"), (5, "inv", "t"),
            (6, "open", "t"), (7, "nobody", "t"), (8, "seen", "t"), (9, "both", None),
        ],
        "event_id long, object_id string, secret_token string",
    )
    objects = "id string, status string, user_id string"
    payments = spark.createDataFrame(
        [("open", "initiated", "u"), ("nobody", "paid", None), ("seen", "paid", "s"), ("both", "paid", "u")],
        objects,
    )
    invoices = spark.createDataFrame([("inv", "paid", "u"), ("both", "void", "u")], objects)
    subs = spark.createDataFrame([("s", "seen")], "user_id string, provider_ref string")

    def outcomes(token):
        done = classify_events(events, payments, invoices, subs, token)
        return {r.event_id: (r.outcome, r.found_in) for r in done.collect()}

    assert outcomes("t") == {
        1: ("bad_token", None), 2: ("no_id", None), 3: ("no_id", None), 4: ("unverifiable", None),
        5: ("activated", "invoice"), 6: ("not_paid", "payment"), 7: ("no_user", "payment"),
        8: ("already", "payment"), 9: ("bad_token", "payment"),
    }
    assert outcomes(None)[1][0] == "no_id" and outcomes(None)[9][0] == "activated"


def test_upsert_keeps_other_columns(spark):
    schema = "user_id string, a string, b string"
    target = spark.createDataFrame([("old", "1", "keep"), ("same", "1", "x")], schema)
    changes = spark.createDataFrame(
        [("old", "2", 1), ("old", None, 2), ("new", "9", 1)], "user_id string, a string, n int"
    )
    rows = {r.user_id: (r.a, r.b) for r in upsert_latest(target, changes, "user_id", ["n"], ["a"]).collect()}
    assert rows == {"old": (None, "keep"), "same": ("1", "x"), "new": ("9", None)}


def test_activate(spark):
    users = spark.createDataFrame([("u",), ("v",)], "id string")
    paid = spark.createDataFrame([("u", "r1", utc(NOW))], "user_id string, ref string, paid_at timestamp")
    rows = {r.user_id: r for r in activate(free_subscriptions(users), paid).collect()}
    assert (rows["u"].status, rows["u"].plan, rows["u"].provider_ref) == ("active", "annual", "r1")
    assert rows["u"].expires_at.replace(tzinfo=None) == NOW + 365 * DAY
    assert rows["v"].status == "free" and rows["v"].expires_at is None


def test_invoice(spark):
    users = spark.createDataFrame([("u", None), ("v", "v@x.org")], "id string, email string")
    rows = invoice_requests(users, description="Year ", origin="https://site").collect()
    assert {(r.amount, r.currency, r.description, r.callback_url, r.metadata.email) for r in rows} == {
        (10000, "SAR", "Year ", "https://site/?paid=1", ""),
        (10000, "SAR", "Year v@x.org", "https://site/?paid=1", "v@x.org"),
    }


@pytest.mark.parametrize("rows_per_task", [1000, 2])
def test_price_at_one_instant(spark, hot, rows_per_task):
    prices = spark.createDataFrame(
        [("p", 1, 100), ("p", 5, 120), ("q", 9, 7)], "plan string, ts int, price int"
    )
    asked = spark.createDataFrame(
        [("p", 0, 1), ("p", 1, 2), ("p", 5, 3), ("p", 6, 4), ("q", 1, 5)], "plan string, ts int, id int"
    )
    with hot(rows_per_task):
        before = {r.id: r.price for r in price_asof(asked, prices, "plan", order=["id"]).collect()}
        at = {r.id: r.price for r in price_asof(asked, prices, "plan", order=["id"], strict=False).collect()}
    assert before == {1: None, 2: None, 3: 100, 4: 120, 5: None}
    assert at == {1: None, 2: 100, 3: 120, 4: 120, 5: None}


def test_versions_and_stale(spark):
    writes = spark.createDataFrame(
        [("u", "a", 1), ("u", "b", 2), ("u", "a", 3), ("u", "a", 4), ("w", "a", 1)],
        "user_id string, device string, ts int",
    )
    versions = {(r.user_id, r.ts): r.version for r in replay_versions(writes).collect()}
    assert versions == {("u", 1): 1, ("u", 2): 2, ("u", 3): 3, ("u", 4): 4, ("w", 1): 1}
    stale = {(r.user_id, r.ts) for r in stale_writes(writes).where("stale").collect()}
    assert stale == {("u", 3)}


def test_bootstrap_leaves_rows(spark):
    table = spark.createDataFrame([("u", "active")], "user_id string, status string")
    users = spark.createDataFrame([("u",), ("v",), ("v",)], "user_id string")
    rows = bootstrap_rows(users, table, {"status": F.lit("free")}).collect()
    assert sorted((r.user_id, r.status) for r in rows) == [("u", "active"), ("v", "free")]


def test_profile_types(spark):
    bodies = ['{"a": [1, 2, 3]}', '{"a": "x"}', '{"a": null}', "{bad", None, '{"a": [4]}']
    df = spark.createDataFrame([(b,) for b in bodies], "state string")
    rows = {r.type: (r.documents, r.array_items) for r in profile_state(df, ["$.a"]).collect()}
    assert rows == {"ARRAY": (2, 4), "STRING": (1, 0), "VOID": (1, 0), "ABSENT": (2, 0)}
