"""Edge rows of judging, copies, refunds, deadlines, erasure and request tables."""

import datetime as dt
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.functions.calendar import (
    add_business_days,
    add_business_days_with_holidays,
    business_days_between,
    next_business_day,
)
from tallyfold.operators.copies import find_copies, passage_origins
from tallyfold.operators.erasure import erase, erasure_audit, erasure_counts, overdue_erasures, write_erasure
from tallyfold.operators.judging import (
    award_deadlines,
    award_prizes,
    best_per_person,
    disqualify,
    eligible_suggestions,
    rank_entries,
    reward_payouts,
    weighted_scores,
)
from tallyfold.operators.refunds import (
    charge_anomalies,
    extend_for_outage,
    late_remedies,
    notice_audit,
    outages,
    paid_last_12_months,
    refund_decision,
)
from tallyfold.operators.requests import build_chat_requests, build_image_requests
from tallyfold.operators.service import refund_timeline, response_due

D = dt.date
T = lambda *a: dt.datetime(*a, tzinfo=dt.timezone.utc)


def test_scores_and_prizes(spark):
    scores = spark.createDataFrame(
        [("r", ref, c, s) for ref, four in {
            "a": (90, 90, 80, 100), "b": (90, 90, 80, 100), "c": (100, 80, 92, 80), "d": (1, 1, 1, 1),
        }.items() for c, s in zip(("evidence", "quality", "impact", "layout"), four)]
        + [("r", "e", "evidence", 10), ("r", "e", "style", 99)],
        "round string, ref string, criterion string, score int",
    )
    scored = weighted_scores(scores)
    got = {r.ref: (float(r.score), r.impact, r.complete) for r in scored.collect()}
    assert got["a"] == (89.0, 80, True) and got["c"] == (89.0, 92, True) and got["e"] == (3.0, 0, False)
    ranked = {r.ref: r.place for r in rank_entries(scored).collect()}
    assert ranked == {"c": 1, "a": 2, "b": 3, "e": 4, "d": 5}
    entrants = spark.createDataFrame(
        [("a", "u"), ("b", "u"), ("c", "v"), ("d", "w")], "ref string, user_id string"
    )
    best = best_per_person(scored, entrants)
    prizes = {r.user_id: (r.ref, r.place, r.prize) for r in award_prizes(rank_entries(best, top=5)).collect()}
    assert prizes == {"v": ("c", 1, 15000), "u": ("a", 2, 10000), "w": ("d", 3, 5000)}


def test_disqualify(spark):
    entries = spark.createDataFrame([(u, f"R{u}") for u in "abcdef"], "user_id string, ref string")
    accounts = spark.createDataFrame(
        [("a", "05 1"), ("b", "05 1"), ("c", "05 2"), ("d", ""), ("e", ""), ("f", "05 3")], "user_id string, contact string"
    )
    notices = spark.createDataFrame(
        [("Rc", D(2024, 1, 1), D(2024, 1, 8)), ("Rd", D(2024, 1, 1), D(2024, 1, 9)), ("Re", D(2024, 1, 1), None)],
        "ref string, notified_at date, corrected_at date",
    )
    blocked = spark.createDataFrame([("f", "relative")], "user_id string, reason string")
    out = disqualify(entries, accounts, notices, blocked, F.lit(D(2024, 1, 5)))
    assert {r.user_id: r.reasons for r in out.collect()} == {
        "a": ["several accounts"], "b": ["several accounts"], "d": ["details not corrected"], "f": ["relative"],
    }


def test_award_deadlines(spark):
    cases = spark.createDataFrame(
        [
            ("x", D(2024, 5, 28), D(2024, 6, 2), D(2024, 7, 1), D(2024, 7, 15), None),
            ("y", D(2024, 5, 1), D(2024, 5, 8), D(2024, 7, 1), D(2024, 7, 16), None),
            ("z", None, None, D(2024, 8, 1), None, None),
        ],
        "ref string, notified_on date, corrected_on date, documents_asked_on date, documents_on date, paid_on date",
    ).withColumn("round", F.lit("r"))
    rounds = spark.createDataFrame([("r", D(2024, 6, 1))], "round string, closes_on date")
    got = {
        r.ref: (r.correct_by, r.correction_overdue, r.forfeited, r.transfer_overdue)
        for r in award_deadlines(cases, rounds, "2024-08-15").collect()
    }
    assert got == {
        "x": (D(2024, 6, 1), True, False, True),
        "y": (D(2024, 5, 8), False, True, False),
        "z": (None, False, False, False),
    }


def test_suggestions_and_rewards(spark):
    schema = "id long, content string, arrived_at timestamp, kind string"
    at = T(2024, 1, 1)
    app = spark.createDataFrame([(2, "tie", at, "idea"), (3, "old", at, "idea"), (4, "bug", at, "bug")], schema)
    mail = spark.createDataFrame([(1, "tie", at, "idea"), (5, "same", at, "idea")], schema)
    chat = spark.createDataFrame([(6, "late", at, "idea"), (7, "bug", T(2024, 1, 2), "idea")], schema)
    roadmap = spark.createDataFrame(
        [("old", T(2023, 12, 31)), ("same", at), ("late", T(2024, 1, 2))], "content string, added_at timestamp"
    )
    out = eligible_suggestions({"app": app, "mail": mail, "chat": chat}, roadmap)
    assert {(r.id, r.channel) for r in out.collect()} == {(1, "mail"), (5, "mail"), (6, "chat")}
    amounts = spark.createDataFrame([(1, 499), (5, 15000), (6, 800)], "id long, amount long")
    releases = spark.createDataFrame([(1, at), (5, at), (5, T(2024, 2, 1)), (6, None)], "id long, released_at timestamp")
    due = {r.id: r.in_range for r in reward_payouts(amounts, releases).collect()}
    assert due == {1: False, 5: True}


def plain_origins(texts, size):
    """Brute force over all pairs of distinct texts."""
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    kept = {k: t for t, k in first.items()}
    runs = {}
    for k, t in kept.items():
        w = t.lower().split()
        runs[k] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    out = {}
    for k in kept:
        owners = Counter()
        for r in runs[k]:
            owner = min(j for j in kept if r in runs[j])
            if owner != k:
                owners[owner] += 1
        source = min(owners, key=lambda o: (-owners[o], o)) if owners else None
        out[k] = (len(runs[k]), sum(owners.values()), source, owners.get(source, 0))
    return out


@pytest.mark.parametrize("rows_per_task", [1000, 1])
def test_copies_against_brute_force(spark, hot, rows_per_task):
    base = "one two three four five six seven eight nine ten".split()
    texts = {i: " ".join(base[i % 4 : 6 + i % 5]) for i in range(40)}
    texts |= {50: "One two, THREE four", 51: "", 52: "alone", 53: "alone"}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    plain = plain_origins({k: t.replace(",", "") for k, t in texts.items() if k != 50} | {50: "one two three four"}, 3)
    with hot(rows_per_task):
        got = {r.k: (r.passages, r.copied, r.source, r.from_source) for r in passage_origins(df, "k", "t", 3).collect()}
        found = find_copies(df, "k", "t", threshold=0.5, size=3)
        exact = {(r.k, r.original) for r in found["exact"].collect()}
        near = {r.k for r in found["near"].collect()}
    assert got == plain
    assert exact == {(k, min(j for j in texts if texts[j] == t)) for k, t in texts.items() if any(texts[j] == t and j < k for j in texts)}
    assert near == {k for k, (n, c, *_) in plain.items() if c and c >= n * 0.5}


def plain_add(day, n, off=()):
    while n > 0:
        day += dt.timedelta(days=1)
        if day.isoweekday() not in (5, 6) and day not in off:
            n -= 1
    return day


def test_business_days(spark):
    days = [D(2024, 2, 25) + dt.timedelta(days=i) for i in range(30)]
    off = [D(2024, 3, 4), D(2024, 3, 10), D(2024, 3, 11), D(2024, 3, 8), D(2024, 3, 17)]
    df = spark.createDataFrame([(d, n) for d in days for n in (1, 2, 5, 14, 15)], "d date, n int")
    rows = df.select(
        "d", "n",
        add_business_days(F.col("d"), F.col("n")).alias("plain"),
        add_business_days_with_holidays(F.col("d"), F.col("n"), off).alias("off"),
        next_business_day(F.col("d")).alias("next"),
    ).collect()
    for r in rows:
        assert r.plain == plain_add(r.d, r.n)
        assert r.off == plain_add(r.d, r.n, off)
        assert r.next == (r.d if r.d.isoweekday() not in (5, 6) else plain_add(r.d, 1))
    pairs = spark.createDataFrame([(a, b) for a in days[:9] for b in days if b >= a], "a date, b date")
    for r in pairs.select("a", "b", business_days_between(F.col("a"), F.col("b")).alias("n")).collect():
        inside = [r.a + dt.timedelta(days=i + 1) for i in range((r.b - r.a).days)]
        assert r.n == sum(d.isoweekday() not in (5, 6) for d in inside)
    zero = spark.createDataFrame([(D(2024, 3, 3),)], "d date").select(add_business_days(F.col("d"), 0)).first()[0]
    assert zero == D(2024, 3, 3)


def test_refund_decisions(spark):
    paid = D(2024, 3, 3)
    last = plain_add(paid, 15)
    payments = spark.createDataFrame([("p", paid), ("q", paid), ("r", paid)], "payment_id string, paid_on date")
    requests = spark.createDataFrame(
        [(1, "p", last), (2, "p", last + dt.timedelta(days=1)), (3, "q", paid), (4, "r", paid), (5, "p", D(2024, 3, 2)), (6, "none", paid)],
        "id int, payment_id string, requested_on date",
    )
    exports = spark.createDataFrame(
        [("q", True, False), ("r", True, True)], "payment_id string, complete boolean, broken boolean"
    )
    got = {r.id: r.decision for r in refund_decision(payments, requests, exports).collect()}
    assert got == {1: "refund", 2: "late", 3: "exported", 4: "refund", 5: "invalid", 6: "unknown_payment"}


def test_late_remedies(spark):
    today = D(2024, 1, 1)
    requests = spark.createDataFrame(
        [
            ("a", "defect", 10000, False), ("b", "outage", 10000, False), ("c", "outage", 10000, False),
            ("d", "duplicate", 20000, None), ("e", "defect", 10000, True), ("f", "unused", 10000, False),
            ("g", "feature_removed", 10000, False),
        ],
        "user_id string, cause string, charged long, violation boolean",
    ).withColumn("requested_on", F.lit(today))
    subs = spark.createDataFrame(
        [(u, today + dt.timedelta(days=100)) for u in "abcdef"] + [("g", D(2023, 1, 1))], "user_id string, expires_on date"
    )
    down = spark.createDataFrame([("b", 8), ("c", 7)], "user_id string, outage_days int")
    got = {r.user_id: (r.remedy, r.amount, r.extension_days) for r in late_remedies(requests, subs, down, 10000).collect()}
    assert got == {
        "a": ("pro_rata", 2740, 0), "b": ("extension_or_pro_rata", 2740, 8), "c": ("none", 0, 0),
        "d": ("difference", 10000, 0), "e": ("none", 0, 0), "f": ("none", 0, 0), "g": ("pro_rata", 0, 0),
    }


def test_charges(spark):
    payments = spark.createDataFrame(
        [("u", 1, D(2024, 1, 1), 10000), ("u", 2, D(2024, 1, 31), 10000), ("u", 3, D(2024, 3, 5), 9000), ("v", 4, D(2024, 1, 1), 10000)],
        "user_id string, payment_id int, paid_on date, amount long",
    )
    got = {r.payment_id: (r.repeated, r.wrong_amount, r.difference) for r in charge_anomalies(payments, 10000).collect()}
    assert got == {2: (True, False, 10000), 3: (False, True, -1000)}


@pytest.mark.parametrize("rows_per_task", [1000, 2])
def test_outages(spark, hot, rows_per_task):
    day, sec = dt.timedelta(days=1), dt.timedelta(seconds=1)
    a, b = T(2024, 1, 1), T(2024, 2, 1)
    log = [
        ("s", a, False), ("s", a + 3 * day, False), ("s", a + 7 * day, False), ("s", a + 8 * day, True),
        ("s", b, False), ("s", b + 7 * day + sec, False), ("s", b + 9 * day, True), ("s", b + 10 * day, False),
        ("o", b, True),
    ]
    with hot(rows_per_task):
        found = outages(spark.createDataFrame(log, "service string, ts timestamp, up boolean"))
        rows = found.collect()
        assert [(r.service, r.reports, r.micros) for r in rows] == [("s", 2, (7 * 86400 + 1) * 1_000_000)]
        ms = lambda t: int(t.timestamp() * 1000)
        subs = spark.createDataFrame(
            [("s", 1, ms(a), ms(b + 2 * day)), ("s", 2, ms(b + 20 * day), ms(b + 30 * day)), ("o", 3, ms(a), ms(b + 9 * day))],
            "service string, id int, starts_ms long, expires_ms long",
        )
        got = {r.id: r.extension_ms for r in extend_for_outage(subs, found).collect()}
    assert got == {1: 2 * 86_400_000, 2: 0, 3: 0}


def year_before(d):
    try:
        return d.replace(year=d.year - 1)
    except ValueError:
        return d.replace(year=d.year - 1, day=28)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dates(D(2019, 1, 1), D(2025, 1, 1)), max_size=25))
def test_paid_in_twelve_months(spark, hot, days):
    days = sorted([*days, D(2024, 2, 29), D(2023, 2, 28), D(2023, 2, 27), D(2024, 2, 29), D(2023, 6, 1), D(2024, 6, 1)])
    rows = [("u", i, dt.datetime.combine(d, dt.time(), dt.timezone.utc), 10**i if i < 9 else i) for i, d in enumerate(days)]
    payments = spark.createDataFrame(rows, "user_id string, payment_id int, paid_at timestamp, amount long")
    plain = {i: sum(a for _, _, t2, a in rows if year_before(t) <= t2 <= t) for _, i, t, _ in rows}
    assert {r.payment_id: r.paid_12_months for r in paid_last_12_months(payments).collect()} == plain
    with hot(4):
        assert {r.payment_id: r.paid_12_months for r in paid_last_12_months(payments).collect()} == plain


def test_notice(spark):
    rows = [
        (1, D(2024, 1, 1), D(2024, 1, 31), None, D(2024, 12, 31)),
        (2, D(2024, 1, 1), D(2024, 1, 30), D(2024, 1, 30), D(2024, 7, 31)),
    ]
    changes = spark.createDataFrame(rows, "id int, notified_on date, effective_on date, leaves_on date, expires_on date")
    got = {r.id: (r.notice_days, r.long_enough, r.refund) for r in notice_audit(changes, 36500).collect()}
    assert got == {1: (30, True, 0), 2: (29, False, 18300)}


def test_response(spark):
    # Riyadh is three hours ahead of UTC; 2024-02-29 was a Thursday.
    rows = [
        ("thu_1659", "general", T(2024, 2, 29, 13, 59)), ("thu_1700", "general", T(2024, 2, 29, 14)),
        ("fri", "refund", T(2024, 3, 1, 9)), ("sun_0859", "technical", T(2024, 3, 3, 5, 59)),
        ("sun_0900", "technical", T(2024, 3, 3, 6)), ("privacy", "privacy", T(2024, 3, 1, 9)),
        ("sat_late", "general", T(2024, 3, 2, 21, 30)), ("other", "spam", T(2024, 3, 3, 6)),
    ]
    requests = spark.createDataFrame(rows, "id string, type string, received_at timestamp")
    got = {r.id: (r.starts_on, r.due_on, r.breached) for r in response_due(requests, "2024-03-05").collect()}
    assert got == {
        "thu_1659": (D(2024, 2, 29), D(2024, 3, 3), True), "thu_1700": (D(2024, 3, 3), D(2024, 3, 4), True),
        "fri": (D(2024, 3, 3), D(2024, 3, 5), False), "sun_0859": (D(2024, 3, 3), D(2024, 3, 4), True),
        "sun_0900": (D(2024, 3, 3), D(2024, 3, 4), True), "privacy": (D(2024, 3, 3), D(2024, 3, 31), False),
        "sat_late": (D(2024, 3, 3), D(2024, 3, 4), True), "other": (D(2024, 3, 3), None, False),
    }
    off = response_due(requests, holidays=[D(2024, 3, 3)]).where("id = 'sun_0900'").first()
    assert (off.starts_on, off.due_on) == (D(2024, 3, 4), D(2024, 3, 5))


def test_timeline(spark):
    r = refund_timeline(spark.createDataFrame([(D(2024, 2, 29),)], "requested_on date")).first()
    assert r.decision_by == plain_add(D(2024, 2, 29), 2)
    assert r.executed_by == plain_add(r.decision_by, 5)
    assert (r.credited_from, r.credited_by) == (plain_add(r.executed_by, 5), plain_add(r.executed_by, 14))


def account_tables(spark):
    make = spark.createDataFrame
    return {
        "users": make([("a",), ("b",), ("c",)], "id string"),
        "app_state": make([("a", "{}"), ("b", "{}")], "user_id string, state string"),
        "subscriptions": make([("a", "active"), ("b", "free")], "user_id string, status string"),
        "award_entrants": make([("a", "R1"), ("b", "R2")], "user_id string, ref string"),
        "award_entries": make([("R1", "x"), ("R2", "y")], "ref string, html string"),
    }


def test_erasure(spark, tmp_path):
    tables = account_tables(spark)
    requests = spark.createDataFrame([("a",), ("c",), ("a",), (None,)], "user_id string")
    left = erase(tables, requests)
    sizes = {n: df.count() for n, df in left.items()}
    assert sizes == {"users": 1, "app_state": 1, "subscriptions": 1, "award_entrants": 1, "award_entries": 1}
    assert [r.ref for r in left["award_entries"].collect()] == ["R2"]
    counts = {r.table: (r.rows, r.left, r.removed) for r in erasure_counts(tables, left).collect()}
    assert counts["users"] == (3, 1, 2) and counts["award_entries"] == (2, 1, 1)
    assert {r.residual for r in erasure_audit(tables, left, requests).collect()} == {0}
    kept = erase(tables, requests, keep_ledger=True)
    assert kept["subscriptions"].count() == 2 and kept["app_state"].count() == 1
    residual = {r.table: r.residual for r in erasure_audit(tables, kept, requests).collect()}
    assert residual["subscriptions"] == 1 and sum(residual.values()) == 1
    paths = write_erasure(tables, requests, str(tmp_path), "s1")
    assert spark.read.parquet(paths["award_entries"]).count() == 1
    with pytest.raises(Exception):
        write_erasure(tables, requests, str(tmp_path), "s1")


def test_overdue(spark):
    rows = [(1, D(2024, 1, 1), None), (2, D(2024, 1, 2), None), (3, D(2023, 1, 1), D(2023, 1, 2))]
    df = spark.createDataFrame(rows, "id int, requested_on date, done_on date")
    assert [r.id for r in overdue_erasures(df, "2024-02-01").collect()] == [1]


def test_chat_requests(spark):
    turns = spark.createDataFrame(
        [(1, 2, "user", "b"), (1, 1, "system", "a"), (2, 1, "user", "x" * 50), (2, 2, "user", "y")],
        "conv_id int, turn int, role string, text string",
    )
    asked = {1: "0", 2: "9000", 3: "5", 4: None}
    limits = spark.createDataFrame(list(asked.items()), "conv_id int, max_tokens string")
    built = build_chat_requests(turns, limits, max_body=40)
    rows = built["requests"].collect()
    assert [(r.conv_id, r.max_tokens, [(m.role, m.content) for m in r.messages]) for r in rows] == [
        (1, 4000.0, [("system", "a"), ("user", "b")])
    ]
    assert sorted(r.turn for r in built["oversize"].collect()) == [1, 2]
    assert sorted(r.conv_id for r in built["empty"].collect()) == [3, 4]
    values = [None, "0", "", "9000", "-5", "abc", " 12.5 ", "NaN"]
    from tallyfold.operators.requests import token_limit

    df = spark.createDataFrame([(v,) for v in values], "v string").select(token_limit(F.col("v")))
    assert [r[0] for r in df.collect()] == [4000, 4000, 4000, 8000, -5, 4000, 12.5, 4000]


def test_image_requests(spark):
    df = spark.createDataFrame(
        [(1, "p", "image/png", "d", None), (2, "", "image/png", "d", "1"), (3, "p", None, "d", "1"), (4, "p", "m", "", "1")],
        "id int, prompt string, mediaType string, imageData string, max_tokens string",
    )
    (row,) = build_image_requests(df).collect()
    image, words = row.messages[0].content
    assert (row.id, row.max_tokens, image.source.media_type, image.source.data, words.text) == (1, 4000.0, "image/png", "d", "p")
    assert words.source is None and image.text is None


def test_oversize_conversations_stay_in_the_result(spark):
    from hashlib import md5

    from tallyfold.operators.requests import summarise_conversations

    turns = spark.createDataFrame(
        [(1, 2, "user", "b"), (1, 1, "system", "a"), (2, 2, "user", "y"), (2, 1, "user", "x" * 50)],
        "conv_id int, turn int, role string, text string",
    )
    limits = spark.createDataFrame([(1, "0"), (2, "9000")], "conv_id int, max_tokens string")
    assert sorted(tuple(r) for r in summarise_conversations(turns, limits, max_body=40).collect()) == [
        (1, 2, "system,user", md5(b"a\nb").hexdigest(), 4000.0),
        (2, 2, "user,user", md5(("x" * 50 + "\ny").encode()).hexdigest(), 8000.0),
    ]
