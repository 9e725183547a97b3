"""Cases in which rows, ends or names were lost or doubled."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tallyfold.functions.text import PII_PATTERNS
from tallyfold.operators.payments import activate, classify_events, latest_periods, stack_periods
from tallyfold.operators.privacy import mask_pii, pseudonymise, scan_pii
from tallyfold.operators.state import latest_documents
from tallyfold.operators.submissions import active_entries
from tallyfold.plans.flows import free_subscriptions, process_notices

T0 = dt.datetime(2024, 1, 1)


def test_address_search_equals_the_plain_pattern(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab1.-@ 0512345678\u0639", k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["1234567890foo@bar.com", "a@b.com.x@d.org", "a@b.cc@d.org", "@x.yy", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    either = "|".join(f"(?:{p})" for p in PII_PATTERNS.values())
    plain = df.select("id", F.col("text").rlike(PII_PATTERNS["email"]).alias("has"), F.regexp_replace("text", either, "***").alias("t"))
    expected = {r.id: (bool(r.has), r.t) for r in plain.collect()}
    flags = {r.id: r.has_email for r in scan_pii(df, "text").collect()}
    masked = {r.id: r.text for r in mask_pii(df, "text").collect()}
    assert {i: (flags[i], masked[i]) for i in flags} == expected


def test_address_search_is_linear(spark):
    df = spark.createDataFrame([("a" * 1_000_000 + " @",)], "text string")
    begin = time.time()
    assert not scan_pii(df, "text").first().has_email
    assert mask_pii(df, "text").first().masked == 0
    assert time.time() - begin < 20


def test_latest_row_with_ties_and_nulls(spark):
    rows = [(1, T0, "a"), (1, T0, "b"), (1, T0, "b"), (2, None, "c"), (2, None, "d"), (3, None, "e"), (3, T0, "f"), (None, T0, "g")]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, state string")
    got = {r.user_id: (r.state, r.version) for r in latest_documents(df).collect()}
    assert set(got) == {1, 2, 3} and got[3] == ("f", 2) and got[1][1] == 3 and got[2][0] in "cd"
    assert sorted(r.user_id for r in active_entries(df, order=("ts",)).collect()) == [1, 2, 3]


def test_far_ends_fail_and_keep_the_row(spark):
    paid = spark.range(300_000).select(F.lit(1).alias("user_id"), "id", F.col("id").alias("ref"), F.lit(T0).alias("paid_at"))
    users = spark.createDataFrame([(1,)], "id int")
    for year in ("days365", "calendar"):
        kept = latest_periods(stack_periods(paid, year=year)).select(F.unix_millis("expires_at")).first()
        done = activate(free_subscriptions(users), paid, fresh=True, year=year)
        row = done.select("status", F.unix_millis("expires_at").alias("ms"), F.year("expires_at").alias("year")).first()
        assert row.status == "active" and row.ms == kept[0]
        assert 275_759 <= row.year <= 275_760


def test_notices_in_any_split(spark):
    def run(subs, refs, day):
        events = [(r, "t", T0 + dt.timedelta(days=day + i)) for i, r in enumerate(refs)]
        e = spark.createDataFrame(events, "object_id string, secret_token string, received_at timestamp")
        return process_notices(e, payments, payments.limit(0), subs)

    payments = spark.createDataFrame([(r, "paid", 1) for r in "AB"], "id string, status string, user_id int")
    empty = free_subscriptions(spark.createDataFrame([(1,)], "id int"))
    one = run(empty, "ABAA", 0)
    assert sorted(r.outcome for r in one["outcomes"].collect()) == ["activated"] * 3 + ["already"]
    two = run(run(empty, "A", 0)["subscriptions"], "BAA", 1)
    end = one["subscriptions"].first().expires_at
    assert end == T0 + dt.timedelta(days=3 * 365) == two["subscriptions"].first().expires_at


def test_names_of_many_words(spark):
    docs = spark.createDataFrame([(1, 1, "here is Abu Bakr bin Ali bin Omar, and Abu Bakr.")], "k int, owner int, text string")
    roster = spark.createDataFrame([(1, "Abu Bakr bin Ali bin Omar")], "owner int, name string")
    row = pseudonymise(docs, roster, "owner", ["k"])["docs"].first()
    assert row.replaced == 1 and "Omar" not in row.text and row.text.endswith("and Abu Bakr.")


def test_object_id_zero_counts_as_missing(spark):
    """The number 0 is no id, as in the handler; the text "0" is one, and an empty text is none."""
    nothing = spark.createDataFrame([], "id string, status string, user_id string")
    stored = spark.createDataFrame([], "user_id string, provider_ref string")

    def outcomes(ids, kind):
        events = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], f"n int, object_id {kind}")
        objects = nothing.withColumn("id", F.col("id").cast(kind))
        done = classify_events(events, objects, objects, stored)
        return [r.outcome for r in done.orderBy("n").collect()]

    assert outcomes([0, 7, None], "long") == ["no_id", "unverifiable", "no_id"]
    assert outcomes([0.0, 0.5], "double") == ["no_id", "unverifiable"]
    assert outcomes(["0", "", "a", None], "string") == ["unverifiable", "no_id", "unverifiable", "no_id"]
