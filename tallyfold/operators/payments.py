"""From payment notices to subscription periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import (
    Hot,
    OrderedRows,
    dealt_anew,
    measure,
    previous,
    row_number,
    running_last,
    running_max,
    running_sum,
)

DAY_MILLIS = 86_400_000
YEAR_DAYS = 365
# The last moment a web client can represent; a payment that would end later fails and changes nothing.
LAST_MILLIS = 8_640_000_000_000_000
LAST_YEAR = 275_760


def _present(text: Column) -> Column:
    return text.isNotNull() & (text.cast("string") != "")


def _nonzero(value: Column) -> Column:
    """Not the number zero; the text "0" is a value."""
    return (F.typeof(value) == "string") | ~value.try_cast("double").eqNullSafe(F.lit(0.0))


def billing_objects(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Payments and invoices as one table, unique by ``object_id``; a payment hides an invoice."""

    def tagged(objects: DataFrame, place: int, name: str) -> DataFrame:
        return objects.select(
            F.col("id").alias("object_id"),
            F.struct(
                F.lit(place).alias("place"), F.lit(name).alias("found_in"), "status", "user_id"
            ).alias("o"),
        )

    both = tagged(payments, 0, "payment").unionByName(tagged(invoices, 1, "invoice"))
    return both.groupBy("object_id").agg(F.min("o").alias("o")).select("object_id", "o.*").drop("place")


def resolve_object(events: DataFrame, payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Add ``found_in``, ``status`` and ``user_id`` of the payment with this id, else the invoice.

    One notice may be redelivered any number of times, so the event side can be skewed.
    """
    return events.join(dealt_anew(billing_objects(payments, invoices), "object_id"), "object_id", "left")


def classify_events(
    events: DataFrame,
    payments: DataFrame,
    invoices: DataFrame,
    subs: DataFrame,
    token: str | None = None,
) -> DataFrame:
    """Add ``found_in``, ``status``, ``user_id`` and ``outcome``; the first failing test decides.

    bad_token, no_id, unverifiable, not_paid, no_user, already, activated. ``already`` compares
    with the reference stored before this batch; ``mark_replays`` decides it for notices in a row.
    The stored reference joins the objects, which are unique by id, before they meet the events.
    """
    stored = subs.select("user_id", F.col("provider_ref").alias("_stored"))
    objects = billing_objects(payments, invoices).join(stored, "user_id", "left")
    known = events.join(objects, "object_id", "left")
    wrong_token = F.lit(False) if not token else ~F.col("secret_token").eqNullSafe(F.lit(token))
    outcome = (
        F.when(wrong_token, "bad_token")
        .when(~(_present(F.col("object_id")) & _nonzero(F.col("object_id"))), "no_id")
        .when(F.col("found_in").isNull(), "unverifiable")
        .when(~F.col("status").eqNullSafe(F.lit("paid")), "not_paid")
        .when(~_present(F.col("user_id")), "no_user")
        .when(F.col("_stored").cast("string") == F.col("object_id").cast("string"), "already")
        .otherwise("activated")
    )
    return known.withColumn("outcome", outcome).drop("_stored")


def suppress_replays(
    events: DataFrame,
    mode: str = "last",
    user: str = "user_id",
    ref: str = "ref",
    order: Sequence[str] = ("received_at", "ref"),
    stored: DataFrame | None = None,
    hot: Hot | None = None,
) -> DataFrame:
    """Drop redeliveries.

    ``last`` only compares with the reference stored last, as the handler does: A,A keeps one and
    A,B,A keeps three. ``all`` keeps the first delivery of each reference. ``stored`` (``user``,
    ``provider_ref``) is the state before these events.
    """
    if mode == "all":
        first = F.min_by(F.struct(*events.columns), F.struct(*order))
        kept = events.groupBy(user, ref).agg(first.alias("first")).select("first.*")
        if stored is None:
            return kept
        seen = stored.select(user, F.col("provider_ref").alias(ref)).where(F.col(ref).isNotNull())
        return kept.join(seen, [user, ref], "left_anti").select(*events.columns)
    if mode != "last":
        raise ValueError(f"unknown mode {mode!r}")
    marked = mark_replays(events, mode, user, ref, order, stored, hot)
    return marked.where(~F.col("repeated")).drop("repeated")


def mark_replays(
    events: DataFrame,
    mode: str = "last",
    user: str = "user_id",
    ref: str = "ref",
    order: Sequence[str] = ("received_at", "ref"),
    stored: DataFrame | None = None,
    hot: Hot | None = None,
) -> DataFrame:
    """Add ``repeated``: whether ``suppress_replays`` drops the row."""
    if mode == "all":
        rows = OrderedRows(events, [user, ref], order).add(_n=row_number()).rows()
        repeated = F.col("_n") > 1
        if stored is not None:
            known = stored.select(user, F.col("provider_ref").alias(ref), F.lit(True).alias("_known"))
            rows = rows.join(known.where(F.col(ref).isNotNull()), [user, ref], "left")
            repeated = repeated | F.col("_known").isNotNull()
        return rows.select(*events.columns, repeated.alias("repeated"))
    hot = hot or measure(events, user)
    running = {"_before": previous(F.col(ref)), "_n": row_number()}
    rows = OrderedRows(events, user, order, hot).add(**running).rows()
    before = F.col("_before")
    if stored is not None:
        known = stored.select(user, F.col("provider_ref").alias("_stored"))
        rows = rows.join(known, user, "left")
        before = F.when(F.col("_n") == 1, F.col("_stored")).otherwise(before)
    return rows.select(*events.columns, before.eqNullSafe(F.col(ref)).alias("repeated"))


def stack_periods(
    paid: DataFrame,
    period: Column | int = YEAR_DAYS,
    year: str = "days365",
    user: str = "user_id",
    ts: str = "paid_at",
    order: Sequence[str] = ("ref",),
    current: DataFrame | None = None,
    hot: Hot | None = None,
) -> DataFrame:
    """Add ``expires_ms`` and ``expires_at``: each payment extends max(its time, end so far).

    The fold ``end = max(t, end) + p`` has a closed form over the running sum S of periods:
    ``end_n = max over i <= n of (t_i - S_(i-1)) + S_n``, so it needs a running sum and a running
    maximum only. ``year='calendar'`` adds whole Gregorian years instead; ``t + 1 year`` is never
    29 February, so it can be moved by whole years without loss and the same form applies to year numbers.
    ``expires_at`` is null where the end is past ``LAST_MILLIS``: such a payment has failed, and so have the later ones of
    its user, as periods of one length only move the end on. ``activate`` and ``latest_periods`` leave them out.
    ``current`` (``user``, ``expires_at``) are the ends before these payments.
    """
    scan_order = [ts, *order]
    kept = [*paid.columns]
    hot = hot or measure(paid, user)
    if current is not None:
        ends = current.select(user, F.col("expires_at").alias("_current"))
        paid = paid.join(ends, user, "left")
    else:
        paid = paid.withColumn("_current", F.lit(None).cast("timestamp"))
    if year == "calendar":
        return _stack_calendar_years(paid, user, ts, scan_order, kept, hot)
    if year != "days365":
        raise ValueError(f"unknown year {year!r}")
    days = F.lit(period) if isinstance(period, int) else period
    paid = paid.withColumns(
        {"_p": days.cast("long") * DAY_MILLIS, "_t": F.unix_millis(F.col(ts).cast("timestamp"))}
    )
    start = F.greatest(F.col("_t"), F.unix_millis("_current"))
    rows = (
        OrderedRows(paid, user, scan_order, hot)
        .add(_s=running_sum(F.col("_p")))
        .map(lambda df: df.withColumn("_lead", start - (F.col("_s") - F.col("_p"))))
        .add(_peak=running_max(F.col("_lead")))
        .rows()
    )
    ends_ms = F.col("_peak") + F.col("_s")
    return rows.withColumn("expires_ms", ends_ms).select(*kept, "expires_ms", _as_moment())


def _as_moment() -> Column:
    ms = F.col("expires_ms")
    return F.when(ms <= LAST_MILLIS, F.timestamp_millis(F.least(ms, F.lit(LAST_MILLIS)))).alias(
        "expires_at"
    )


def _stack_calendar_years(paid, user, ts, order, kept, hot) -> DataFrame:
    start = F.greatest(F.col(ts).cast("timestamp"), F.col("_current"))
    first = start + F.make_ym_interval(F.lit(1))
    lead = F.struct(
        (F.year(first) - (F.col("_n") - 1)).alias("year"),
        F.month(first).alias("month"),
        F.day(first).alias("day"),
        (F.unix_micros(first) - F.unix_micros(F.date_trunc("day", first))).alias("micros"),
    )
    rows = (
        OrderedRows(paid, user, order, hot)
        .add(_n=row_number())
        .map(lambda df: df.withColumn("_lead", lead))
        .add(_peak=running_max(F.col("_lead")))
        .rows()
    )
    # The year after the last one is past LAST_MILLIS and still a timestamp.
    year = F.least(F.col("_peak.year") + F.col("_n") - 1, F.lit(LAST_YEAR + 1)).cast("int")
    zero = F.lit(0)
    midnight = F.make_timestamp(year, F.col("_peak.month"), F.col("_peak.day"), zero, zero, zero)
    ends = F.timestamp_micros(F.unix_micros(midnight) + F.col("_peak.micros"))
    return rows.withColumn("_end", ends).select(
        *kept,
        F.unix_millis("_end").alias("expires_ms"),
        F.when(F.unix_millis("_end") <= LAST_MILLIS, F.col("_end")).alias("expires_at"),
    )


def latest_periods(stacked: DataFrame, user: str = "user_id") -> DataFrame:
    """The end of each user's subscription; ends only ever grow, so the last is the largest that did not fail."""
    return stacked.where(F.col("expires_at").isNotNull()).groupBy(user).agg(
        F.max("expires_ms").alias("expires_ms"), F.max("expires_at").alias("expires_at")
    )


def upsert_latest(
    target: DataFrame, changes: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """The target after applying each key's last change; only ``cols`` are overwritten.

    Returns the complete new state, to be written as a new snapshot.
    """
    last = changes.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_new"),
    )
    merged = target.join(last, key, "full_outer")
    changed = F.col("_new").isNotNull()
    return merged.select(
        *[
            F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            if c in cols
            else F.col(c)
            for c in target.columns
        ]
    )


def activate(
    subs: DataFrame,
    paid: DataFrame,
    plan: str = "annual",
    provider: str | None = None,
    fresh: bool = False,
    **stack,
) -> DataFrame:
    """Subscriptions after stacking ``paid`` (user_id, ref, paid_at) on their current ends.

    ``fresh`` says that ``subs`` are default rows, which have no ends to look up.
    """
    stacked = stack_periods(paid, current=None if fresh else subs, **stack)
    changes = stacked.where(F.col("expires_at").isNotNull()).select(
        "user_id",
        F.lit("active").alias("status"),
        F.lit(plan).alias("plan"),
        "expires_at",
        F.lit(provider).cast("string").alias("provider"),
        F.col("ref").cast("string").alias("provider_ref"),
        F.col("paid_at").cast("timestamp").alias("updated_at"),
        "ref",
    )
    written = ["status", "plan", "expires_at", "provider", "provider_ref", "updated_at"]
    return upsert_latest(subs, changes, "user_id", ["updated_at", "ref"], written)


def invoice_requests(
    users: DataFrame,
    price: Column | int = 100,
    currency: str = "SAR",
    description: str = "",
    origin: str | None = None,
) -> DataFrame:
    """One invoice request per user, bound to the user so that the payment can be matched."""
    price = F.lit(price) if isinstance(price, int) else price
    email = F.coalesce(F.col("email"), F.lit(""))
    back = F.lit(f"{origin}/?paid=1") if origin else F.lit(None).cast("string")
    return users.select(
        (price * 100).cast("long").alias("amount"),
        F.lit(currency).alias("currency"),
        F.concat(F.lit(description), email).alias("description"),
        back.alias("callback_url"),
        F.struct(F.col("id").alias("user_id"), email.alias("email")).alias("metadata"),
    )


def price_asof(
    renewals: DataFrame,
    price_versions: DataFrame,
    key: str,
    ts: str = "ts",
    price: str = "price",
    order: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Add to each renewal the latest price of its ``key`` set before it (or at it, not strict).

    Renewals and prices are put in one time line and the last price is carried forward, so a key
    shared by very many renewals is carried from slice to slice rather than gathered.
    """
    columns = renewals.columns
    asked = renewals.withColumns(
        {"_kind": F.lit(0 if strict else 1), "_price": F.lit(None).cast(price_versions.schema[price].dataType)}
    )
    given = price_versions.select(
        key, ts, F.lit(1 if strict else 0).alias("_kind"), F.col(price).alias("_price")
    )
    line = asked.unionByName(given, allowMissingColumns=True)
    rows = (
        OrderedRows(line, key, [ts, "_kind", "_price", *order])
        .add(_at=running_last(F.col("_price")))
        .rows()
    )
    return rows.where(F.col("_kind") == (0 if strict else 1)).select(
        *columns, F.col("_at").alias(price)
    )
