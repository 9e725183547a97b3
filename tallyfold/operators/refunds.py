"""Refunds, remedies, charge anomalies, outages and the liability cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import add_business_days
from ..functions.skew import (
    Hot,
    OrderedRows,
    measure,
    previous,
    running_sum,
    split,
)
from ..functions.text import share_half_up

# Fixed values of the refund rules.
REFUND_BUSINESS_DAYS = 15
OUTAGE_DAYS = 7
YEAR_DAYS = 365
NOTICE_DAYS = 30
CAUSE_REMEDY = {
    "defect": "pro_rata",
    "feature_removed": "pro_rata",
    "outage": "extension_or_pro_rata",
    "duplicate": "difference",
    "wrong_amount": "difference",
}


def refund_decision(payments: DataFrame, requests: DataFrame, exports: DataFrame) -> DataFrame:
    """Add ``decision``: unknown_payment, invalid, late, exported or refund.

    ``payments``: payment_id, paid_on; ``requests``: payment_id, requested_on; ``exports``:
    payment_id, complete, broken. A full export ends the right to a refund unless it was broken.
    """
    made = exports.groupBy("payment_id").agg(
        F.coalesce(F.bool_or("complete"), F.lit(False)).alias("_exported"),
        F.coalesce(F.bool_or("broken"), F.lit(False)).alias("_broken"),
    )
    paid = payments.select("payment_id", "paid_on")
    known = requests.join(paid, "payment_id", "left")
    known = known.join(made, "payment_id", "left")
    decision = (
        F.when(F.col("paid_on").isNull(), "unknown_payment")
        .when(F.col("requested_on") < F.col("paid_on"), "invalid")
        .when(F.col("requested_on") > add_business_days(F.col("paid_on"), REFUND_BUSINESS_DAYS), "late")
        .when(
            F.coalesce("_exported", F.lit(False)) & ~F.coalesce("_broken", F.lit(False)), "exported"
        )
        .otherwise("refund")
    )
    return known.withColumn("decision", decision).drop("_exported", "_broken")


def late_remedies(
    requests: DataFrame, subs: DataFrame, outages: DataFrame, price: Column | int
) -> DataFrame:
    """Add ``remedy``, ``amount`` (minor units) and ``extension_days`` to late requests.

    ``requests``: user_id, cause, requested_on, charged, violation; ``subs``: user_id, expires_on;
    ``outages``: user_id, outage_days (longest unbroken outage). Nothing is due after a violation.
    """
    price = (F.lit(price) if isinstance(price, int) else price).cast("long")
    known = requests.join(subs.select("user_id", "expires_on"), "user_id", "left")
    known = known.join(outages.select("user_id", "outage_days"), "user_id", "left")
    remedy = F.lit("none")
    for cause, offered in CAUSE_REMEDY.items():
        remedy = F.when(F.col("cause") == cause, offered).otherwise(remedy)
    long_outage = F.coalesce(F.col("outage_days") > OUTAGE_DAYS, F.lit(False))
    remedy = (
        F.when(F.coalesce("violation", F.lit(False)), "none")
        .when((F.col("cause") == "outage") & ~long_outage, "none")
        .otherwise(remedy)
    )
    days_left = F.greatest(F.datediff("expires_on", "requested_on"), F.lit(0)).cast("long")
    pro_rata = share_half_up(price, F.coalesce(days_left, F.lit(0)), F.lit(YEAR_DAYS).cast("long"))
    named = known.withColumn("remedy", remedy)
    return named.withColumns(
        {
            "amount": F.when(F.col("remedy").isin("pro_rata", "extension_or_pro_rata"), pro_rata)
            .when(F.col("remedy") == "difference", F.greatest(F.col("charged") - price, F.lit(0)))
            .otherwise(F.lit(0))
            .cast("long"),
            "extension_days": F.when(
                F.col("remedy") == "extension_or_pro_rata", F.col("outage_days")
            ).otherwise(F.lit(0)).cast("long"),
        }
    ).drop("outage_days", "expires_on")


def charge_anomalies(
    payments: DataFrame,
    price: Column | int | None = None,
    days: int = 30,
    user: str = "user_id",
    ts: str = "paid_on",
    order: Sequence[str] = ("payment_id",),
) -> DataFrame:
    """Payments that repeat another of the same user within ``days`` or differ from the price.

    Adds ``gap_days``, ``repeated``, ``wrong_amount`` and ``difference`` (amount to give back).
    """
    rows = OrderedRows(payments, user, [ts, *order]).add(_before=previous(F.col(ts))).rows()
    gap = F.datediff(F.col(ts), F.col("_before"))
    repeated = F.coalesce(gap <= days, F.lit(False))
    if price is None:
        wrong, extra = F.lit(False), F.lit(0)
    else:
        price = F.lit(price) if isinstance(price, int) else price
        wrong, extra = F.col("amount") != price, F.col("amount") - price
    return (
        rows.withColumns({"gap_days": gap, "repeated": repeated, "wrong_amount": wrong})
        .withColumn(
            "difference",
            F.when(F.col("repeated"), F.col("amount")).otherwise(extra).cast("long"),
        )
        .drop("_before")
        .where(F.col("repeated") | F.col("wrong_amount"))
    )


def outages(
    status_log: DataFrame,
    min_days: float = OUTAGE_DAYS,
    key: str = "service",
    ts: str = "ts",
    up: str = "up",
    order: Sequence[str] = (),
) -> DataFrame:
    """Unbroken runs of down reports that last longer than ``min_days``.

    A run is a stretch of consecutive down reports; it lasts from its first to its last report.
    """
    scan = OrderedRows(status_log, key, [ts, *order]).add(_before=previous(F.col(up)))
    starts = F.col("_before").isNull() | (F.col("_before") != F.col(up))
    rows = (
        scan.map(lambda df: df.withColumn("_start", starts.cast("long")))
        .add(_run=running_sum(F.col("_start")))
        .rows()
    )
    runs = rows.where(~F.col(up)).groupBy(key, "_run").agg(
        F.min(ts).alias("started_at"),
        F.max(ts).alias("ended_at"),
        F.count(F.lit(1)).alias("reports"),
    )
    return with_length(runs).where(F.col("micros") > int(min_days * 86_400_000_000)).drop("_run")


def with_length(runs: DataFrame) -> DataFrame:
    """Add ``micros``, the length of each run."""

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    return runs.withColumn("micros", micros("ended_at") - micros("started_at"))


def extend_for_outage(subs: DataFrame, found: DataFrame, key: str = "service") -> DataFrame:
    """Add ``extension_ms`` and the extended ``expires_ms`` for outages inside a subscription.

    ``subs``: key, starts_ms, expires_ms; ``found``: key, started_at, ended_at. The time lost until a moment is a running
    total over the edges of a service's outages, so a subscription loses the difference between its end and its start. Each
    asked moment of a service is computed once; no list of outages is gathered. A subscription without a start begins before all
    outages, one without an end loses all that follow its start.
    """
    never = F.lit(1 << 62).cast("long")
    starts, ends = F.coalesce("starts_ms", -never), F.coalesce("expires_ms", never)
    a = F.unix_millis(F.col("started_at").cast("timestamp"))
    b = F.unix_millis(F.col("ended_at").cast("timestamp"))
    one, nothing = F.lit(1).cast("long"), F.lit(0).cast("long")
    # An open outage adds the time since its start, a closed one its length.
    opened = F.struct(a.alias("at"), one.alias("open"), a.alias("since"), nothing.alias("closed"))
    closed = F.struct(b.alias("at"), (-one).alias("open"), (-a).alias("since"), (b - a).alias("closed"))
    edges = found.select(key, F.inline(F.array(opened, closed))).withColumn("asked", F.lit(False))
    moments = subs.select(key, F.explode(F.array(starts, ends)).alias("at")).distinct()
    line = moments.select(key, "at", *[nothing.alias(c) for c in ("open", "since", "closed")], F.lit(True).alias("asked"))
    names = ("open", "since", "closed")
    totals = {f"_{c}": running_sum(F.col(c)) for c in names}
    # At one moment any order of the edges gives the same time lost.
    scan = OrderedRows(line.unionByName(edges), key, ["at", "asked", *names]).add(**totals).rows().where("asked")
    lost = F.col("_closed") + F.when(F.col("_open") == 0, nothing).otherwise(F.col("_open") * F.col("at") - F.col("_since"))
    known = scan.select(key, "at", lost.alias("_lost"))
    first = known.select(key, F.col("at").alias("_from"), F.col("_lost").alias("_before"))
    last = known.select(key, F.col("at").alias("_to"), F.col("_lost").alias("_after"))
    joined = (
        subs.withColumns({"_from": starts, "_to": ends}).join(first, [key, "_from"], "left").join(last, [key, "_to"], "left")
    )
    extension = F.coalesce(F.greatest(F.col("_after") - F.col("_before"), nothing), nothing)
    return (
        joined.withColumn("extension_ms", extension)
        .withColumn("expires_ms", F.col("expires_ms") + F.col("extension_ms"))
        .select(*subs.columns, "extension_ms")
    )


def paid_last_12_months(
    payments: DataFrame,
    user: str = "user_id",
    ts: str = "paid_at",
    amount: str = "amount",
    order: Sequence[str] = ("payment_id",),
) -> DataFrame:
    """Add ``paid_12_months``: paid from twelve months before each payment up to it, inclusive.

    Ordinary users take one range window. For hot users the same sum is a difference of two
    running totals, read off one time line that holds the payments and, for each payment, a marker
    at the lower and at the upper edge of its window; running totals carry from slice to slice.
    """
    hot = measure(payments, user)
    light, heavy = split(payments, user, hot)
    # Column windows take only numeric range bounds; SQL has the month interval.
    year = F.expr(
        f"sum(`{amount}`) over (partition by `{user}` order by `{ts}` "
        "range between interval '12' month preceding and current row)"
    )
    result = light.withColumn("paid_12_months", year)
    if heavy is None:
        return result
    return result.unionByName(_paid_by_difference(heavy, hot, user, ts, amount, order))


def _paid_by_difference(payments, hot, user, ts, amount, order) -> DataFrame:
    when, paid = F.col(ts), F.col(amount).cast("long")
    nothing = F.lit(0).cast("long")
    # Before the payments of the lower edge, the payments, after the payments of the upper edge.
    points = F.array(
        F.struct((when - F.expr("interval '12' month")).alias("at"), F.lit(0).alias("kind"), nothing.alias("add")),
        F.struct(when.alias("at"), F.lit(1).alias("kind"), paid.alias("add")),
        F.struct(when.alias("at"), F.lit(2).alias("kind"), nothing.alias("add")),
    )
    line = payments.withColumn("_p", F.explode(points)).select("*", "_p.*").drop("_p")
    tripled = Hot(hot.values, 3 * hot.rows, hot.limit)
    totals = OrderedRows(line, user, ["at", "kind", ts, *order], tripled)
    edges = totals.add(_total=running_sum(F.col("add"))).rows().where(F.col("kind") != 1)
    signed = F.when(F.col("kind") == 0, -F.col("_total")).otherwise(F.col("_total"))
    return edges.groupBy(*payments.columns).agg(F.sum(signed).alias("paid_12_months"))


def notice_audit(changes: DataFrame, price: Column | int) -> DataFrame:
    """Add ``notice_days``, ``long_enough`` and ``refund`` to notices of changed terms.

    ``changes``: notified_on, effective_on, leaves_on (null for who stays), expires_on. Who leaves
    gets the time left in minor units.
    """
    price = (F.lit(price) if isinstance(price, int) else price).cast("long")
    days = F.datediff("effective_on", "notified_on")
    left = F.greatest(F.datediff("expires_on", "leaves_on"), F.lit(0)).cast("long")
    refund = share_half_up(price, left, F.lit(YEAR_DAYS).cast("long"))
    return changes.withColumns(
        {
            "notice_days": days,
            "long_enough": days >= NOTICE_DAYS,
            "refund": F.when(F.col("leaves_on").isNotNull(), F.coalesce(refund, F.lit(0))).otherwise(F.lit(0)).cast("long"),
        }
    )
