"""When an answer or a refund is due."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import add_business_days_with_holidays, is_business_day

# Answer times (number, unit) and opening hours.
RESPONSE = {
    "general": (1, "business"),
    "technical": (1, "business"),
    "refund": (2, "business"),
    "privacy": (30, "calendar"),
}
ZONE = "Asia/Riyadh"
OPENS, CLOSES = 9, 17

# Business days for decision, execution and the bank (earliest, latest).
DECISION_DAYS, EXECUTION_DAYS, BANK_DAYS = 2, 5, (5, 14)


def response_due(
    requests: DataFrame,
    asof: Column | str | None = None,
    response: Mapping[str, tuple[int, str]] = RESPONSE,
    holidays: Sequence[dt.date] = (),
    zone: str = ZONE,
) -> DataFrame:
    """Add ``starts_on``, ``due_on`` and ``breached`` to requests (type, received_at, answered_at).

    An arrival before opening counts from that day; one after closing, or on a day off, from the
    next working day. Privacy requests run in calendar days from their arrival.
    """
    local = F.from_utc_timestamp(F.col("received_at").cast("timestamp"), zone)
    day = local.cast("date")
    open_day = is_business_day(day)
    if holidays:
        open_day = open_day & ~day.isin(list(holidays))
    starts = F.when(open_day & (F.hour(local) < CLOSES), day).otherwise(
        add_business_days_with_holidays(day, 1, holidays)
    )
    due = F.lit(None).cast("date")
    for kind, (number, unit) in response.items():
        end = (
            add_business_days_with_holidays(F.col("starts_on"), number, holidays)
            if unit == "business"
            else F.date_add(day, number)
        )
        due = F.when(F.col("type") == kind, end).otherwise(due)
    rows = requests.withColumn("starts_on", starts).withColumn("due_on", due)
    if "answered_at" in requests.columns:
        answered = F.from_utc_timestamp(F.col("answered_at").cast("timestamp"), zone).cast("date")
    else:
        answered = F.lit(None).cast("date")
    today = F.to_date(F.lit(asof)) if isinstance(asof, str) else asof
    seen = answered if today is None else F.coalesce(answered, today)
    return rows.withColumn("breached", F.coalesce(seen > F.col("due_on"), F.lit(False)))


def refund_timeline(
    requests: DataFrame, day: str = "requested_on", holidays: Sequence[dt.date] = ()
) -> DataFrame:
    """Add the latest days of decision and execution and the bank's earliest and latest day."""

    def after(start: str, n: int) -> Column:
        return add_business_days_with_holidays(F.col(start), n, holidays)

    return (
        requests.withColumn("decision_by", after(day, DECISION_DAYS))
        .withColumn("executed_by", after("decision_by", EXECUTION_DAYS))
        .withColumn("credited_from", after("executed_by", BANK_DAYS[0]))
        .withColumn("credited_by", after("executed_by", BANK_DAYS[1]))
    )
