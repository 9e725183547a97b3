"""Who has access at a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIAL_DAYS = 10
DAY_MICROS = 86_400_000_000


def _moment(asof: Column | str) -> Column:
    return F.lit(asof).cast("timestamp") if isinstance(asof, str) else asof


def subscription_valid(asof: Column, policy: str = "code") -> Column:
    """Active with no end or an end later than ``asof``.

    ``published`` follows the refund page instead: a cancelled subscription lasts to its end.
    """
    if policy not in ("code", "published"):
        raise ValueError(f"unknown policy {policy!r}")
    status, ends = F.col("status"), F.col("expires_at")
    valid = (status == "active") & (ends.isNull() | (ends > asof))
    if policy == "published":
        valid = valid | ((status == "cancelled") & (ends > asof))
    return F.coalesce(valid, F.lit(False))


def in_trial(asof: Column, trial_days: int = TRIAL_DAYS) -> Column:
    """Less than ``trial_days`` days, to the microsecond, since the account was created."""
    age = F.unix_micros(asof) - F.unix_micros(F.col("created_at"))
    return F.coalesce(age < trial_days * DAY_MICROS, F.lit(False))


def access_asof(
    users: DataFrame,
    subs: DataFrame,
    asof: Column | str,
    policy: str = "code",
    trial_days: int = TRIAL_DAYS,
    enforce: bool = True,
) -> DataFrame:
    """``user_id``, ``access`` (subscribed, trial or none) and ``allowed`` for every user.

    Both sides are unique per user. With ``enforce`` off everyone is allowed, as in the handlers
    until the flag is set.
    """
    at = _moment(asof)
    state = subs.select("user_id", "status", "expires_at")
    people = users.select(F.col("id").alias("user_id"), "created_at")
    access = (
        F.when(subscription_valid(at, policy), "subscribed")
        .when(in_trial(at, trial_days), "trial")
        .otherwise("none")
    )
    allowed = (F.col("access") != "none") | F.lit(not enforce)
    return (
        people.join(state, "user_id", "left")
        .select("user_id", access.alias("access"))
        .withColumn("allowed", allowed)
    )


def derive_expired(subs: DataFrame, asof: Column | str) -> DataFrame:
    """Subscriptions with ``expired`` in place of an active state that has run out."""
    over = (F.col("status") == "active") & (F.col("expires_at") <= _moment(asof))
    return subs.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))
