"""The two long lifecycles, each as one chain of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.latest import row_hash
from ..functions.skew import measure
from ..operators.payments import activate, classify_events, mark_replays, suppress_replays
from ..operators.state import bootstrap_rows
from ..operators.submissions import (
    DELIVERY,
    ENTRANT_COLUMNS,
    active_entries,
    assign_refs,
    body_facts,
    decide_submissions,
    normalise_submissions,
    split_identity,
    triage,
)
from ..session import stored

EMPTY_SUBSCRIPTION = {
    "status": lambda: F.lit("free"),
    "plan": lambda: F.lit(None).cast("string"),
    "expires_at": lambda: F.lit(None).cast("timestamp"),
    "provider": lambda: F.lit(None).cast("string"),
    "provider_ref": lambda: F.lit(None).cast("string"),
    "updated_at": lambda: F.lit(None).cast("timestamp"),
}


def free_subscriptions(users: DataFrame) -> DataFrame:
    """The default subscription row of every user."""
    return users.select(
        F.col("id").alias("user_id"), *[v().alias(n) for n, v in EMPTY_SUBSCRIPTION.items()]
    )


def payment_state(users: DataFrame, paid: DataFrame, dedupe: str = "last") -> DataFrame:
    """Subscriptions after ``paid`` (user_id, ref, paid_at), from default rows."""
    hot = measure(paid, "user_id")
    kept = suppress_replays(paid, mode=dedupe, order=("paid_at", "ref"), hot=hot)
    return activate(free_subscriptions(users), kept, fresh=True, hot=hot)


def process_notices(
    events: DataFrame,
    payments: DataFrame,
    invoices: DataFrame,
    subs: DataFrame,
    token: str | None = None,
    dedupe: str = "last",
) -> dict[str, DataFrame]:
    """Notices to new subscriptions: resolve, classify, drop replays, stack periods, upsert.

    Whether a paid notice is ``already`` known depends on the notice before it, in this batch or stored, so any split
    into batches gives the same subscriptions.
    """
    classified = classify_events(events, payments, invoices, subs, token)
    is_paid = F.col("outcome").isin("activated", "already")
    paid = classified.where(is_paid)
    kind = paid.schema["object_id"].dataType
    stored = subs.select("user_id", F.col("provider_ref").cast(kind).alias("provider_ref"))
    hot = measure(paid, "user_id")
    order = ("received_at", "object_id")
    marked = mark_replays(paid, dedupe, ref="object_id", order=order, stored=stored, hot=hot)
    decided = marked.withColumn("outcome", F.when(F.col("repeated"), "already").otherwise("activated"))
    kept = marked.where(~F.col("repeated")).select(
        "user_id", F.col("object_id").alias("ref"), F.col("received_at").alias("paid_at")
    )
    outcomes = classified.where(~is_paid).unionByName(decided.drop("repeated"))
    return {"outcomes": outcomes, "subscriptions": activate(subs, kept, hot=hot)}


def process_submissions(
    subs: DataFrame,
    rounds: DataFrame,
    users: DataFrame,
    existing: DataFrame,
    previous: DataFrame,
    decide: dict | None = None,
    refs: dict | None = None,
) -> dict[str, DataFrame]:
    """Submissions to stored tables: decide, keep the latest, normalise, number, triage, split.

    ``existing`` (user_id, ref) and ``previous`` (ref, status) are the stored state. All steps work
    on narrow rows; the bodies meet the final rows in one join by user and delivery. The narrow rows
    are stored once, because the numbering and both tables read them.
    """
    subs = subs.withColumn(DELIVERY, row_hash(subs))
    decided = decide_submissions(body_facts(subs).drop("html"), rounds, **(decide or {}))
    accepted = decided.where("decision = 'accepted'")
    latest = active_entries(accepted, order=("received_at", DELIVERY))
    normal = stored(normalise_submissions(latest, users), "accepted")
    numbers = assign_refs(normal.select("user_id"), existing, **(refs or {})).select("user_id", "ref")
    triaged = triage(normal.join(numbers, "user_id"), previous)
    bodies = subs.select("user_id", DELIVERY, "html")
    complete = triaged.drop("text_chars", "leaked").join(bodies, ["user_id", DELIVERY])
    # The same delivery twice; these keys are those of the join, so nothing moves again.
    complete = complete.dropDuplicates(["user_id", DELIVERY])
    tables = split_identity(complete.drop("reset", DELIVERY), ENTRANT_COLUMNS)
    return {"decided": decided.drop(DELIVERY), "triaged": triaged.drop(DELIVERY), **tables}
