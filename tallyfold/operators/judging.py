"""Scores, ranks, prizes, disqualification, suggestions and the award's deadlines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import OrderedRows, dealt_anew, row_number

# Criteria weights in percent; the tie is broken by impact.
WEIGHTS = {"evidence": 30, "quality": 30, "impact": 25, "layout": 15}
TIE_BREAK = "impact"

# Prize of each place, in whole riyals.
PRIZES = {1: 15_000, 2: 10_000, 3: 5_000, 4: 2_500, 5: 2_500}
PRIZE_TOTAL = 35_000

# Days and reward bounds.
CORRECTION_DAYS = 7
RESULT_DAYS = 30
DOCUMENT_DAYS = 14
TRANSFER_DAYS = 30
REWARD_MIN, REWARD_MAX = 500, 15_000


def weighted_scores(scores: DataFrame, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """``round``, ``ref``, ``score`` (percent weighted, two decimals), ``impact``, ``complete``."""
    weight = F.lit(None).cast("int")
    for criterion, percent in weights.items():
        weight = F.when(F.col("criterion") == criterion, percent).otherwise(weight)
    points = F.sum((F.col("score") * weight).cast("long"))
    return scores.groupBy("round", "ref").agg(
        (points / F.lit(100)).cast("decimal(9,2)").alias("score"),
        F.sum(F.when(F.col("criterion") == TIE_BREAK, F.col("score")).otherwise(0)).alias("impact"),
        (F.count_distinct(F.when(weight.isNotNull(), F.col("criterion"))) == len(weights)).alias("complete"),
    )


def _best_first() -> list[Column]:
    return [F.desc("score"), F.desc("impact"), F.asc("ref")]


def rank_entries(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Add ``place`` within each round: by score, then impact, then reference.

    With ``top`` only that many places are kept; every task then sends on at most ``top`` rows per
    round. The full ranking of a very large round is numbered slice by slice.
    """
    if top is None:
        return OrderedRows(scored, "round", _best_first()).add(place=row_number()).rows()
    window = Window.partitionBy("round").orderBy(*_best_first())
    ranked = scored.withColumn("place", F.row_number().over(window)).where(F.col("place") <= top)
    return ranked.withColumn("place", F.col("place").cast("long"))


def best_per_person(scored: DataFrame, entrants: DataFrame) -> DataFrame:
    """Keep each person's best entry per round, since nobody may hold more than one place."""
    owned = scored.join(entrants.select("ref", "user_id"), "ref")
    # Descending by score and impact, ascending by reference.
    best = F.min_by(
        F.struct(*scored.columns), F.struct(-F.col("score"), -F.col("impact"), F.col("ref"))
    )
    return owned.groupBy("round", "user_id").agg(best.alias("b")).select("user_id", "b.*")


def award_prizes(ranked: DataFrame, prizes: Mapping[int, int] = PRIZES) -> DataFrame:
    """Entries on a prize place, with ``prize``."""
    if prizes is PRIZES and sum(PRIZES.values()) != PRIZE_TOTAL:
        raise ValueError("prizes do not add up to the published total")
    amount = F.lit(None).cast("long")
    for place, value in prizes.items():
        amount = F.when(F.col("place") == place, value).otherwise(amount)
    return ranked.where(F.col("place").isin(list(prizes))).withColumn("prize", amount)


def contact_key(*parts: Column) -> Column:
    """Contact data in one normal form: lower case, without white space and punctuation."""
    clean = [F.regexp_replace(F.lower(p.cast("string")), r"[^\p{L}\p{N}@]+", "") for p in parts]
    return F.concat_ws("|", *clean)


def shared_contacts(accounts: DataFrame, key: str, account: str = "user_id") -> DataFrame:
    """Contact keys used by more than one account, with the number of accounts."""
    pairs = accounts.where(F.col(key) != "").select(key, account).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("accounts")).where(F.col("accounts") > 1)


def disqualify(
    entries: DataFrame,
    accounts: DataFrame,
    notices: DataFrame,
    blocklist: DataFrame,
    asof: Column,
    key: str = "contact",
    closes: Column | None = None,
    copied: DataFrame | None = None,
) -> DataFrame:
    """Entries to disqualify (``user_id``, ``ref``) with their ``reasons``.

    ``accounts``: user_id and contact key; ``notices``: ref, notified_at, corrected_at; ``blocklist``:
    user_id and reason (false identity, staff, relative); ``copied``: ref of entries found to be copied work.
    Details are to be corrected within seven days and before the round ``closes``.
    """
    same = accounts.join(dealt_anew(shared_contacts(accounts, key), key), key, "left_semi")
    several = same.select("user_id").distinct().withColumn("_several", F.lit("several accounts"))
    deadline = F.date_add(F.col("notified_at").cast("date"), CORRECTION_DAYS)
    if closes is not None:
        deadline = F.least(deadline, closes.cast("date"))
    end = F.coalesce(F.col("corrected_at").cast("date"), F.lit(asof).cast("date"))
    late = notices.where(end > deadline).select("ref").distinct()
    late = late.withColumn("_late", F.lit("details not corrected"))
    blocked = blocklist.groupBy("user_id").agg(F.min("reason").alias("_blocked"))
    # Entries are unique per user and reference, so these joins cannot be skewed.
    judged = entries.select("user_id", "ref").join(several, "user_id", "left")
    judged = judged.join(blocked, "user_id", "left").join(late, "ref", "left")
    found = ["_several", "_late", "_blocked"]
    if copied is not None:
        works = copied.select("ref").distinct().withColumn("_copied", F.lit("copied work"))
        judged, found = judged.join(works, "ref", "left"), [*found, "_copied"]
    reasons = F.array_compact(F.array(*found))
    return judged.select("user_id", "ref", reasons.alias("reasons")).where(F.size("reasons") > 0)


def award_deadlines(cases: DataFrame, rounds: DataFrame, asof: Column | str) -> DataFrame:
    """Deadlines of each case and what is overdue at ``asof``.

    ``cases``: round, ref, notified_on, corrected_on, documents_asked_on, documents_on, paid_on;
    ``rounds``: round, closes_on. Documents that come after their deadline forfeit the prize.
    """
    today = F.to_date(F.lit(asof)) if isinstance(asof, str) else asof
    known = cases.join(rounds.select("round", "closes_on"), "round", "left")
    known = known.withColumns(
        {
            # ``least`` skips nulls, but without a notice there is nothing to correct.
            "correct_by": F.when(
                F.col("notified_on").isNotNull(),
                F.least(F.date_add("notified_on", CORRECTION_DAYS), F.col("closes_on")),
            ),
            "results_by": F.date_add("closes_on", RESULT_DAYS),
            "documents_by": F.date_add("documents_asked_on", DOCUMENT_DAYS),
            "transfer_by": F.date_add("documents_on", TRANSFER_DAYS),
        }
    )

    def overdue(done: str, due: str) -> Column:
        return F.coalesce(F.coalesce(F.col(done), today) > F.col(due), F.lit(False))

    forfeited = overdue("documents_on", "documents_by")
    return known.withColumns(
        {
            "correction_overdue": overdue("corrected_on", "correct_by"),
            "forfeited": forfeited,
            "transfer_overdue": ~forfeited & overdue("paid_on", "transfer_by"),
        }
    )


def eligible_suggestions(
    channels: Mapping[str, DataFrame],
    roadmap: DataFrame,
    content: Sequence[str] = ("content",),
) -> DataFrame:
    """Suggestions that may be rewarded: the earliest of each content, from any channel.

    Channels carry id, ``content`` columns, arrived_at and kind; ``roadmap`` carries the content
    columns and added_at. What was planned before it arrived is out, and so is a mere bug report
    or one against policy. The earliest arrival claims the content even when it is out.
    """
    log = None
    for name, df in channels.items():
        one = df.withColumn("channel", F.lit(name))
        log = one if log is None else log.unionByName(one)
    first = F.min_by(
        F.struct("id", "channel", "arrived_at", "kind"), F.struct("arrived_at", "id", "channel")
    )
    claims = log.groupBy(*content).agg(first.alias("f")).select(*content, "f.*")
    planned = roadmap.groupBy(*content).agg(F.min("added_at").alias("_planned"))
    fresh = F.col("_planned").isNull() | (F.col("_planned") >= F.col("arrived_at"))
    return (
        claims.join(planned, list(content), "left")
        .where(fresh & ~F.col("kind").isin("bug", "against_policy"))
        .drop("_planned")
    )


def reward_payouts(suggestions: DataFrame, releases: DataFrame) -> DataFrame:
    """Rewards that are due: released suggestions, with ``in_range`` for the amount.

    ``suggestions``: id, amount; ``releases``: id, released_at. Nothing is due before release.
    """
    out = releases.where(F.col("released_at").isNotNull())
    out = out.groupBy("id").agg(F.min("released_at").alias("released_at"))
    return suggestions.join(out, "id").withColumn(
        "in_range", F.col("amount").between(REWARD_MIN, REWARD_MAX)
    )
