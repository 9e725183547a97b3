"""Award submissions: gates, normal form, triage, reference numbers and the identity split."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.latest import latest_rows
from ..functions.text import clipped, json_number, lenient_int, string_items, strip_space
from ..session import stored
from .privacy import any_pii

# Limits of a submission.
MAX_BYTES = 4.4 * 1024 * 1024
MIN_CHARS = 500
MIN_STATS = {"evidence": 5, "students": 1, "workPairs": 1}

# Signs of a reference number, none of which is easily mistaken for another.
ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
REF_SIGNS = 6
# Tells the deliveries of one user apart where their times do not.
DELIVERY = "_delivery"


def body_facts(subs: DataFrame) -> DataFrame:
    """Add what the gates and the triage need to know of the wide ``html`` column.

    ``content_length`` (when not declared), ``text_chars`` and ``leaked``. The operators below use
    these columns where present, so that the body itself can stay out of every shuffle.
    """
    facts = {
        "text_chars": F.length(strip_space(F.col("html"))),
        "leaked": any_pii(F.col("html")),
    }
    if "content_length" not in subs.columns:
        facts["content_length"] = F.octet_length("html")
    return subs.withColumns(facts)


def decide_submissions(
    subs: DataFrame,
    rounds: DataFrame,
    max_bytes: float = MAX_BYTES,
    min_chars: int = MIN_CHARS,
    min_stats: Mapping[str, int] = MIN_STATS,
) -> DataFrame:
    """Add ``decision``: the first gate a submission fails, else accepted.

    unauthenticated, not_open, bad_close_date, late, too_large, short, stats, accepted. ``subs``
    has user_id, round, received_at, content_length, html (or its ``body_facts``) and stats (JSON
    text); ``rounds`` has round, open and closes_at (text).
    """
    given = subs.columns
    if "text_chars" not in given:
        subs = body_facts(subs)
    terms = rounds.select("round", F.col("open").alias("_open"), F.col("closes_at").alias("_closes"))
    known = subs.join(terms, "round", "left")
    closes = F.try_to_timestamp(F.col("_closes"))
    enough = F.lit(True)
    for name, least in min_stats.items():
        number = json_number(F.col("stats"), f"$.{name}")
        # NaN sorts above every number in Spark but fails every comparison on the web.
        enough = enough & F.coalesce((number >= least) & ~F.isnan(number), F.lit(False))
    decision = (
        F.when(F.col("user_id").isNull(), "unauthenticated")
        .when(
            ~F.coalesce(F.col("_open"), F.lit(False)) | (F.coalesce("_closes", F.lit("")) == ""),
            "not_open",
        )
        .when(closes.isNull(), "bad_close_date")
        .when(F.col("received_at") > closes, "late")
        .when(F.coalesce("content_length", F.lit(0)) > max_bytes, "too_large")
        .when(F.coalesce("text_chars", F.lit(0)) < min_chars, "short")
        .when(~enough, "stats")
        .otherwise("accepted")
    )
    return known.withColumn("decision", decision).select(*given, "decision")


def normalise_submissions(subs: DataFrame, users: DataFrame) -> DataFrame:
    """Accepted submissions in stored form: cut texts, lenient integers, string-only suspects."""
    accounts = users.select(F.col("id").alias("user_id"), F.col("email").alias("_email"))
    known = subs.join(accounts, "user_id", "left")
    bodies = [c for c in ("html", "text_chars", "leaked", DELIVERY) if c in subs.columns]
    teacher = F.col("teacher")
    email = F.coalesce(F.nullif(teacher["email"], F.lit("")), F.col("_email"))
    return known.select(
        "user_id",
        *[clipped(teacher[c], 200).alias(c) for c in ("name", "school", "region")],
        clipped(teacher["phone"], 40).alias("phone"),
        clipped(email, 200).alias("email"),
        *bodies,
        lenient_int(F.col("replaced")).alias("replaced"),
        lenient_int(F.col("masked")).alias("masked"),
        lenient_int(F.col("imageCount")).alias("image_count"),
        string_items(F.col("suspects")).alias("suspects"),
        F.coalesce("stats", F.lit("{}")).alias("stats"),
        clipped(F.col("appVersion"), 20).alias("app_version"),
        F.col("received_at").alias("submitted_at"),
    )


def triage(
    entries: DataFrame, previous: DataFrame, key: str = "ref", body: str = "html"
) -> DataFrame:
    """Add ``status`` and ``reset``.

    Suspect names or a leaked detail send an entry to review. The fresh status replaces the old
    one, so a resubmission of a judged or disqualified entry goes back; ``reset`` reports that.
    """
    before = previous.select(key, F.col("status").alias("_before"))
    leaked = F.col("leaked") if "leaked" in entries.columns else any_pii(F.col(body))
    review = (F.coalesce(F.size("suspects"), F.lit(0)) > 0) | leaked
    return (
        entries.withColumn("_review", review).join(before, key, "left")
        .withColumns(
            {
                "status": F.when(F.col("_review"), "needs_review").otherwise("received"),
                "reset": F.coalesce(F.col("_before").isin("judged", "disqualified"), F.lit(False)),
            }
        )
        .drop("_before", "_review")
    )


def signs_for(users: int, spare: int = 16, alphabet: str = ALPHABET) -> int:
    """Signs needed to give ``users`` numbers with ``spare`` possible numbers each."""
    return max(1, math.ceil(math.log(max(users, 1) * spare) / math.log(len(alphabet)) - 1e-12))


def candidate_ref(
    user: Column, salt: Column | int, signs: int = REF_SIGNS, alphabet: str = ALPHABET, prefix: str = ""
) -> Column:
    """A repeatable reference number: sign k comes from byte k of md5(user|salt)."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    if not 1 <= signs <= 16:
        raise ValueError("a reference number has 1 to 16 signs")
    digest = F.md5(F.concat_ws("|", user.cast("string"), salt.cast("string")))
    size = len(alphabet)
    letters = [
        F.substring(
            F.lit(alphabet),
            (F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int") % size + 1),
            F.lit(1),
        )
        for k in range(signs)
    ]
    return F.concat(F.lit(prefix), *letters)


def assign_refs(
    users: DataFrame,
    existing: DataFrame,
    salt: int = 0,
    signs: int = REF_SIGNS,
    alphabet: str = ALPHABET,
    prefix: str = "",
    user: str = "user_id",
    rounds: int = 64,
) -> DataFrame:
    """``user``, ``ref``, ``reused``: the earlier reference of a user, else a new unique one.

    New numbers come from a seeded hash, so a retry gives the same ones. Users whose number is
    taken, or who share it with a smaller user id, try again with the next salt; with spare
    numbers each round leaves a small fraction of the one before.
    """
    asked = users.select(user).distinct()
    held = existing.select(user, "ref")
    reused = asked.join(held, user).select(user, "ref", F.lit(True).alias("reused"))
    waiting = stored(asked.join(held.select(user), user, "left_anti"), "waiting")
    left, used = waiting.count(), held.count()
    if left + used > len(alphabet) ** signs:
        raise ValueError(f"{signs} signs cannot number {left + used} users")
    taken, given = held.select("ref"), []
    for turn in range(salt, salt + rounds):
        if left == 0:
            break
        number = candidate_ref(F.col(user), turn, signs, alphabet, prefix).alias("ref")
        tried = waiting.select(user, number).groupBy("ref").agg(F.min(user).alias(user))
        won = stored(tried.join(taken, "ref", "left_anti").select(user, "ref"), "numbers")
        given.append(won)
        taken = taken.unionByName(won.select("ref"))
        waiting = stored(waiting.join(won.select(user), user, "left_anti"), "waiting")
        left = waiting.count()
    if left:
        raise ValueError(f"{left} users without a number after {rounds} rounds; use more signs")
    result = reused
    for won in given:
        result = result.unionByName(won.select(user, "ref", F.lit(False).alias("reused")))
    return result


ENTRANT_COLUMNS = ["user_id", "ref", "name", "school", "region", "phone", "email"]


def split_identity(
    subs: DataFrame,
    identity: Sequence[str] = ENTRANT_COLUMNS,
    ref: str = "ref",
) -> dict[str, DataFrame]:
    """Identity and content as two tables that share the reference number only."""
    if ref not in identity:
        raise ValueError(f"identity columns must include {ref}")
    content = [ref, *[c for c in subs.columns if c not in identity]]
    return {"entrants": subs.select(*identity), "entries": subs.select(*content)}


def reidentify(entries: DataFrame, entrants: DataFrame, ref: str = "ref") -> DataFrame:
    """Rejoin content and identity; only whoever holds the entrants table can do this."""
    return entries.join(entrants, ref)


def active_entries(
    subs: DataFrame, user: str = "user_id", order: Sequence[str] = ("submitted_at",)
) -> DataFrame:
    """The latest submission of each user, exactly one also where times tie or are null (``latest_rows``)."""
    return latest_rows(subs, user, order)


def entry_summary(entries: DataFrame) -> DataFrame:
    """Entries, replaced and masked places and images per status."""
    return entries.groupBy("status").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.col("replaced").cast("long")).alias("replaced"),
        F.sum(F.col("masked").cast("long")).alias("masked"),
        F.sum(F.col("image_count").cast("long")).alias("images"),
        F.count_if(F.size("suspects") > 0).alias("with_suspects"),
    )
