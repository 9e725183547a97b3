"""Copied work: exact copies, and entries made largely of passages first seen in earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import OrderedRows, dealt_anew, expected, running_min
from ..functions.text import let, word_runs, words
from ..session import stored


# Very common passages are looked for in one of so many parts of the entries; they take another plan with the same result.
_PARTS = 64


def text_digests(entries: DataFrame, key: str, body: str) -> DataFrame:
    """``key`` and ``digest`` of the text, stored so that texts are read once for all that follows."""
    return stored(entries.select(key, F.unhex(F.sha2(body, 256)).alias("digest")), "digests")


def exact_copies(
    entries: DataFrame, key: str, body: str, digests: DataFrame | None = None
) -> DataFrame:
    """``key``, ``original``: every later entry with the same text as an earlier (smaller) key."""
    digests = text_digests(entries, key, body) if digests is None else digests
    firsts = digests.groupBy("digest").agg(
        F.min(key).alias("original"), F.count(F.lit(1)).alias("n")
    )
    repeated = firsts.where("n > 1").select("digest", "original")
    return digests.join(dealt_anew(repeated, "digest"), "digest").where(F.col(key) != F.col("original")).select(key, "original")


def _passages(text: Column, size: int) -> Column:
    """Distinct hashes of all runs of ``size`` words, ignoring case and punctuation."""
    nothing = F.array().cast("array<string>")

    def hashes(items: Column) -> Column:
        runs = word_runs(items, size, lambda run: F.md5(F.array_join(run, " ")))
        return F.when(F.size(items) > 0, F.array_distinct(runs)).otherwise(nothing)

    return let(words(F.lower(text)), hashes)


def passage_origins(
    entries: DataFrame, key: str, body: str, size: int = 8, digests: DataFrame | None = None
) -> DataFrame:
    """``key``, ``passages``, ``copied``, ``source``, ``from_source`` for each distinct text.

    A passage belongs to the smallest key that has it. ``copied`` counts an entry's passages that
    belong to another entry, and ``source`` is the entry most of them belong to. Every passage is
    compared with its one owner, so work grows with the passages and no pairs are formed, however
    many entries share them.
    """
    digests = text_digests(entries, key, body) if digests is None else digests
    firsts = digests.groupBy("digest").agg(F.min(key).alias(key)).select(key)
    # Texts are cut where they are read. A later copy of a text owns no passage, as the first one has a smaller key, so
    # copies need not be dropped before the passages are shared out, and no text is ever shuffled.
    hashed = entries.select(key, _passages(F.col(body), size).alias("all"))
    exploded = hashed.select(key, F.size("all").cast("long").alias("n"), F.posexplode_outer("all").alias("at", "hex"))
    # One row of each entry carries the number of its passages. An entry without any has a row of its own, dealt by its key.
    rows = exploded.select(
        F.coalesce(F.unhex("hex"), F.col(key).cast("string").cast("binary")).alias("passage"),
        key,
        F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("n")).alias("passages"),
    )
    # Passages move once. In the order of the keys the first that has a passage is its owner.
    part = entries.where(F.pmod(F.xxhash64(key), F.lit(_PARTS)) == 0)
    common = part.select(F.explode(_passages(F.col(body), size)).alias("hex")).select(F.unhex("hex").alias("passage"))
    ordered = OrderedRows(rows, "passage", [F.col(key).asc_nulls_last()], expected(common, "passage", _PARTS))
    owned = ordered.add(owner=running_min(F.when(F.coalesce("passages", F.lit(1)) > 0, F.col(key)))).rows()
    foreign = F.coalesce(F.col("owner") != F.col(key), F.lit(False)) & (F.coalesce("passages", F.lit(1)) > 0)
    owned = owned.withColumn("foreign", foreign).where("foreign or passages is not null")
    taken = owned.groupBy(key, "owner").agg(
        F.count_if("foreign").alias("shared"), F.max("passages").alias("passages")
    )
    # The source with most passages; among equals the smallest key.
    used = F.col("shared") > 0
    per_entry = taken.groupBy(key).agg(
        F.max("passages").alias("passages"),
        F.sum("shared").alias("copied"),
        F.min_by(F.when(used, F.col("owner")), F.when(used, F.struct(-F.col("shared"), F.col("owner")))).alias("source"),
        F.max("shared").alias("from_source"),
    )
    return per_entry.join(firsts, key, "left_semi").select(key, "passages", "copied", "source", "from_source")


def find_copies(
    entries: DataFrame, key: str, body: str, threshold: float = 0.5, size: int = 8
) -> dict[str, DataFrame]:
    """``exact`` copies, and ``near``: distinct texts with at least ``threshold`` copied passages."""
    digests = text_digests(entries, key, body)
    origins = passage_origins(entries, key, body, size, digests)
    near = origins.where(F.col("copied") >= F.col("passages") * threshold).where("copied > 0")
    return {"exact": exact_copies(entries, key, body, digests), "near": near}
