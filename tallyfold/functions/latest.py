"""The latest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(df: DataFrame) -> Column:
    """A hash of the row, over all columns whose type has one."""
    return F.xxhash64(*[f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")])


def latest_rows(rows: DataFrame, key: str, order: Sequence[str], **summary: Column) -> DataFrame:
    """Exactly one row per non-null key: the largest by ``order``, with the aggregates ``summary`` of all its rows.

    A null stands before every value; among rows equal in ``order`` the larger hash of the whole row wins, and equal rows
    count once. The aggregate carries the winner's whole row, and each map task gives away only its own winner of each key: one
    exchange, and at most one row per key and map task in it, however many rows a key has.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], row_hash(rows).alias("tie"))
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]
    last = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max_by(F.struct(*own), place).alias("_last"), *[value.alias(name) for name, value in summary.items()]
    )
    return last.select(*[F.col(f"_last.c{i}").alias(c) for i, c in enumerate(rows.columns)], *summary)
