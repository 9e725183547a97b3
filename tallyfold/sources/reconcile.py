"""Comparison of an export with its source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_totals(df: DataFrame) -> DataFrame:
    """Number of rows and their size as JSON."""
    size = F.octet_length(F.to_json(F.struct(*df.columns))).cast("long")
    return df.select(size.alias("bytes")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )


def export_report(objects: Mapping[str, DataFrame]) -> DataFrame:
    """object, rows and bytes of every object of an export, in one result."""
    totals = [export_totals(df).select(F.lit(name).alias("object"), "rows", "bytes") for name, df in objects.items()]
    return reduce(DataFrame.unionByName, totals)


def reconcile(source: DataFrame, exported: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that differ, with ``status`` missing, extra or changed.

    Both sides are reduced to a row hash and folded per key in one aggregation, so repeated keys
    are compared as sets of rows and need no join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = sorted(source.columns)

    def side(df: DataFrame, sign: int) -> DataFrame:
        # The hash skips nulls, so which columns are null is hashed as well.
        digest = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])
        return df.select(
            *keys,
            digest.cast("decimal(38,0)").alias("digest"),
            F.lit(sign).alias("sign"),
        )

    folded = (
        side(source, 1)
        .unionByName(side(exported, -1))
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("sign") > 0, 1).otherwise(0)).alias("in_source"),
            F.sum(F.when(F.col("sign") < 0, 1).otherwise(0)).alias("in_export"),
            F.sum(F.col("digest") * F.col("sign")).alias("balance"),
        )
    )
    status = (
        F.when(F.col("in_export") == 0, "missing")
        .when(F.col("in_source") == 0, "extra")
        .when((F.col("balance") != 0) | (F.col("in_source") != F.col("in_export")), "changed")
    )
    return folded.select(*keys, status.alias("status")).where(F.col("status").isNotNull())
