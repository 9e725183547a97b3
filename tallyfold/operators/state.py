"""Versioned state documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.latest import latest_rows
from ..functions.skew import OrderedRows, dealt_anew, previous, row_number


def replay_versions(
    changes: DataFrame, key: str = "user_id", order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Number the writes of each document: 1 for the insert, one more for each update."""
    return OrderedRows(changes, key, order).add(version=row_number()).rows()


def latest_documents(
    changes: DataFrame, key: str = "user_id", order: Sequence[str] = ("ts",), body: str = "state"
) -> DataFrame:
    """The stored row after all writes: last body, version, first and last write time.

    The last write always wins; no version is ever refused. Writes without a time come first, and of
    writes at one instant one wins (``latest_rows``).
    """
    stamp = order[0]
    last = latest_rows(
        changes.select(key, *order, body),
        key,
        order,
        version=F.count(F.lit(1)),
        created_at=F.min(stamp),
        updated_at=F.max(stamp),
    )
    return last.select(key, body, "version", "created_at", "updated_at")


def bootstrap_rows(
    users: DataFrame, table: DataFrame, defaults: Mapping[str, Column], key: str = "user_id"
) -> DataFrame:
    """The table with a default row for every user who has none; existing rows stay."""
    new = users.select(key).distinct().join(table.select(key).distinct(), key, "left_anti")
    rows = new.select(key, *[value.alias(name) for name, value in defaults.items()])
    return table.unionByName(rows, allowMissingColumns=True)


def stale_writes(
    changes: DataFrame,
    key: str = "user_id",
    device: str = "device",
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Add ``version`` and ``stale``: another device wrote since this device's last write.

    A write follows its own device's last write exactly when the write before it came from the
    same device, so only the previous row and the first write of each device are needed.
    """
    running = {"version": row_number(), "_before": previous(F.col(device))}
    rows = OrderedRows(changes, key, order).add(**running).rows()
    first = changes.groupBy(key, device).agg(F.min(F.struct(*order)).alias("_start"))
    pair = [key, device]
    known = rows.join(dealt_anew(first, pair), pair, "left")
    stale = (F.struct(*order) > F.col("_start")) & ~F.col("_before").eqNullSafe(F.col(device))
    return known.withColumn("stale", stale).drop("_before", "_start")


def profile_state(
    df: DataFrame, paths: Sequence[str], body: str = "state", oversize: int = 1_048_576
) -> DataFrame:
    """Per JSON path and value type: documents, array items and the size of their documents."""
    parsed = F.try_parse_json(F.col(body))
    found = [
        F.struct(F.lit(p).alias("path"), F.try_variant_get(parsed, p, "variant").alias("value"))
        for p in paths
    ]
    opened = df.select(
        F.octet_length(body).cast("long").alias("bytes"), F.explode(F.array(*found)).alias("f")
    )
    kind = F.regexp_extract(F.coalesce(F.schema_of_variant("f.value"), F.lit("ABSENT")), r"^\w+", 0)
    items = F.size(F.col("f.value").try_cast("array<variant>"))
    return (
        opened.select("bytes", F.col("f.path").alias("path"), kind.alias("type"), items.alias("items"))
        .groupBy("path", "type")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.coalesce(F.sum(F.when(F.col("type") == "ARRAY", F.col("items"))), F.lit(0)).alias("array_items"),
            F.sum("bytes").alias("total_bytes"),
            F.max("bytes").alias("largest_bytes"),
            F.count_if(F.col("bytes") > oversize).alias("oversize"),
        )
    )
