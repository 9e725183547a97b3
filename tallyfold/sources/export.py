"""Paged export, its reader, snapshots and their retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import OrderedRows, row_number


def read_export(
    spark: SparkSession, path: str, schema: T.StructType, key: str = "users"
) -> DataFrame:
    """Rows of an export whose lines each hold a JSON array, or an object with an array at ``key``.

    Blank lines are skipped; an unreadable line fails the job rather than losing rows.
    """
    strict = {"mode": "FAILFAST"}
    rows = T.ArrayType(schema)
    wrapped = T.StructType([T.StructField(key, rows)])
    line = F.trim(F.col("value"))
    items = F.when(line.startswith("["), F.from_json(line, rows, strict)).otherwise(
        F.from_json(line, wrapped, strict)[key]
    )
    return spark.read.text(path).where(line != "").select(F.inline(items))


def export_pages(df: DataFrame, key: str, size: int = 50) -> DataFrame:
    """Number all rows in key order (``rank`` from 1) and cut them into pages of ``size`` rows.

    ``key`` is the primary key. The order is global, yet no task sees more than its own range of
    keys, and only the keys are sorted; the wide rows join their number afterwards.
    """
    keys = df.select(key)
    ranked = OrderedRows(keys, [], [F.col(key)], slice_all=True).add(rank=row_number()).rows()
    paged = ranked.withColumn("page", F.call_function("div", F.col("rank") - 1, F.lit(size)))
    return df.join(paged, key).select(*df.columns, "rank", "page")


def export_lines(df: DataFrame, key: str, size: int = 50) -> DataFrame:
    """One line per page: the JSON array of its rows in key order."""
    columns = [F.col(c) for c in df.columns]
    page_rows = F.array_sort(F.collect_list(F.struct("rank", F.struct(*columns).alias("row"))))
    return (
        export_pages(df, key, size)
        .groupBy("page")
        .agg(page_rows.alias("rows"))  # at most ``size`` rows
        .select("page", F.to_json(F.col("rows.row")).alias("value"))
    )


def write_export(df: DataFrame, key: str, path: str, size: int = 50) -> None:
    """Write the export as text files of page lines; an existing export is never overwritten."""
    export_lines(df, key, size).select("value").write.mode("errorifexists").text(path)


def write_snapshot(df: DataFrame, base: str, stamp: str) -> str:
    """Write ``df`` under a time-stamped folder and return it; nothing is ever deleted."""
    path = f"{base}/snapshot={stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def expired_snapshots(
    manifest: DataFrame, asof: Column | str, keep_days: int = 14, stamp: str = "stamp"
) -> DataFrame:
    """Snapshots older than ``keep_days`` whole days."""
    asof = F.lit(asof).cast("timestamp") if isinstance(asof, str) else asof
    age = F.floor(
        (F.unix_seconds(asof) - F.unix_seconds(F.col(stamp).cast("timestamp"))) / F.lit(86400)
    )
    return manifest.where(age > keep_days)
