"""Typed scans of the account tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULTS, TABLES


def read_typed(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    defaults: Mapping[str, Callable[[], Column]] | None = None,
) -> DataFrame:
    """Read Parquet with a declared schema; absent values take their declared default."""
    df = spark.read.schema(schema).parquet(path)
    filled = {c: F.coalesce(F.col(c), value()) for c, value in (defaults or {}).items()}
    return df.withColumns(filled) if filled else df


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The account tables below ``folder``, one Parquet dataset per table."""
    return {
        name: read_typed(spark, f"{folder}/{name}.parquet", schema, DEFAULTS[name])
        for name, schema in TABLES.items()
    }
