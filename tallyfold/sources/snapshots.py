"""Sets of snapshots: several tables that become visible together or not at all.

Each table is written to a folder of its own, named by the set's stamp and the attempt. Only when all of them are complete is
the set's manifest written: one file with one line per table. A file appears under its final name by one rename, so a
reader sees the whole set or the set before it, and what a failed attempt left behind is never read. Nothing is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS = "manifests"
LINE = "table string, path string, rows bigint, schema string"


class MissingSet(LookupError):
    """No committed set of snapshots answers the question."""


def write_set(tables: Mapping[str, DataFrame], base: str, stamp: str) -> dict[str, str]:
    """Write all tables and then commit them as the set ``stamp``; returns the folder of each.

    A failing table stops the rest and leaves the sets before it as they are; the same stamp may then be tried again. A stamp
    that is committed already is refused before anything is written. Rows are counted while they are written.
    """
    if not tables:
        raise ValueError("a set needs at least one table")
    spark = next(iter(tables.values())).sparkSession
    if stamp in _stamps(spark, base):
        raise FileExistsError(f"the set {stamp} is committed")
    attempt = uuid.uuid4().hex
    lines = []
    for name, df in tables.items():
        counted = Observation(f"{name}-{attempt}")
        path = f"{name}/snapshot={stamp}/attempt={attempt}"
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(f"{base}/{path}")
        lines.append((name, path, counted.get["rows"], df.schema.json()))
    manifest = spark.createDataFrame(lines, LINE)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{base}/{MANIFESTS}/stamp={stamp}")
    return {name: f"{base}/{path}" for name, path, *_ in lines}


def manifests(spark: SparkSession, base: str) -> DataFrame:
    """stamp, table, path, rows and schema of all committed sets; no rows where none is."""
    schema = T.StructType([*T._parse_datatype_string(LINE).fields, T.StructField("stamp", T.StringType())])
    try:
        return spark.read.schema(schema).json(f"{base}/{MANIFESTS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _stamps(spark: SparkSession, base: str) -> set[str]:
    """A set has a handful of lines; a folder without a line was never committed."""
    return {r["stamp"] for r in manifests(spark, base).select("stamp").distinct().collect()}


def read_set(spark: SparkSession, base: str, asof: str | None = None) -> dict[str, DataFrame]:
    """The tables of the last set, or of the last one stamped at or before ``asof``, with the schemas they had.

    Without such a set ``MissingSet`` is raised.
    """
    known = manifests(spark, base)
    if asof is not None:
        known = known.where(F.col("stamp") <= asof)
    stamp = known.agg(F.max("stamp")).first()[0]
    if stamp is None:
        raise MissingSet(f"no set of snapshots in {base}" + (f" up to {asof}" if asof else ""))
    lines = known.where(F.col("stamp") == stamp).collect()
    return {
        r["table"]: spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).parquet(f"{base}/{r['path']}")
        for r in lines
    }


def verify_set(spark: SparkSession, base: str, asof: str | None = None) -> DataFrame:
    """table, expected and found rows of the set that ``read_set`` gives, to check a copy of it."""
    known = manifests(spark, base)
    if asof is not None:
        known = known.where(F.col("stamp") <= asof)
    last = known.agg(F.max("stamp").alias("stamp"))
    expected = known.join(last, "stamp").select("table", F.col("rows").alias("expected"))
    found = None
    for name, df in read_set(spark, base, asof).items():
        one = df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("table"), "found")
        found = one if found is None else found.unionByName(one)
    return expected.join(found, "table")


def superseded_sets(spark: SparkSession, base: str, asof: str, keep_days: int = 14) -> DataFrame:
    """stamp, table and path of sets older than ``keep_days`` whole days; the last set is never among them.

    Stamps are written as yyyyMMdd-HHmmss.
    """
    known = manifests(spark, base)
    last = known.agg(F.max("stamp")).first()[0]
    age = F.floor((F.unix_timestamp(F.lit(asof).cast("timestamp")) - F.unix_timestamp("stamp", "yyyyMMdd-HHmmss")) / 86400)
    return known.where((F.col("stamp") < F.lit(last)) & (age > keep_days)).select("stamp", "table", "path")
