"""Audits that stand in for declared keys, checks and the judges' view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import IDENTITY_COLUMNS, JUDGING_COLUMNS


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def orphans(
    child: DataFrame, foreign: Sequence[str], parent: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Distinct foreign key values without a parent, with their number of rows."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in foreign])
    used = child.where(present).groupBy(*foreign).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(*[F.col(k).alias(f) for k, f in zip(key, foreign)]).distinct()
    return used.join(known, list(foreign), "left_anti")


def audit_keys(tables: Mapping[str, DataFrame], spec: Mapping[str, Mapping]) -> DataFrame:
    """One row per declared key: how many key values break it and how many rows they hold.

    ``spec`` maps a table to ``unique`` (lists of columns) and ``foreign`` (columns, parent table,
    parent columns).
    """
    findings = []

    def add(table: str, rule: str, broken: DataFrame) -> None:
        findings.append(
            broken.agg(
                F.count(F.lit(1)).alias("bad_keys"),
                F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("bad_rows"),
            ).select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), "bad_keys", "bad_rows")
        )

    for table, rules in spec.items():
        for key in rules.get("unique", []):
            add(table, f"unique({','.join(key)})", duplicate_keys(tables[table], key))
        for columns, parent, key in rules.get("foreign", []):
            add(
                table,
                f"foreign({','.join(columns)})",
                orphans(tables[table], columns, tables[parent], key),
            )
    return reduce(DataFrame.unionByName, findings)


def domain_reasons(spec: Mapping[str, Mapping]) -> Column:
    """Array of the reasons why a row breaks its column rules."""
    reasons = []
    for column, rule in spec.items():
        if rule.get("required"):
            reasons.append(F.when(F.col(column).isNull(), F.lit(f"{column} is null")))
        if "values" in rule:
            reasons.append(
                F.when(~F.col(column).isin(rule["values"]), F.lit(f"{column} not allowed"))
            )
    return F.array_compact(F.array(*reasons))


def audit_domains(df: DataFrame, spec: Mapping[str, Mapping]) -> DataFrame:
    """Rows to quarantine, with ``reasons``."""
    return df.withColumn("reasons", domain_reasons(spec)).where(F.size("reasons") > 0)


def judging_view(
    entries: DataFrame,
    columns: Sequence[str] = JUDGING_COLUMNS,
    identity: Sequence[str] = IDENTITY_COLUMNS,
) -> DataFrame:
    """Exactly the columns a judge may see; refuses a list that leads to a person."""
    leaking = [c for c in columns if c in set(identity)]
    if leaking:
        raise ValueError(f"identity columns in the judges' view: {leaking}")
    return entries.select(*columns)
