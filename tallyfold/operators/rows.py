"""Lookups and row-level visibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def lookup(df: DataFrame, keys, cols: Sequence[str], key: str) -> DataFrame:
    """Columns ``cols`` of the rows whose ``key`` equals one value or appears in a DataFrame."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
        narrow = df.select(*dict.fromkeys([*cols, key]))
        return narrow.join(wanted, key, "left_semi").select(*cols)
    return df.where(F.col(key) == F.lit(keys)).select(*cols)


def visible_rows(df: DataFrame, principals: DataFrame, policy: str | None) -> DataFrame:
    """Rows whose owner column ``policy`` is one of the principals; none without a policy."""
    if policy is None:
        return df.limit(0)
    callers = principals.select(F.col(principals.columns[0]).alias(policy)).distinct()
    return df.join(callers, policy, "left_semi").select(*df.columns)


def write_allowed(policies: Mapping[str, str], operation: str = "operation", caller: str = "caller") -> Column:
    """Whether a change passes: its operation has a policy and the owner column names the caller."""
    allowed = F.lit(False)
    for name, owner in policies.items():
        allowed = F.when(F.col(operation) == name, F.col(owner) == F.col(caller)).otherwise(allowed)
    return F.coalesce(allowed, F.lit(False))


def check_writes(changes: DataFrame, policies: Mapping[str, str]) -> dict[str, DataFrame]:
    """Split changes (columns ``operation``, ``caller``) into accepted and rejected."""
    judged = changes.withColumn("_allowed", write_allowed(policies))
    return {
        "accepted": judged.where("_allowed").drop("_allowed"),
        "rejected": judged.where("not _allowed").drop("_allowed"),
    }
