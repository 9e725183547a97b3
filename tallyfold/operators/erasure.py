"""Erasure of accounts and the check afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import dealt_anew
from ..session import stored
from ..sources.snapshots import write_set

ERASURE_DAYS = 30

# Order of erasure: (table, its key column, table that names the erased keys, column there). The
# requests themselves are called "requests".
CHAIN = [
    ("app_state", "user_id", "requests", "user_id"),
    ("subscriptions", "user_id", "requests", "user_id"),
    ("award_entrants", "user_id", "requests", "user_id"),
    ("award_entries", "ref", "award_entrants", "ref"),
    ("users", "id", "requests", "user_id"),
]
LEDGER = "subscriptions"
TOMBSTONES = "tombstones"


def erased_keys(
    tables: Mapping[str, DataFrame],
    requests: DataFrame,
    chain: Sequence[tuple] = CHAIN,
) -> dict[str, DataFrame]:
    """For each table of the chain the distinct keys whose rows go."""
    gone: dict[str, DataFrame] = {}
    matching = {"requests": requests}
    for table, column, parent, parent_column in chain:
        if parent not in matching:
            link = next(c for t, c, *_ in chain if t == parent)
            rows = tables[parent]
            matching[parent] = rows.join(dealt_anew(gone[parent], link), link, "left_semi")
        gone[table] = (
            matching[parent]
            .select(F.col(parent_column).alias(column))
            .where(F.col(column).isNotNull())
            .distinct()
        )
    return gone


def erase(
    tables: Mapping[str, DataFrame],
    requests: DataFrame,
    keep_ledger: bool = False,
    chain: Sequence[tuple] = CHAIN,
    ledger: str = LEDGER,
    gone: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The tables without the rows of erased users; content goes through its reference number.

    ``keep_ledger`` keeps payment records, as the privacy page promises and the handler does not. ``gone`` are the keys where
    they are known already (``erased_keys``).
    """
    gone = gone or erased_keys(tables, requests, chain)
    left = {}
    for table, column, *_ in chain:
        rows = tables[table]
        if not (keep_ledger and table == ledger):
            columns = rows.columns
            rows = rows.join(dealt_anew(gone[table], column), column, "left_anti").select(*columns)
        left[table] = rows
    return left


def erasure_counts(
    before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]
) -> DataFrame:
    """Rows before, left and removed per table."""
    def counted(name: str) -> DataFrame:
        rows = before[name].select(F.lit(1).alias("b"), F.lit(0).alias("a"))
        rows = rows.unionAll(after[name].select(F.lit(0), F.lit(1)))
        total = rows.agg(F.sum("b").alias("rows"), F.sum("a").alias("left"))
        return total.select(
            F.lit(name).alias("table"),
            F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
            F.coalesce("left", F.lit(0)).cast("long").alias("left"),
            (F.coalesce("rows", F.lit(0)) - F.coalesce("left", F.lit(0))).cast("long").alias("removed"),
        )

    return reduce(DataFrame.unionByName, [counted(name) for name in after])


def tombstones(gone: Mapping[str, DataFrame]) -> DataFrame:
    """table and key (as text) of everything an erasure removes, one narrow table for all."""
    marks = [
        keys.select(F.lit(table).alias("table"), F.col(keys.columns[0]).cast("string").alias("key"))
        for table, keys in gone.items()
    ]
    return reduce(DataFrame.unionByName, marks)


def write_erasure(
    tables: Mapping[str, DataFrame],
    requests: DataFrame,
    base: str,
    stamp: str,
    keep_ledger: bool = False,
    chain: Sequence[tuple] = CHAIN,
    ledger: str = LEDGER,
) -> dict[str, str]:
    """Write the tables after the erasure, in chain order, and the keys it removed, as one set of snapshots.

    The keys are written first, as the table ``tombstones``, and the tables are cut by what was written. A step that
    fails stops the rest, and readers keep the set before. Returns the folder of each table.
    """
    marks = stored(tombstones(erased_keys(tables, requests, chain)), TOMBSTONES)
    gone = {table: _marked(marks, tables[table], table, column) for table, column, *_ in chain}
    left = erase(tables, requests, keep_ledger, chain, ledger, gone)
    kept = F.col("table") != ledger if keep_ledger else F.lit(True)
    return write_set({TOMBSTONES: marks.where(kept), **{name: left[name] for name, *_ in chain}}, base, stamp)


def _marked(marks: DataFrame, rows: DataFrame, table: str, column: str) -> DataFrame:
    kind = rows.schema[column].dataType
    return marks.where(F.col("table") == table).select(F.col("key").cast(kind).alias(column)).distinct()


def residuals(
    tables: Mapping[str, DataFrame], marks: DataFrame, chain: Sequence[tuple] = CHAIN
) -> DataFrame:
    """table and residual: rows of the tables, whoever wrote them, whose keys an erasure removed.

    ``marks`` are the tombstones that erasures stored, so nothing has to be known of the tables before. A table of the chain that is
    not among ``tables`` is not audited.
    """
    checks = []
    for table, column, *_ in chain:
        if table in tables:
            keys = tables[table].select(column)
            kept = keys.join(dealt_anew(_marked(marks, keys, table, column), column), column, "left_semi")
            checks.append(kept.agg(F.count(F.lit(1)).alias("residual")).select(F.lit(table).alias("table"), "residual"))
    return reduce(DataFrame.unionByName, checks)


def erasure_audit(
    before: Mapping[str, DataFrame],
    tables: Mapping[str, DataFrame],
    requests: DataFrame,
    chain: Sequence[tuple] = CHAIN,
) -> DataFrame:
    """``residuals`` where an erasure stored nothing: ``before`` are the tables before it, which tell what was erased."""
    return residuals(tables, tombstones(erased_keys(before, requests, chain)), chain)


def overdue_erasures(requests: DataFrame, asof: Column | str) -> DataFrame:
    """Requests (requested_on, done_on) that are open for more than 30 days."""
    today = F.to_date(F.lit(asof)) if isinstance(asof, str) else asof
    return requests.where(F.col("done_on").isNull()).where(
        F.datediff(today, F.col("requested_on")) > ERASURE_DAYS
    )
