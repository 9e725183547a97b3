"""Ordered scans that stay balanced when one key holds a large share of the rows.

They start from an exact count per key (partial aggregation, narrow rows). A key is *hot* when it holds more rows than
one task should take, a constant. Hot keys stay a table; nothing here is collected or broadcast, however many there are.
Joins need none of this: adaptive execution splits the partitions of a skewed key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .text import let

ROWS_PER_TASK = 1_000_000


def task_rows(df: DataFrame) -> int:
    """Rows of one key that a single task may take (``tallyfold.rowsPerTask``)."""
    return int(df.sparkSession.conf.get("tallyfold.rowsPerTask", str(ROWS_PER_TASK)))


def _columns(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


@dataclass(frozen=True)
class Hot:
    """The hot keys of a table, or None when there are none.

    One measurement serves every later step on the same key, also after rows were filtered out:
    it only decides which plan a key takes, never the result.
    """

    values: DataFrame | None
    rows: int
    limit: int


def measure(df: DataFrame, keys) -> Hot:
    """Find the hot keys of ``df`` by exact counts; of the counts two numbers reach the driver."""
    keys = _columns(keys)
    counts = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    limit = max(task_rows(df), 1)
    large = F.when(F.col("_rows") > limit, F.col("_rows"))
    held = counts.agg(F.sum(large)).first()[0]
    if not held:
        return Hot(None, 0, limit)
    return Hot(stored(counts.where(F.col("_rows") > limit).select(*keys), "hot-keys"), int(held), limit)


def expected(df: DataFrame, keys, share: int) -> Hot:
    """The keys that one of ``share`` parts of a table lets expect to be hot in the whole; a key it misses costs time only."""
    keys = _columns(keys)
    limit = max(task_rows(df), 1)
    counts = df.select(*keys).groupBy(*keys).agg((F.count(F.lit(1)) * share).alias("_rows"))
    values = stored(counts.where(F.col("_rows") > limit), "hot-keys")
    held = values.agg(F.sum("_rows")).first()[0]
    return Hot(values.select(*keys) if held else None, int(held or 0), limit)


def split(df: DataFrame, keys, hot: Hot) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary keys and those of hot keys (None when there are none)."""
    keys = _columns(keys)
    if hot.values is None:
        return df, None
    values = hot.values.toDF(*keys)
    return _without(df, values, keys), _only(df, values, keys)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _only(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(hot, _null_safe(df, hot, keys), "left_semi")


def _without(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(hot, _null_safe(df, hot, keys), "left_anti")


def dealt_anew(lookup: DataFrame, keys) -> DataFrame:
    """The small side of a join whose other side may be skewed, to be dealt out by the join itself.

    Adaptive execution splits a skewed partition only between two exchanges of the join. A side that was grouped by the join's
    keys would bring its own partitioning and no exchange; behind a lambda the keys are no longer known to be those.
    """
    return lookup.withColumns({k: let(F.col(k), lambda x: x) for k in _columns(keys)})


class Running:
    """A running value over a key's ordered rows that can be carried from slice to slice."""

    def __init__(self, inside: Callable, total: Callable, carry: Callable, through: Callable, merge: Callable):
        self.inside, self.total, self.carry, self.through, self.merge = inside, total, carry, through, merge


def _up_to_here(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(value: Column) -> Running:
    return Running(
        inside=lambda w: F.sum(value).over(_up_to_here(w)),
        total=lambda here: here,
        carry=lambda c, w: F.sum(c).over(_before(w)),
        through=lambda c, w: F.sum(c).over(_up_to_here(w)),
        merge=lambda here, c, first: F.when(c.isNull(), here).otherwise(F.coalesce(here + c, c)),
    )


def running_max(value: Column) -> Running:
    return Running(
        inside=lambda w: F.max(value).over(_up_to_here(w)),
        total=lambda here: here,
        carry=lambda c, w: F.max(c).over(_before(w)),
        through=lambda c, w: F.max(c).over(_up_to_here(w)),
        merge=lambda here, c, first: F.greatest(here, c),
    )


def running_min(value: Column) -> Running:
    return Running(
        inside=lambda w: F.min(value).over(_up_to_here(w)),
        total=lambda here: here,
        carry=lambda c, w: F.min(c).over(_before(w)),
        through=lambda c, w: F.min(c).over(_up_to_here(w)),
        merge=lambda here, c, first: F.least(here, c),
    )


def running_last(value: Column) -> Running:
    """The latest non-null value up to and including this row."""
    return Running(
        inside=lambda w: F.last(value, ignorenulls=True).over(_up_to_here(w)),
        total=lambda here: here,
        carry=lambda c, w: F.last(c, ignorenulls=True).over(_before(w)),
        through=lambda c, w: F.last(c, ignorenulls=True).over(_up_to_here(w)),
        merge=lambda here, c, first: F.coalesce(here, c),
    )


def previous(value: Column) -> Running:
    """The value of the row before this one."""
    return Running(
        inside=lambda w: F.lag(value).over(w),
        total=lambda here: value,
        carry=lambda c, w: F.lag(c).over(w),
        through=lambda c, w: c,
        merge=lambda here, c, first: F.when(first, c).otherwise(here),
    )


def row_number() -> Running:
    return running_sum(F.lit(1).cast("long"))


class OrderedRows:
    """Rows of each key in a total order, ready for running values.

    Ordinary keys use one window per key. The rows of hot keys are range-partitioned on
    (keys, order) into slices of constant size, as many as it takes; running values are taken inside each slice, the
    last row of each slice gives its total, and the totals (at most one row per slice and key)
    carry over. Where a table of totals is itself too long for one task it is carried in blocks, level by level. The slices
    are stored first, since a recomputed range partitioning may cut elsewhere. ``order`` must be total: a tie would leave the
    order within a key open.
    """

    def __init__(
        self,
        df: DataFrame,
        keys,
        order: Sequence[Column | str],
        hot: Hot | None = None,
        slice_all: bool = False,
    ):
        self.keys = _columns(keys)
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]
        self.light: DataFrame | None = None
        self.heavy: DataFrame | None = None
        if slice_all:
            cores = df.sparkSession.sparkContext.defaultParallelism
            self.heavy = self._sliced(df, max(df.count() // task_rows(df) + 1, cores))
            return
        hot = hot or measure(df, self.keys)
        self.light, heavy = split(df, self.keys, hot)
        if heavy is not None:
            self.heavy = self._sliced(heavy, hot.rows // hot.limit + 1)

    def _sliced(self, df: DataFrame, slices: int) -> DataFrame:
        self.slices, self.limit = slices, max(task_rows(df), 2)
        keys = [F.col(k) for k in self.keys]
        ranged = df.repartitionByRange(slices, *keys, *self.order)
        return stored(ranged.withColumn("_slice", F.spark_partition_id()), "slices")

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> OrderedRows:
        """Apply a row-wise step to all rows."""
        self.light = fn(self.light) if self.light is not None else None
        self.heavy = fn(self.heavy) if self.heavy is not None else None
        return self

    def add(self, **running: Running) -> OrderedRows:
        """Add one column per running value."""
        if self.light is not None:
            window = Window.partitionBy(*self.keys).orderBy(*self.order)
            self.light = self.light.withColumns({n: r.inside(window) for n, r in running.items()})
        if self.heavy is not None:
            self.heavy = self._add_sliced(running)
        return self

    def _add_sliced(self, running: dict[str, Running]) -> DataFrame:
        place = [*self.keys, "_slice"]
        window = Window.partitionBy(*place).orderBy(*self.order)
        inside = self.heavy.withColumns(
            {n: r.inside(window) for n, r in running.items()}
            | {
                "_first": F.lag(F.lit(1)).over(window).isNull(),
                "_last": F.lead(F.lit(1)).over(window).isNull(),
            }
        )
        totals = inside.where("_last").select(
            *place, *[r.total(F.col(n)).alias(f"_t_{n}") for n, r in running.items()]
        )
        carried = self._carried(totals, "_slice", self.slices, running)
        carried = carried.select(
            *[F.col(c).alias(f"_k_{c}") for c in place], *[f"_c_{n}" for n in running]
        )
        same = reduce(
            lambda a, b: a & b, [inside[c].eqNullSafe(carried[f"_k_{c}"]) for c in place]
        )
        merged = inside.join(carried, same, "left").withColumns(
            {n: r.merge(F.col(n), F.col(f"_c_{n}"), F.col("_first")) for n, r in running.items()}
        )
        return merged.drop("_first", "_last", *carried.columns)

    def _carried(
        self, totals: DataFrame, at: str, places: int, running: dict[str, Running]
    ) -> DataFrame:
        """Keys, ``at`` and for each running value (total ``_t_``) what the places before it carry in (``_c_``).

        ``at`` counts at most ``places`` places. Those of one block meet in one task; block totals are carried the same way.
        """
        if places <= self.limit:
            across = Window.partitionBy(*self.keys).orderBy(at)
            carries = {f"_c_{n}": r.carry(F.col(f"_t_{n}"), across) for n, r in running.items()}
            return totals.withColumns(carries).select(*self.keys, at, *carries)
        block = f"{at}_block"
        inner = Window.partitionBy(*self.keys, block).orderBy(at)
        blocks = totals.withColumn(block, F.call_function("div", F.col(at), F.lit(self.limit)).cast("int"))
        blocks = blocks.withColumns(
            {f"_c_{n}": r.carry(F.col(f"_t_{n}"), inner) for n, r in running.items()}
            | {f"_u_{n}": r.through(F.col(f"_t_{n}"), inner) for n, r in running.items()}
            | {"_begins": F.lag(F.lit(1)).over(inner).isNull(), "_ends": F.lead(F.lit(1)).over(inner).isNull()}
        )
        sums = blocks.where("_ends").select(
            *self.keys, block, *[F.col(f"_u_{n}").alias(f"_t_{n}") for n in running]
        )
        above = self._carried(sums, block, places // self.limit + 1, running)
        place = [*self.keys, block]
        above = above.select(
            *[F.col(c).alias(f"_a_{c}") for c in place], *[F.col(f"_c_{n}").alias(f"_b_{n}") for n in running]
        )
        same = reduce(lambda a, b: a & b, [blocks[c].eqNullSafe(above[f"_a_{c}"]) for c in place])
        joined = blocks.join(above, same, "left").withColumns(
            {
                f"_c_{n}": r.merge(F.col(f"_c_{n}"), F.col(f"_b_{n}"), F.col("_begins"))
                for n, r in running.items()
            }
        )
        return joined.select(*self.keys, at, *[f"_c_{n}" for n in running])

    def rows(self) -> DataFrame:
        """All rows, in no particular order."""
        heavy = self.heavy.drop("_slice") if self.heavy is not None else None
        if self.light is None:
            return heavy
        return self.light if heavy is None else self.light.unionByName(heavy)
