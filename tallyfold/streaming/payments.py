"""Payment notices as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import measure
from ..operators.payments import activate, suppress_replays


# A full state after so many batches; a batch reads fewer than that and one full state.
COMPACT_EVERY = 20


def drop_redeliveries(
    stream: DataFrame, keys: list[str], ts: str = "received_at", delay: str = "7 days"
) -> DataFrame:
    """Keep the first delivery of each reference inside the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def _batches(spark: SparkSession, base: str, kind: str) -> list[int]:
    """Numbers of the folders ``base/<kind>=N``: one listing of names, whatever they hold."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path) if status.isDirectory()]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}="))


def _complete(spark: SparkSession, folder: str) -> bool:
    """Whether the writer of the folder has finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def subscriptions_after(
    spark: SparkSession,
    base: str,
    initial: DataFrame,
    before: int | None = None,
    users: DataFrame | None = None,
) -> DataFrame:
    """Each user's row as of the batches below ``before`` (all when None), else the initial row.

    Reads the last full state below ``before`` and the batches after it, a number of folders that does not grow with the log. ``users`` (unique user_id) restricts the state before anything is grouped; it then has their rows only.
    """
    columns = initial.columns
    until = float("inf") if before is None else before
    done = (n for n in reversed(_batches(spark, base, "full")) if n < until and _complete(spark, f"{base}/full={n}"))
    full = next(done, -1)
    batches = [n for n in _batches(spark, base, "batch") if full < n < until and _complete(spark, f"{base}/batch={n}")]
    start = spark.read.schema(initial.schema).parquet(f"{base}/full={full}") if full >= 0 else initial
    schema = T.StructType([*initial.schema.fields, T.StructField("batch", T.LongType())])
    rows = start.withColumn("batch", F.lit(-1).cast("long"))
    if batches:
        log = spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/batch={n}" for n in batches])
        rows = rows.unionByName(log)
    if users is not None:
        rows = rows.join(users.select("user_id"), "user_id", "left_semi")
    elif not batches:
        return start
    latest = F.max_by(F.struct(*columns), F.col("batch"))
    return rows.groupBy("user_id").agg(latest.alias("row")).select("row.*")


def activation(
    base: str, initial: DataFrame, dedupe: str = "last", compact_every: int = COMPACT_EVERY, **stack
) -> Callable:
    """A ``foreachBatch`` function that applies paid notices (user_id, ref, paid_at).

    Batch N writes the new rows of the users it touches to ``base/batch=N``, computed from the batches before it; every
    ``compact_every`` batches the whole state goes to ``base/full=N`` as well, and later batches start from there. A retry
    of N overwrites the same folders from the same state, so it is harmless; in between untouched users are not rewritten.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            hot = measure(batch, "user_id")
            mine = subscriptions_after(spark, base, initial, batch_id, batch.select("user_id").distinct())
            kept = suppress_replays(
                batch, dedupe, order=("paid_at", "ref"), hot=hot,
                stored=mine.select(
                    "user_id", F.col("provider_ref").cast(batch.schema["ref"].dataType).alias("provider_ref")
                ),
            )
            new = activate(mine, kept, hot=hot, **stack)
            new.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")
            if batch_id % compact_every == compact_every - 1:
                whole = subscriptions_after(spark, base, initial, batch_id + 1)
                whole.write.mode("overwrite").parquet(f"{base}/full={batch_id}")
        finally:
            batch.unpersist()

    return apply
