"""Run a stream over what is there now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import scratch_path


def drain(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Process all available input into Parquet files and read the result back."""
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, "stream")
    running = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, apply: Callable, progress: str) -> None:
    """Process all available input through a ``foreachBatch`` function."""
    running = (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
