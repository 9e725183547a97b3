"""Connected components of a table of links, by alternating large and small stars.

Each round is a minimum per node and a join, both combined before they are shuffled, so that a node with very many links
needs no list of them; rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.session import stored


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether each node has one link to a smaller node, or is such a smaller node, and not both."""
    down = links.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("top"))
    ends = down.unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("top")))
    nodes = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("top").alias("top"))
    return nodes.where("out > 1 or out = 1 and top = 1").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) of every node that a link to another touches; ids are integers.

    Links may repeat and have either direction; links to oneself and with a null end are ignored. No links give no rows.
    """
    now = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = stored(_small(now), "links")
    while not _is_forest_of_stars(now):
        now = stored(_small(_large(now)), "links")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
