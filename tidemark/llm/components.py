"""Connected components of a link table by alternating star contractions, in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (large: the greater ones; small: the smaller ones and itself) to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    around = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = around.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    met = around.join(least, "u")
    out = met.where("v > u") if large else met.where("v <> low").unionByName(least.withColumn("v", F.col("u")).select("u", "v", "low"))
    return out.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has a link; ``root`` is the least node of its component.

    ``edges`` has two columns of one ordered type. A hot node costs no more than its links:
    the least neighbour is pre-aggregated, and joins on nodes leave AQE free to split.
    """
    u, v = edges.columns
    now = materialize(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        now = materialize(_star(_star(now, True), False), "links")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
