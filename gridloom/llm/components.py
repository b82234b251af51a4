"""Connected components of a graph of links, by alternating large-star and small-star steps.

After each step the links are written to the shared folder, so a lost executor costs one step at most. Nothing but
two sums comes to the driver. A node with most of the links is handled by partial aggregation and by joins whose
large partitions can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import forget, written


def _star(links: DataFrame, large: bool, name: str) -> DataFrame:
    """``links`` (u, v). Large: each node's larger neighbours go to its least neighbour; small: its smaller ones and itself do."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = written(both.groupBy("u").agg(F.min("v").alias("_least")).withColumn("least", F.least("u", "_least")).drop("_least"), "star-least")
    out = both.join(least, "u").where(F.col("v") > F.col("u") if large else F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("least").alias("v")))
    out = written(out.where("u != v").distinct(), name)
    forget(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for each node of ``links`` (columns a and b, longs); nodes without links have no row."""
    now = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    before, after = None, mark(now)
    while after[0] and before != after:
        middle = _star(now, True, "large-star")
        old, now = now, _star(middle, False, "small-star")
        forget(old, middle)
        before, after = after, mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
