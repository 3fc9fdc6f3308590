"""Connected components of a graph given as edges, by alternating stars.

Large-star and small-star steps (Kiveris et al., 2014) turn every component into
a star around its smallest node, in a number of rounds that grows with the
logarithm of its size.  Nothing but one flag a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.storage import discard, stored


def _stars(edges: DataFrame) -> bool:
    """Whether every node above another hangs on that one only and has none below itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 OR (up = 1 AND low = 1)")
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, component): for each node with an edge the smallest node it reaches."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        last, now = now, stored(large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.w").alias("v")).where("u <> v").distinct(), "edges")
        discard(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
