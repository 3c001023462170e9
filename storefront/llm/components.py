"""Connected components of an edge table by alternating stars.

Every round is two joins on Spark, until each component is one star around its
least node; nothing is gathered on the driver. A node with very many edges is an ordinary skewed join
key, which AQE splits: both join sides are shuffles of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.llm.common import written


def _stars(edges: DataFrame) -> bool:
    """True if no node has two edges (u, v) of its own, or one and is a v too."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1").isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges``: columns a, b of one orderable type. Returns (node, comp) for
    every node of an edge, comp being the least node of its component."""
    e = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    while not _stars(e):
        both = e.union(e.select("v", "u"))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-low")
        e = written(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .filter("u != v").distinct(), f"{label}-large")
        low = written(e.groupBy("u").agg(F.min("v").alias("m")), f"{label}-low")
        small = e.join(low, "u")
        e = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
                    .union(low.select("u", F.col("m").alias("v"))).distinct(), f"{label}-small")
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(tops.select("node", F.col("node").alias("comp")))
