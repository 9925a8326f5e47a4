"""Connected components of a graph of links, as DataFrames (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, kept


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, list[str]]:
    """One step: each vertex hands its larger (or its other) neighbours, and itself, to the smallest it knows."""
    both = edges.unionByName(edges.selectExpr("v AS u", "u AS v")) if large else edges
    least, at = kept(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.selectExpr("u", "m AS v"))
    return out.where("u > v").distinct(), [at]


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> u, component (its smallest member), for each vertex but the smallest of its component.

    Each step is written to the shared folder; only a count and a checksum come to the driver. The number of
    steps grows with the logarithm of the longest path.
    """
    spark = links.sparkSession
    edges, at = kept(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen or not now[0]:
            return edges.select("u", F.col("v").alias("component"))
        seen = now
        large, used = _star(edges, True)
        large, large_at = kept(large, "large-star")
        small, more = _star(large, False)
        edges, new = kept(small, "small-star")
        drop(spark, at, large_at, *used, *more)
        at = new
