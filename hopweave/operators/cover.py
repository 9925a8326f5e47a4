"""An order of hubs for pruned labels: first what breaks all cycles, then separators of what is left, which has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import LabeledGraph
from ..plans.storage import drop, kept
from .topology import strong_components, topological_levels


def short_cycles(edges: DataFrame, length: int) -> DataFrame:
    """cycle (an array of vertices, the smallest first): simple cycles of at most so many edges, each once."""
    step = edges.where("src <> dst").select("src", "dst").distinct()
    paths = step.where("dst > src").select(F.array("src", "dst").alias("path"))
    found = None
    for _ in range(length - 1):
        last = F.element_at("path", -1)
        longer = paths.join(step.withColumnRenamed("src", "last"), last == F.col("last"))
        closed = longer.where(F.col("dst") == F.col("path")[0]).select(F.col("path").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        paths = longer.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return found if found is not None else paths.select(F.col("path").alias("cycle")).limit(0)


def cover_hubs(edges: DataFrame, length: int = 3) -> DataFrame:
    """vid, round: vertices without which the graph has no cycle, greedily.

    Each round takes of every strongly connected component the vertex that is on most cycles of at most `length` edges (then
    the one with most pairs of an in- and an out-edge, then the smallest), and looks at what is left of the component.
    """
    spark = edges.sparkSession
    left, left_at = kept(edges.where("src <> dst").select("src", "dst").distinct(), "cover-edges")
    hubs, at, n = None, None, 0
    while True:
        comp, comp_at = kept(strong_components(left), "cover-components")
        if comp.isEmpty():
            drop(spark, comp_at)
            return hubs if hubs is not None else left.select(F.col("src").alias("vid"), F.lit(0).alias("round")).limit(0)
        inner = left.join(comp.selectExpr("vid AS src", "comp AS c1"), "src").join(comp.selectExpr("vid AS dst", "comp AS c2"), "dst").where("c1 = c2").select("src", "dst")
        inner, inner_at = kept(inner, "cover-edges")
        on = short_cycles(inner, length).select(F.explode("cycle").alias("vid")).groupBy("vid").agg(F.count(F.lit(1)).alias("cycles"))
        degree = inner.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("o")).join(inner.groupBy(F.col("dst").alias("vid")).agg(F.count(F.lit(1)).alias("i")), "vid")
        ranked = comp.join(degree, "vid").join(on, "vid", "left").groupBy("comp").agg(F.min(F.struct((-F.coalesce("cycles", F.lit(0))).alias("cycles"), (-F.col("o") * F.col("i")).alias("pairs"), "vid")).alias("best"))
        chosen, chosen_at = kept(ranked.select("best.vid", F.lit(n).alias("round")), "cover-hubs")
        more, more_at = kept(chosen if hubs is None else hubs.unionByName(chosen), "cover-hubs")
        rest, rest_at = kept(inner.join(chosen.selectExpr("vid AS src"), "src", "left_anti").join(chosen.selectExpr("vid AS dst"), "dst", "left_anti").select("src", "dst"), "cover-edges")
        drop(spark, left_at, inner_at, comp_at, chosen_at, *([at] if at else []))
        hubs, at, left, left_at, n = more, more_at, rest, rest_at, n + 1


def bisection_places(edges: DataFrame) -> DataFrame:
    """vid, bit: the highest split of the topological levels of an acyclic graph that an edge from the vertex crosses.

    Levels are split in halves, these in halves again; an edge between levels a and b crosses the split that is the highest
    bit in which they differ. Every path over a split goes through one of its edges' sources.
    """
    level, _ = kept(topological_levels(edges), "levels")
    both = edges.join(level.selectExpr("vid AS src", "level AS a"), "src").join(level.selectExpr("vid AS dst", "level AS b"), "dst")
    return both.groupBy(F.col("src").alias("vid")).agg(F.max(F.floor(F.log2(F.expr("a ^ b").cast("double")))).cast("int").alias("bit"))


def cover_order(graph: LabeledGraph, length: int = 3) -> DataFrame:
    """vid, place of every vertex: hubs of cycles by round, then separators from the highest split down, then the rest."""
    hubs, _ = kept(cover_hubs(graph.edges, length), "hubs")
    rest = graph.edges.where("src <> dst").join(hubs.selectExpr("vid AS src"), "src", "left_anti").join(hubs.selectExpr("vid AS dst"), "dst", "left_anti").select("src", "dst")
    bits = bisection_places(rest)
    place = F.coalesce(F.col("round") - F.lit(1 << 20), -F.col("bit"), F.lit(1))
    return graph.vertices.select("vid").join(hubs, "vid", "left").join(bits, "vid", "left").select("vid", place.alias("place"))
