"""Pruning of candidates by consistency: arc (a partner for every edge) and path (a third vertex for every pair)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..plans.storage import drop, kept
from .relation import completed, edge, virtual_edges


def supports(relation: DataFrame) -> DataFrame:
    """label, vid, way (out or in), partner, supports: how many partners of each label a vertex has."""
    out = relation.groupBy("i", "x", "j").agg(F.count(F.lit(1)).alias("supports")).selectExpr("i AS label", "x AS vid", "'out' AS way", "j AS partner", "supports")
    into = relation.groupBy("j", "y", "i").agg(F.count(F.lit(1)).alias("supports")).selectExpr("j AS label", "y AS vid", "'in' AS way", "i AS partner", "supports")
    return out.unionByName(into)


def _domains(relation: DataFrame, pattern: Pattern) -> DataFrame:
    """label, vid of vertices with a partner for each of their label's edge ends."""
    need = F.create_map(*(F.lit(v) for k in pattern.labels for v in (k, pattern.incident(k))))
    return supports(relation).groupBy("label", "vid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.element_at(need, F.col("label"))).select("label", "vid")


def _without(relation: DataFrame, dead: DataFrame) -> DataFrame:
    return relation.join(dead.selectExpr("label AS i", "vid AS x"), ["i", "x"], "left_anti").join(dead.selectExpr("label AS j", "vid AS y"), ["j", "y"], "left_anti").select("i", "j", "x", "y")


def _unsupported(relation: DataFrame, dead: DataFrame, front: DataFrame) -> DataFrame:
    """label, vid of vertices that lose their last pair of an edge with the front, the vertices that were dropped last.

    Only ends of pairs with the front are looked at, and the pairs of these ends.
    """
    live = _without(relation, dead)
    out = relation.join(front.selectExpr("label AS j", "vid AS y"), ["j", "y"], "left_semi").select("i", "j", "x").distinct()
    into = relation.join(front.selectExpr("label AS i", "vid AS x"), ["i", "x"], "left_semi").select("i", "j", "y").distinct()
    left = out.join(live, ["i", "j", "x"], "left_anti").selectExpr("i AS label", "x AS vid")
    right = into.join(live, ["i", "j", "y"], "left_anti").selectExpr("j AS label", "y AS vid")
    return left.unionByName(right).distinct().join(dead, ["label", "vid"], "left_anti")


def arc_consistent(relation: DataFrame, pattern: Pattern, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(domains, relation) once no vertex lacks a partner for an edge; with rounds, after so many passes at most.

    Supports are counted once, for the vertices to drop first. From then on a pass looks only at what stood next to the vertices
    that the last one has dropped; these alone are written, and the relation is filtered by them once, at the end.
    """
    spark = relation.sparkSession
    ends = relation.selectExpr("i AS label", "x AS vid").unionByName(relation.selectExpr("j AS label", "y AS vid")).distinct()
    front, front_at = kept(ends.join(_domains(relation, pattern), ["label", "vid"], "left_anti"), "dropped")
    dead, used, n = front, [front_at], 1
    while n != rounds and not front.isEmpty():
        front, front_at = kept(_unsupported(relation, dead, front), "dropped")
        dead = dead.unionByName(front)
        used.append(front_at)
        n += 1
    now, _ = kept(_without(relation, dead), "arc-consistent")
    domains, _ = kept(_domains(now, pattern), "domains")
    drop(spark, *used)
    return domains, now


def path_consistent(relation: DataFrame, pattern: Pattern, either_way: bool = False) -> tuple[DataFrame, DataFrame]:
    """(domains, relation) once each pair also has, for each label next to both of its labels, a vertex that fits both.

    A vertex fits by all edges between the two labels, or with either_way by one of them, whatever its direction; that drops less.
    """
    spark = relation.sparkSession
    size, at = None, None
    while True:
        domains, relation = arc_consistent(relation, pattern)
        count = relation.count()
        if at:
            drop(spark, at)
        if count == size or count == 0:
            return domains, relation
        size = count
        parts = []
        for i, j in pattern.edges:
            pairs = edge(relation, i, j)
            for k in sorted((pattern.neighbours(i) & pattern.neighbours(j)) - {i, j}):
                left, right = (_both_ways(relation, pattern, v, k, either_way).withColumnRenamed("b", "z") for v in (i, j))
                fits = pairs.join(left.withColumnRenamed("a", "x"), "x").join(right.withColumnRenamed("a", "y"), ["y", "z"], "left_semi")
                pairs = fits.select("x", "y").distinct()
            parts.append(pairs.select(F.lit(i).alias("i"), F.lit(j).alias("j"), "x", "y"))
        relation, at = kept(reduce(DataFrame.unionByName, parts), "path-consistent")


def path_consistent_completed(relation: DataFrame, pattern: Pattern) -> tuple[DataFrame, DataFrame]:
    """As path_consistent, over the pattern with an edge more for each two edges in a row that none joins (see `completed`).

    The relation that comes back has the pairs of these edges too.
    """
    every, _ = kept(completed(relation, pattern), "completed")
    return path_consistent(every, Pattern.of([*pattern.edges, *virtual_edges(pattern)], pattern.delta))


def _both_ways(relation: DataFrame, pattern: Pattern, a: int, b: int, either_way: bool) -> DataFrame:
    """Pairs (a, b) of vertices of two labels that hold every edge between the labels, of either direction, or one of them."""
    ways = [edge(relation, a, b).selectExpr("x AS a", "y AS b")] if (a, b) in pattern.edges else []
    ways += [edge(relation, b, a).selectExpr("y AS a", "x AS b")] if (b, a) in pattern.edges else []
    return reduce(lambda p, q: p.unionByName(q).distinct() if either_way else p.join(q, ["a", "b"], "left_semi"), ways)


def result_totals(domains: DataFrame, relation: DataFrame) -> DataFrame:
    """label, vertices, out_supports, in_supports."""
    n = domains.groupBy("label").agg(F.count(F.lit(1)).alias("vertices"))
    out = relation.groupBy(F.col("i").alias("label")).agg(F.count(F.lit(1)).alias("out_supports"))
    into = relation.groupBy(F.col("j").alias("label")).agg(F.count(F.lit(1)).alias("in_supports"))
    return n.join(out, "label", "left").join(into, "label", "left").fillna(0, ["out_supports", "in_supports"]).select("label", "vertices", "out_supports", "in_supports")
