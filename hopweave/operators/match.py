"""Multiway natural join of distance relations, and what is counted over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import LabeledGraph
from ..plans.joins import dealt as _dealt
from ..plans.pattern import Pattern
from ..plans.storage import drop, kept
from .relation import LabelWays, distance_relation, edge


def _order(pattern: Pattern, sizes: dict[tuple[int, int], int] | None) -> list[tuple[int, int]]:
    """Edges of a connected order: what filters first, then the smallest relation; without sizes, the pattern's own."""
    if sizes is None:
        return list(pattern.edges)
    left = sorted(pattern.edges, key=lambda e: (sizes.get(e, 0), e))
    order, seen = [], set()
    while left:
        e = next((e for e in left if set(e) <= seen), None) or next((e for e in left if not seen or set(e) & seen), None) or left[0]
        left.remove(e)
        order.append(e)
        seen |= set(e)
    return order


def matches(relation: DataFrame, pattern: Pattern, sizes: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """One row for each match: a0, a1 ... by label. An edge whose ends are both there is a semi join, others bring in a column."""
    out: DataFrame | None = None
    seen: set[int] = set()
    waiting = _order(pattern, sizes)
    while waiting:
        e = next((e for e in waiting if set(e) <= seen), None) or next((e for e in waiting if not seen or set(e) & seen), None)
        if e is None:
            raise ValueError("the pattern is not connected")
        waiting.remove(e)
        i, j = e
        pairs = edge(relation, i, j)
        pairs = pairs.where("x = y").select(F.col("x").alias(f"a{i}")) if i == j else pairs.select(F.col("x").alias(f"a{i}"), F.col("y").alias(f"a{j}"))
        if out is None:
            out = pairs
        elif set(e) <= seen:
            out = out.join(pairs, sorted(pairs.columns), "left_semi")
        else:
            out = out.join(pairs, f"a{i}" if i in seen else f"a{j}")
        seen |= set(e)
    return out.select(*sorted(out.columns, key=lambda c: int(c[1:])))


def closing_edges(pattern: Pattern) -> dict[tuple[int, int], int]:
    """Edges (i, k) that two others, (i, j) and (j, k), go beside, with that j; none of the others is among them."""
    shut: dict[tuple[int, int], int] = {}
    legs: set[tuple[int, int]] = set()
    for i, k in pattern.edges:
        j = next((j for j in pattern.labels if len({i, j, k}) == 3 and {(i, j), (j, k)} <= set(pattern.edges) - set(shut)), None)
        if j is not None and (i, k) not in legs:
            shut[i, k] = j
            legs |= {(i, j), (j, k)}
    return shut


def searched_matches(graph: LabeledGraph, pattern: Pattern) -> DataFrame:
    """As matches of the graph's distance relation, without the pairs of its closing edges.

    Two legs that make no more than delta prove the edge that they go beside. Only where they make more, its pairs are searched for.
    """
    if any(i == j for i, j in pattern.edges):
        return matches(distance_relation(graph, pattern), pattern)
    ways, shut = LabelWays(graph), closing_edges(pattern)
    waiting = [e for e in pattern.edges if e not in shut]
    near = {e: ways.near(*e, pattern.delta) for e in waiting}
    out: DataFrame | None = None
    stored = True
    while waiting:
        e = next((e for e in waiting if out is None or {f"a{v}" for v in e} & set(out.columns)), None)
        if e is None:
            raise ValueError("the pattern is not connected")
        waiting.remove(e)
        pairs = near[e].select(F.col("x").alias(f"a{e[0]}"), F.col("y").alias(f"a{e[1]}"), F.col("d").alias(_leg(*e)))
        if out is None:
            out = pairs
        else:
            both = sorted(set(pairs.columns) & set(out.columns))
            out = _dealt(out, pairs, both[0]) if stored and len(both) == 1 else out.join(pairs, both)
            stored = False
    for (i, k), j in shut.items():
        one, two = near[i, j].select(F.col("y").alias("v"), F.col("d").alias("d1")).distinct(), near[j, k].select(F.col("x").alias("v"), F.col("d").alias("d2")).distinct()
        far, far_at = kept(one.join(two, "v").where(F.col("d1") + F.col("d2") > pattern.delta).select("v", "d1").distinct(), "far")
        if not far.isEmpty():
            starts = near[i, j].join(far, (F.col("y") == F.col("v")) & (F.col("d") == F.col("d1")), "left_semi").select(F.col("x").alias("vid")).distinct()
            proven = ways.near(i, k, pattern.delta, starts).select(F.col("x").alias(f"a{i}"), F.col("y").alias(f"a{k}"))
            enough = F.col(_leg(i, j)) + F.col(_leg(j, k)) <= pattern.delta
            out = out.where(enough).unionByName(out.where(~enough).join(proven, [f"a{i}", f"a{k}"], "left_semi"))
        drop(graph.edges.sparkSession, far_at)
    return out.select(*(f"a{v}" for v in sorted({v for e in pattern.edges for v in e})))


def _leg(i: int, j: int) -> str:
    return f"d{i}_{j}"


def match_count(relation: DataFrame, pattern: Pattern) -> DataFrame:
    return matches(relation, pattern).agg(F.count(F.lit(1)).alias("matches"))


def support_reach(relation: DataFrame, pattern: Pattern) -> DataFrame:
    """vid, reached: for each vertex that the first edge starts from, how many pairs that enter the last edge's right label
    can be reached from it along pairs of any edges (and one more if both labels are the same)."""
    spark = relation.sparkSession
    start, end = pattern.edges[0][0], pattern.edges[-1][1]
    steps, steps_at = kept(relation.select("x", "y").distinct(), "steps")
    done, at = kept(relation.where(F.col("i") == start).select(F.col("x").alias("s"), F.col("x").alias("v")).distinct(), "reached")
    front = done
    while True:
        met = front.join(steps, F.col("v") == F.col("x")).select("s", F.col("y").alias("v")).distinct()
        front, front_at = kept(met.join(done, ["s", "v"], "left_anti"), "front")
        if front.isEmpty():
            break
        more, more_at = kept(done.unionByName(front), "reached")
        drop(spark, at)
        done, at = more, more_at
    enter = relation.where(F.col("j") == end).select(F.col("x").alias("v"), F.col("y").alias("u")).distinct()
    starts = relation.where(F.col("i") == start).select(F.col("x").alias("vid")).distinct()
    got = done.join(enter, "v").groupBy(F.col("s").alias("vid")).agg(F.count(F.lit(1)).alias("n"))
    return starts.join(got, "vid", "left").select("vid", (F.coalesce("n", F.lit(0)) + F.lit(int(start == end))).alias("reached"))
