"""Binary distance relations: for each edge of a pattern, the pairs of its labels' vertices within delta."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import LabeledGraph
from ..plans.pattern import Pattern
from ..plans.storage import kept
from .distance import bounded_distances, closure
from .index import IN, OUT


def _of_edges(pairs: DataFrame, vertices: DataFrame, pattern: Pattern) -> DataFrame:
    """Pairs (x, y), each x of a left label, -> i, j, x, y for the pattern's edges; the edges are literals, so nothing is broadcast."""
    i, j = (vertices.select(F.col("vid").alias(v), F.col("label").alias(k)) for v, k in (("x", "i"), ("y", "j")))
    ends = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in pattern.edges]
    wanted = F.struct("i", "j").isin(*ends) if len(ends) > 1 else (F.col("i") == pattern.edges[0][0]) & (F.col("j") == pattern.edges[0][1])
    starts, stops = sorted({a for a, _ in pattern.edges}), sorted({b for _, b in pattern.edges})
    # the right ends first, as most pairs go there; the left ones all have a label of starts
    some = pairs.join(j.where(F.col("j").isin(stops)), "y")
    some = some.withColumn("i", F.lit(starts[0])) if len(starts) == 1 else some.join(i.where(F.col("i").isin(starts)), "x")
    return some.where(wanted).select("i", "j", "x", "y")


def _stored(relation: DataFrame) -> DataFrame:
    """Written in a folder for each edge, so that reading one edge reads nothing else."""
    return kept(relation, "relation", "i", "j")[0]


def distance_relation(graph: LabeledGraph, pattern: Pattern) -> DataFrame:
    """i, j, x, y by a search from the vertices of left labels only, no further than delta."""
    graph = graph.stored()
    seeds = graph.vertices.where(F.col("label").isin(sorted({i for i, _ in pattern.edges}))).select("vid")
    near = closure(seeds, graph.edges, pattern.delta, True).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    return _stored(_of_edges(near, graph.vertices, pattern))


class LabelWays:
    """Distances between the vertices of two labels, by a search over only those edges that a way between such labels can take.

    Each edge joins two labels; the lightest edge of each pair of labels bounds ways from below. There is one row for each such pair.
    """

    def __init__(self, graph: LabeledGraph):
        self.directed = graph.directed
        mark = graph.labelled or (lambda ends: ends.join(graph.vertices.select("vid", "label"), "vid"))
        tails = mark(graph.edges.where("src <> dst").withColumnRenamed("src", "vid")).withColumnsRenamed({"vid": "src", "label": "i"})
        self.edges = mark(tails.withColumnRenamed("dst", "vid")).withColumnsRenamed({"vid": "dst", "label": "j"})
        self.lightest = {(r["i"], r["j"]): r["w"] for r in self.edges.groupBy("i", "j").agg(F.min("w").alias("w")).collect()}
        if min(self.lightest.values(), default=1) < 1:
            raise ValueError("weights must be positive")
        labels = sorted({v for e in self.lightest for v in e})
        self.least = self.lightest | {(v, v): 0 for v in labels}
        for m in labels:
            for a in labels:
                for b in labels:
                    if (a, m) in self.least and (m, b) in self.least:
                        self.least[a, b] = min(self.least.get((a, b), 2**62), self.least[a, m] + self.least[m, b])

    def useful(self, ends: list[tuple[int, int]], delta: int) -> DataFrame:
        """src, dst, i, j, w: of parallel edges the lightest, of those that a way of at most delta between two labels of ends can take."""
        room: dict[int, list[tuple[int, int]]] = {}  # pairs of labels by the weight that an edge may have
        for (a, b), w in self.lightest.items():
            if (most := max((delta - self.least[i, a] - self.least[b, j] for i, j in ends if (i, a) in self.least and (b, j) in self.least), default=0)) >= w:
                room.setdefault(most, []).append((a, b))
        pair = F.struct("i", "j")
        among = lambda ends: pair.isin(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in ends)) if ends else F.lit(False)
        fits = reduce(lambda x, y: x | y, [among(ends) & (F.col("w") <= most) for most, ends in room.items()], F.lit(False))
        # the first condition reaches the scans, the second may need an aggregate
        found = self.edges.where(among([e for ends in room.values() for e in ends])).where(fits)
        return kept(found.groupBy("src", "dst", "i", "j").agg(F.min("w").alias("w")), "useful-edges")[0]

    def part(self, ends: list[tuple[int, int]], delta: int) -> LabeledGraph:
        """The stored graph of the useful edges: within delta, distances between labels of ends are those of the whole graph."""
        edges = self.useful(ends, delta)
        vertices, _ = kept(edges.select(F.explode(F.array(F.struct(F.col("src").alias("vid"), F.col("i").alias("label")), F.struct(F.col("dst").alias("vid"), F.col("j").alias("label")))).alias("v")).select("v.*").distinct(), "graph-vertices")
        return LabeledGraph(vertices, edges.select("src", "dst", "w"), self.directed, True)

    def near(self, i: int, j: int, delta: int, starts: DataFrame | None = None) -> DataFrame:
        """x, y, d: vertices of label i (those of starts (vid), if given) and of label j, another one, at most delta apart."""
        useful = self.useful([(i, j)], delta)
        seeds = useful.where(F.col("i") == i).select(F.col("src").alias("vid")).distinct()
        if starts is not None:
            seeds = seeds.join(starts, "vid", "left_semi")
        ends = useful.where(F.col("j") == j).select(F.col("dst").alias("y")).distinct()
        found = bounded_distances(seeds.select(F.col("vid").alias("key"), "vid"), useful.select("src", "dst", "w"), delta, True)
        return kept(found.select(F.col("key").alias("x"), F.col("vid").alias("y"), "d").join(ends, "y", "left_semi").select("x", "y", "d"), "near")[0]


def hub_relation(labels: DataFrame, vertices: DataFrame, pattern: Pattern) -> DataFrame:
    """i, j, x, y from hub labels: an equi-join on the hub with the bound on the sum. The threshold reaches the scan."""
    near = labels.where(F.col("d") <= pattern.delta)
    out = near.where(F.col("dir") == OUT).selectExpr("vid AS x", "hub", "d AS d1")
    into = near.where(F.col("dir") == IN).selectExpr("vid AS y", "hub", "d AS d2")
    starts, stops = (vertices.where(F.col("label").isin(sorted({e[k] for e in pattern.edges}))).select(F.col("vid").alias(v)) for k, v in ((0, "x"), (1, "y")))
    pairs = out.join(starts, "x", "left_semi").join(into.join(stops, "y", "left_semi"), "hub").where(F.col("d1") + F.col("d2") <= pattern.delta).select("x", "y").distinct()
    return _stored(_of_edges(pairs, vertices, pattern))


def edge(relation: DataFrame, i: int, j: int) -> DataFrame:
    return relation.where((F.col("i") == i) & (F.col("j") == j)).select("x", "y")


def composed(left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, z) and (z, y) -> the pairs (x, y) that some z joins."""
    return left.withColumnRenamed("y", "z").join(right.withColumnRenamed("x", "z"), "z").select("x", "y").distinct()


def virtual_edges(pattern: Pattern) -> list[tuple[int, int]]:
    """Pairs of labels that are joined by two edges but by none itself."""
    have = set(pattern.edges)
    return sorted({(i, j) for i, k in have for k2, j in have if k == k2 and i != j and (i, j) not in have})


def completed(relation: DataFrame, pattern: Pattern) -> DataFrame:
    """The relation, with a composed edge for each pair of labels that is joined by two edges but by none itself."""
    have = set(pattern.edges)
    more = virtual_edges(pattern)
    parts = [relation.select("i", "j", "x", "y")]
    for i, j in more:
        ways = [composed(edge(relation, i, k), edge(relation, k, j)) for k in sorted(pattern.neighbours(i) & pattern.neighbours(j)) if (i, k) in have and (k, j) in have]
        both = reduce(lambda a, b: a.join(b, ["x", "y"], "left_semi"), ways)
        parts.append(both.select(F.lit(i).alias("i"), F.lit(j).alias("j"), "x", "y"))
    return reduce(DataFrame.unionByName, parts)


def relation_sizes(relation: DataFrame) -> DataFrame:
    """i, j, pairs for each edge, and the total with null i and j."""
    return relation.rollup(F.struct("i", "j").alias("e")).agg(F.count(F.lit(1)).alias("pairs")).select("e.i", "e.j", "pairs")
