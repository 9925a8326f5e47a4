"""Lower bounds of distances by vectors (of landmarks or reference sets), areas of intervals, and band joins.

For distances to sets in a directed graph, max over dims of a(x) - a(y) is at most d(x, y); in an undirected one the
same holds of its absolute value. Where the vectors are distances from landmarks, the sides change places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import linf, nearest_gap, one_sided
from ..plans.pattern import Pattern
from ..plans.storage import drop, kept
from .consistency import arc_consistent


def areas(vectors: DataFrame, delta: int) -> DataFrame:
    """label, dim, lo, hi: the union of the intervals v - delta to v + delta of a label's vertices, as disjoint intervals.

    Equal values are made one before the window, so a label's window holds as many rows as it has distances.
    """
    spans = vectors.select("label", F.posexplode("v").alias("dim", "d")).distinct().select("label", "dim", (F.col("d") - delta).alias("lo"), (F.col("d") + delta).alias("hi"))
    order = Window.partitionBy("label", "dim").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0))
    return marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("label", "dim", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("label", "dim", "lo", "hi")


def in_area(vectors: DataFrame, area: DataFrame, label: int, partner: int) -> DataFrame:
    """Vertices of a label (vid) that are in some interval of the partner's area in every dim."""
    at = vectors.where(F.col("label") == label).select("vid", F.posexplode("v").alias("dim", "d"), F.size("v").alias("dims"))
    spans = area.where(F.col("label") == partner).select("dim", "lo", "hi")
    return at.join(spans, "dim").where("d BETWEEN lo AND hi").groupBy("vid", "dims").agg(F.count(F.lit(1)).alias("n")).where("n = dims").select("vid")


def area_pruned(vectors: DataFrame, pattern: Pattern, rounds: int = 50, left_only: bool = False) -> DataFrame:
    """label, vid: candidates that stay when, again and again, those outside a partner's area go. For undirected distances.

    With left_only, an edge prunes its left label only. Each round of an edge's two sides shrinks the areas of the next, so the end
    does not depend on the order of edges.
    """
    spark = vectors.sparkSession
    now, at = kept(vectors.where(F.col("label").isin(list(pattern.labels))), "candidates")
    size = now.count()
    for _ in range(rounds):
        area, area_at = kept(areas(now, pattern.delta), "areas")
        parts = []
        for label in pattern.labels:
            mine = now.where(F.col("label") == label)
            for partner in sorted({j for i, j in pattern.edges if i == label != j} if left_only else pattern.neighbours(label)):
                mine = mine.join(in_area(now, area, label, partner), "vid", "left_semi")
            parts.append(mine.select("vid", "label", "v"))
        now, new_at = kept(reduce(DataFrame.unionByName, parts), "candidates")
        drop(spark, at, area_at)
        at, count = new_at, now.count()
        if count == size:
            break
        size = count
    return now.select("label", "vid")


def distance_to_group(vectors: DataFrame, label: int) -> DataFrame:
    """vid, bound: over all dims, the most that a vertex's value is away from the nearest value of the label's vertices.

    No vertex of the label is nearer than that in an undirected graph. The group is its distinct values, of which a dim has
    as many as there are distances.
    """
    group = vectors.where(F.col("label") == label).select(F.posexplode("v").alias("dim", "d")).groupBy("dim").agg(F.collect_set("d").alias("values"))
    gaps = vectors.select("vid", F.posexplode("v").alias("dim", "d")).join(group, "dim").select("vid", nearest_gap(F.col("values"), F.col("d")).alias("gap"))
    return gaps.groupBy("vid").agg(F.max("gap").alias("bound"))


def band_pairs(vectors: DataFrame, pattern: Pattern, directed: bool = False) -> DataFrame:
    """i, j, x, y of an edge's labels whose bound is at most delta.

    An equi-join on the label pair and on bands of the dims that tell most apart (two, or one if directed), each left value
    going to its band and the next ones; then the bound over all dims. With directed vectors a band has no lower end, so
    the left value goes to all lower bands too; the other dims are filters.
    """
    width = max(pattern.delta, 1)
    by = _telling(vectors)[: 1 if directed else 2]
    band = lambda dim: F.floor(F.col("v")[dim] / width).cast("int")
    left, right = vectors.selectExpr("label AS i", "vid AS x", "v"), vectors.selectExpr("label AS j", "vid AS y", "v")
    left = left.where(F.col("i").isin(sorted({i for i, _ in pattern.edges})))
    right = right.where(F.col("j").isin(sorted({j for _, j in pattern.edges})))
    top = F.floor(F.lit(_most(vectors)) / width).cast("int") if directed else None
    for k, dim in enumerate(by):
        b = band(dim)
        right = right.withColumn(f"b{k}", b)
        left = left.withColumn(f"b{k}", F.explode(F.sequence(b - 1, F.greatest(top, b) if directed else b + 1)))
    keys = [f"b{k}" for k in range(len(by))]
    ends = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pattern.edges))
    left = left.withColumn("e", F.explode(ends)).where("e.i = i").select("i", "x", F.col("v").alias("a"), *keys, F.col("e.j").alias("j"))
    bound = one_sided(F.col("a"), F.col("v")) if directed else linf(F.col("a"), F.col("v"))
    return left.join(right, ["j", *keys]).where(bound <= pattern.delta).select("i", "j", "x", "y")


def _most(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.array_max("v"))).first()[0] or 0


def _telling(vectors: DataFrame) -> tuple[int, int]:
    """The two dims with the most even spread of values (least sum of squared shares)."""
    n = vectors.select(F.posexplode("v").alias("dim", "d")).groupBy("dim", "d").agg(F.count(F.lit(1)).alias("n"))
    dims = [r["dim"] for r in n.groupBy("dim").agg(F.sum(F.col("n").cast("double") ** 2).alias("s")).orderBy("s", "dim").limit(2).collect()]
    return (dims[0], dims[-1]) if dims else (0, 0)


def verified(pairs: DataFrame, distances: DataFrame, delta: int) -> DataFrame:
    """Of pairs (i, j, x, y), those whose distance in (src, dst, d) is at most delta."""
    return pairs.join(distances.where(F.col("d") <= delta).selectExpr("src AS x", "dst AS y"), ["x", "y"], "left_semi").select("i", "j", "x", "y")


def landmark_pruned(vectors: DataFrame, pattern: Pattern, directed: bool, to_fixpoint: bool = True) -> DataFrame:
    """label, vid: candidates with a partner within the bound for each edge, once or until nothing changes.

    vectors are distances to sets (directed) or of an undirected graph.
    """
    pairs, _ = kept(band_pairs(vectors, pattern, directed), "bounded-pairs")
    return arc_consistent(pairs, pattern, None if to_fixpoint else 1)[0]
