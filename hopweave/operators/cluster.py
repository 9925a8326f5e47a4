"""k-medoids of each label's vertices by vectors, and distance joins that skip pairs of clusters that are too far apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import linf, scatter
from ..plans.pattern import Pattern
from ..plans.storage import drop, kept
from .bounds import verified
from .consistency import arc_consistent


def seeds(vectors: DataFrame, k: int, salt: int = 0) -> DataFrame:
    """label, c: the first k vertices of each label in pseudo-random order (all, if there are fewer)."""
    order = Window.partitionBy("label").orderBy(scatter(F.col("vid"), salt), "vid")
    return vectors.select("label", "vid", F.row_number().over(order).alias("n")).where(F.col("n") <= k).select("label", F.col("vid").alias("c"))


def assigned(vectors: DataFrame, medoids: DataFrame) -> DataFrame:
    """label, c, member, dist: each vertex with its label's nearest medoid, the smaller in ties. A label has few medoids."""
    centres = vectors.select(F.col("vid").alias("c"), F.col("label"), F.col("v").alias("cv")).join(medoids, ["label", "c"], "left_semi")
    per = centres.groupBy("label").agg(F.collect_list(F.struct("c", "cv")).alias("centres"))
    near = F.array_min(F.transform("centres", lambda m: F.struct(linf(F.col("v"), m["cv"]).alias("dist"), m["c"].alias("c"))))
    return vectors.join(per, "label").select("label", near.alias("m"), F.col("vid").alias("member")).select("label", "m.c", "member", "m.dist")


def error(members: DataFrame) -> DataFrame:
    return members.groupBy("label").agg(F.sum("dist").alias("error"))


def k_medoids(vectors: DataFrame, k: int, rounds: int | None = None, salt: int = 0) -> DataFrame:
    """label, c, member, dist after trial swaps of a medoid for another vertex, each label's kept if its error falls.

    Without rounds, swaps go on until every medoid of every label has been tried in a row without gain. The swap of a round is
    fixed: the medoid at place `round` of the label's order, for the vertex next in its pseudo-random order. Empty
    labels have no clusters; labels of fewer than k vertices have one for each.
    """
    spark = vectors.sparkSession
    chosen, chosen_at = kept(seeds(vectors, k, salt), "medoids")
    members, members_at = kept(assigned(vectors, chosen), "members")
    r = idle = 0
    while idle < k if rounds is None else r < rounds:
        by = Window.partitionBy("label")
        place = chosen.withColumn("at", F.row_number().over(by.orderBy("c")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
        out = place.where((F.lit(r) % F.col("n")) == F.col("at")).select("label", F.col("c").alias("old"))
        rest = vectors.select("label", F.col("vid").alias("c")).join(chosen, ["label", "c"], "left_anti")
        new = rest.groupBy("label").agg(F.min_by("c", F.struct(scatter(F.col("c"), salt + r + 1).alias("s"), "c")).alias("new"))
        swap = out.join(new, "label")
        trial, trial_at = kept(chosen.join(swap, "label", "left").select("label", F.when(F.col("c") == F.col("old"), F.col("new")).otherwise(F.col("c")).alias("c")), "trial")
        tried, tried_at = kept(assigned(vectors, trial), "members")
        better, better_at = kept(error(tried).withColumnRenamed("error", "e").join(error(members), "label").where("e < error").select("label"), "better")
        r, idle = r + 1, idle + 1
        if not better.isEmpty():
            keep = lambda a, b: b.join(better, "label", "left_semi").unionByName(a.join(better, "label", "left_anti"))  # noqa: B023,E731
            (chosen, a), (members, b) = kept(keep(chosen, trial), "medoids"), kept(keep(members, tried), "members")
            drop(spark, chosen_at, members_at)
            chosen_at, members_at, idle = a, b, 0
        drop(spark, trial_at, tried_at, better_at)
    return members


def clusters(members: DataFrame) -> DataFrame:
    """label, c, r, members: the largest distance to the medoid, and how many there are."""
    return members.groupBy("label", "c").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("members"))


def cluster_pairs(members: DataFrame, vectors: DataFrame, pattern: Pattern) -> DataFrame:
    """i, j, c1, c2: pairs of clusters of an edge's labels that can hold a pair within delta (for undirected distances)."""
    own = clusters(members).join(vectors.select(F.col("vid").alias("c"), "v"), "c")
    ends = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pattern.edges))).alias("e")
    left = own.select(ends, F.col("label"), F.col("c").alias("c1"), F.col("r").alias("r1"), F.col("v").alias("v1")).where("e.i = label").select("e.i", "e.j", "c1", "r1", "v1")
    right = own.select(F.col("label").alias("j"), F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("v").alias("v2"))
    return left.join(right, "j").where(linf(F.col("v1"), F.col("v2")) <= F.col("r1") + F.col("r2") + F.lit(pattern.delta)).select("i", "j", "c1", "c2")


def cluster_join(members: DataFrame, vectors: DataFrame, pattern: Pattern) -> DataFrame:
    """i, j, x, y within delta by vectors, from pairs of clusters.

    A vertex within delta of y is within delta of y's ring about the medoid: rings of that width are part of the join's key, so a
    cluster's vertices meet those of three rings, however many it has.
    """
    own = members.join(vectors.select(F.col("vid").alias("member"), "v"), "member")
    centre = vectors.select(F.col("vid").alias("c1"), F.col("v").alias("cv"))
    pairs = cluster_pairs(members, vectors, pattern)
    right = pairs.join(own.select(F.col("c").alias("c2"), F.col("member").alias("y"), F.col("v").alias("b"), F.col("label").alias("j")), ["j", "c2"]).join(centre, "c1").withColumn("away", linf(F.col("cv"), F.col("b"))).select("i", "j", "c1", "y", "b", "away")
    delta, width = F.lit(pattern.delta), max(pattern.delta, 1)
    ring = lambda d: F.floor(d / width).cast("int")
    right = right.withColumn("ring", F.explode(F.sequence(ring(F.col("away") - delta), ring(F.col("away") + delta))))
    left = own.select(F.col("label").alias("i"), F.col("c").alias("c1"), F.col("member").alias("x"), F.col("v").alias("a"), "dist", ring(F.col("dist")).alias("ring"))
    return left.join(right, ["i", "c1", "ring"]).where(F.col("dist").between(F.col("away") - delta, F.col("away") + delta)).where(linf(F.col("a"), F.col("b")) <= delta).select("i", "j", "x", "y")


def multiway_distance_join(members: DataFrame, vectors: DataFrame, distances: DataFrame, pattern: Pattern, rounds: int | None = None) -> DataFrame:
    """i, j, x, y: the pairs of each edge within delta (src, dst, d) whose vertices have partners for all edges.

    Edge by edge: candidates from pairs of clusters, of those vertices only that earlier edges of their label have left;
    then the exact distance; then, over all edges, semi joins until nothing changes (or so many rounds). `match.matches`
    makes tuples of what is left. For undirected distances.
    """
    spark = members.sparkSession
    left: dict[int, DataFrame] = {}
    parts, used = [], []
    for i, j in pattern.edges:
        mine = members
        for label in {i, j} & left.keys():
            mine = mine.where(F.col("label") != label).unionByName(mine.where(F.col("label") == label).join(left[label], "member", "left_semi").select(mine.columns))
        pairs, at = kept(verified(cluster_join(mine, vectors, Pattern(((i, j),), pattern.delta)), distances, pattern.delta), "edge-pairs")
        left[i], left[j] = pairs.select(F.col("x").alias("member")).distinct(), pairs.select(F.col("y").alias("member")).distinct()
        parts.append(pairs)
        used.append(at)
    _, reduced = arc_consistent(reduce(DataFrame.unionByName, parts), pattern, rounds)
    drop(spark, *used)
    return reduced
