"""Shortest distances from many sources at once.

Weights are positive integers. All sources are searched together. In the bounded form a round takes what the last
one made shorter along one edge more, so there are as many rounds as a shortest path of at most the limit has edges, never
more than limit / lightest weight. The distances so far stand in buckets of (key, vid) in the shared folder: a round moves only
what it has met, once, and joins it to them where they are. Plans stay short, and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.joins import dealt
from ..plans.storage import drop, kept, kept_in_buckets


def bounded_distances(seeds: DataFrame, edges: DataFrame, limit: int, simple: bool = False) -> DataFrame:
    """seeds (key, vid) -> key, vid, d: distances of at most limit from any seed of the key. Key is of any type that can be hashed.

    Edges of a stored graph are simple; others are written here first, one for each pair of ends.
    """
    spark = seeds.sparkSession
    edges_at = None
    if not simple:
        edges, edges_at = kept(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")).where(F.col("w") <= limit), "edges")
    if (low := edges.agg(F.min("w")).first()[0]) is not None and low < 1:
        raise ValueError("weights must be positive")
    best, at = kept_in_buckets(seeds.select("key", "vid").distinct().select("key", "vid", F.lit(0).alias("d"), F.lit(True).alias("fresh")), "distances", "key", "vid")
    fresh = low is not None and low <= limit
    # what has become shorter and can go on
    shorter = F.coalesce(F.col("n") < F.col("d"), F.col("d").isNull()) & (F.col("n") + F.lit(low) <= limit)
    while fresh:
        met = best.where("fresh").drop("fresh").join(edges.withColumnRenamed("src", "vid"), "vid").select("key", F.col("dst").alias("vid"), (F.col("d") + F.col("w")).alias("n"))
        met = met.where(F.col("n") <= limit).groupBy("key", "vid").agg(F.min("n").alias("n"))
        both = best.drop("fresh").join(met, ["key", "vid"], "full").select("key", "vid", F.least("d", "n").alias("d"), F.coalesce(shorter, F.lit(False)).alias("fresh"))
        seen = Observation()
        new, new_at = kept_in_buckets(both.observe(seen, F.count_if("fresh").alias("fresh")), "distances", "key", "vid")
        fresh = seen.get["fresh"]
        drop(spark, at)
        best, at = new, new_at
    if edges_at:
        drop(spark, edges_at)
    return best.select("key", "vid", "d")


def guided_distances(pairs: DataFrame, edges: DataFrame, vectors: DataFrame, limit: int, directed: bool = True) -> DataFrame:
    """pairs (src, dst) -> src, dst, d of those within limit, by a search that bounds guide.

    vectors (vid, v) bound distances from below (see `bounds`). Each src is searched from once, whatever the number of its pairs: what
    has come d far goes on only where d and the bound to the box around its targets' vectors make no more than limit.
    """
    own = pairs.select("src", "dst").distinct()
    goals = own.join(vectors.selectExpr("vid AS dst", "v"), "dst")
    starts = goals.groupBy("src").agg(*_box(vectors))
    return _guided(starts, goals.select(F.col("dst").alias("vid")).distinct(), edges, vectors, limit, directed).join(own, ["src", "dst"], "left_semi").select("src", "dst", "d")


def guided_to_group(sources: DataFrame, targets: DataFrame, edges: DataFrame, vectors: DataFrame, limit: int, directed: bool = True) -> DataFrame:
    """As guided_distances, from each of sources (vid) to each of targets (vid); their pairs are never listed."""
    targets = targets.select("vid").distinct()
    return _guided(_towards(sources, targets, vectors), targets, edges, vectors, limit, directed)


def guided_by_roots(sources: DataFrame, targets: DataFrame, edges: DataFrame, vectors: DataFrame, limit: int, directed: bool = True) -> DataFrame:
    """As guided_to_group, without a row for a target with a single in-edge: it hangs from its root (see `rooted`).

    Only roots are searched; pairs of a source and what hangs from the roots that it meets are made as they are read.
    """
    spark = sources.sparkSession
    targets = targets.select("vid").distinct()
    edges, edges_at = kept(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")).where(F.col("w") <= limit), "edges")
    if (least := edges.agg(F.min("w")).first()[0]) is not None and least < 1:
        raise ValueError("weights must be positive")
    fixed = sources.select("vid").distinct()
    roots, roots_at = kept(rooted(edges.select(F.explode(F.array("src", "dst")).alias("vid")).unionByName(fixed).distinct(), edges, fixed).where("root IS NOT NULL"), "roots")
    core, core_at = kept(contracted(edges, roots, F.min("w")), "core")
    hung, hung_at = kept(roots.join(targets, "vid", "left_semi").where(F.col("off") <= limit).select("root", F.col("vid").alias("dst"), "off"), "hung")
    met = _guided(_towards(fixed, targets, vectors), hung.select(F.col("root").alias("vid")).distinct(), core, vectors, limit, directed).select("src", F.col("dst").alias("root"), F.col("d").alias("up"))
    # what hangs from a root, for each distance that it is met at: the pairs need no condition
    within, _ = kept(hung.join(met.select("root", "up").distinct(), "root").where(F.col("up") + F.col("off") <= limit).select("root", "up", "dst", (F.col("up") + F.col("off")).cast("int").alias("d")), "within")
    drop(spark, edges_at, roots_at, core_at, hung_at)
    return dealt(met, within, ["root", "up"]).select("src", "dst", "d")


def _towards(sources: DataFrame, targets: DataFrame, vectors: DataFrame) -> DataFrame:
    """src, high, low: each of sources (vid) with the box around the vectors of targets (vid)."""
    box = vectors.join(targets, "vid", "left_semi").agg(*_box(vectors))
    return sources.select(F.col("vid").alias("src")).distinct().crossJoin(F.broadcast(box))  # one row


def _box(vectors: DataFrame) -> list[Column]:
    """The largest and the smallest of each component of v."""
    first = vectors.select(F.size("v")).first()
    dims = range(first[0] if first else 0)
    return [F.array(*(f(F.col("v")[k]) for k in dims)).alias(name) for f, name in ((F.max, "high"), (F.min, "low"))]


def _guided(starts: DataFrame, targets: DataFrame, edges: DataFrame, vectors: DataFrame, limit: int, directed: bool) -> DataFrame:
    """starts (src, high, low: the box of its targets' vectors), targets (vid) -> src, dst, d of all targets within limit that are in the box of src."""
    spark = starts.sparkSession
    starts, starts_at = kept(starts, "starts")
    edges, edges_at = kept(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")).where(F.col("w") <= limit).selectExpr("src AS at", "dst AS to", "w"), "edges")
    if (least := edges.agg(F.min("w")).first()[0]) is not None and least < 1:
        raise ValueError("weights must be positive")
    ends, ends_at = kept(vectors.selectExpr("vid AS to", "v").join(targets.select(F.col("vid").alias("to"), F.lit(True).alias("goal")), "to", "left").select("to", "v", F.coalesce("goal", F.lit(False)).alias("goal")), "ends")
    # a vertex that is no target needs an edge more
    more = F.when(F.col("goal"), 0).otherwise(least)
    steps = edges.join(ends, "to").where(F.col("w") + more <= limit)
    onward = steps.groupBy(F.col("at").alias("to")).agg(F.min(F.col("w") + more).alias("onward"))
    steps, steps_at = kept(steps.join(onward, "to", "left"), "steps")
    seeds = starts.select("src", F.col("src").alias("to")).join(ends.select("to", "goal"), "to", "left").join(onward, "to", "left").fillna({"goal": False})
    best, at = kept_in_buckets(seeds.select("src", F.col("to").alias("at"), F.lit(0).alias("d"), "goal", F.coalesce(F.col("onward") <= limit, F.lit(False)).alias("fresh")), "guided", "src", "at")
    gap = lambda k: F.greatest(k["v"] - k["high"], F.lit(0) if directed else k["low"] - k["v"], F.lit(0))
    bound = F.array_max(F.transform(F.arrays_zip("v", "high", "low"), gap))
    shorter = F.coalesce(F.col("n") < F.col("d"), F.col("d").isNull()) & (F.col("n") + F.col("onward") <= limit)
    while not best.where("fresh").isEmpty():
        met = best.where("fresh").select("src", "at", "d").join(starts, "src").join(steps, "at").where(F.col("d") + F.col("w") + F.greatest(bound, more) <= limit)
        met = met.groupBy("src", F.col("to").alias("at")).agg(F.min(F.col("d") + F.col("w")).alias("n"), F.max("goal").alias("meets"), F.max("onward").alias("onward"))
        both = best.drop("fresh").join(met, ["src", "at"], "full").select("src", "at", F.least("d", "n").alias("d"), F.coalesce("goal", "meets").alias("goal"), F.coalesce(shorter, F.lit(False)).alias("fresh"))
        new, new_at = kept_in_buckets(both, "guided", "src", "at")
        drop(spark, at)
        best, at = new, new_at
    drop(spark, starts_at, edges_at, ends_at, steps_at)
    return best.where("goal").select("src", F.col("at").alias("dst"), "d")


def rooted(ends: DataFrame, edges: DataFrame, fixed: DataFrame) -> DataFrame:
    """vid, root, off for each vertex of ends (vid); edges have one weight for each pair of ends, and no loops.

    A vertex with a single in-edge is reached only through its predecessor: its root is the predecessor's, off the way
    from there. All others, and those of fixed (vid), are their own roots. Ways are doubled, so a chain takes a
    logarithm of its length in rounds. Vertices behind a cycle of single in-edges have a null root.
    """
    spark = edges.sparkSession
    single = edges.groupBy(F.col("dst").alias("vid")).agg(F.min("src").alias("up"), F.min("w").cast("long").alias("off"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n").join(fixed, "vid", "left_anti")
    first = ends.join(single, "vid", "left").select("vid", F.coalesce("up", "vid").alias("up"), F.coalesce("off", F.lit(0)).alias("off"), F.col("up").isNull().alias("done"))
    now, at = kept(first, "rooted")
    for _ in range(now.count().bit_length() + 1):
        if now.where("NOT done").isEmpty():
            break
        above = now.selectExpr("vid AS mid", "up AS top", "off AS more", "done AS ends")
        longer = now.where("NOT done").join(above, F.col("up") == F.col("mid")).select("vid", F.col("top").alias("up"), (F.col("off") + F.col("more")).alias("off"), F.col("ends").alias("done"))
        new, new_at = kept(now.where("done").unionByName(longer), "rooted")
        drop(spark, at)
        now, at = new, new_at
    return now.select("vid", F.when(F.col("done"), F.col("up")).alias("root"), "off")


def contracted(edges: DataFrame, roots: DataFrame, best: Column) -> DataFrame:
    """src, dst, w between roots: every edge into a root, begun at the root of its other end; of parallel ones the best."""
    into = edges.join(roots.where("vid = root").selectExpr("vid AS dst"), "dst", "left_semi")
    return into.join(roots.where("root IS NOT NULL").selectExpr("vid AS src", "root", "off"), "src").select(F.col("root").alias("src"), "dst", (F.col("w") + F.col("off")).alias("w")).groupBy("src", "dst").agg(best.alias("w"))


def all_distances(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """As bounded_distances, without a bound: what improved in a round goes on, until nothing does.

    Rounds go over roots (see `rooted`; seeds are roots), and what hangs from a root is added at the end.
    """
    spark = seeds.sparkSession
    seeds, seeds_at = kept(seeds.select("key", "vid").distinct(), "seeds")
    edges, edges_at = kept(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    fixed = seeds.select("vid").distinct()
    roots, roots_at = kept(rooted(edges.select(F.explode(F.array("src", "dst")).alias("vid")).unionByName(fixed).distinct(), edges, fixed).where("root IS NOT NULL"), "roots")
    core, core_at = kept(contracted(edges, roots, F.min("w")).withColumnRenamed("src", "vid"), "core")
    best, best_at = kept(seeds.withColumn("d", F.lit(0).cast("long")), "best")
    front, front_at = best, None
    while True:
        met = front.join(core, "vid").select("key", F.col("dst").alias("vid"), (F.col("d") + F.col("w")).alias("n")).groupBy("key", "vid").agg(F.min("n").alias("n"))
        new, new_at = kept(met.join(best, ["key", "vid"], "left").where("d IS NULL OR n < d").select("key", "vid", F.col("n").alias("d")), "front")
        if new.isEmpty():
            drop(spark, seeds_at, edges_at, core_at)
            return best.withColumnRenamed("vid", "root").join(roots, "root").select("key", "vid", (F.col("d") + F.col("off")).cast("int").alias("d"))
        merged, at = kept(best.unionByName(new).groupBy("key", "vid").agg(F.min("d").alias("d")), "best")
        drop(spark, best_at, *([front_at] if front_at else []))
        best, best_at, front, front_at = merged, at, new, new_at


def closure(seeds: DataFrame, edges: DataFrame, limit: int, simple: bool = False) -> DataFrame:
    """src, dst, d for each seed vertex (vid)."""
    return bounded_distances(seeds.select(F.col("vid").alias("key"), "vid"), edges, limit, simple).select(F.col("key").alias("src"), F.col("vid").alias("dst"), "d")


def parents(distances: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortest-path trees of (key, vid, d): key, vid, parent (the smallest that a shortest path may come from), d."""
    come = distances.selectExpr("key", "vid AS src", "d AS before").join(edges, "src").select("key", "src", F.col("dst").alias("vid"), (F.col("before") + F.col("w")).alias("d"))
    return distances.join(come, ["key", "vid", "d"], "left").groupBy("key", "vid", "d").agg(F.min("src").alias("parent")).select("key", "vid", "parent", "d")
