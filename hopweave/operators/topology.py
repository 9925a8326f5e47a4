"""Components, levels and reachability of directed graphs, and dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import drop, kept, kept_in_buckets
from .distance import contracted, rooted


def _least(start: DataFrame, edges: DataFrame) -> tuple[DataFrame, str]:
    """vid, c: the smallest c that reaches each vertex along edges, and where it is kept. One message for each edge and round."""
    spark = start.sparkSession
    now, at = kept(start, "least")
    front, front_at = now, None
    while True:
        met = front.join(edges, F.col("vid") == F.col("src")).groupBy(F.col("dst").alias("vid")).agg(F.min("c").alias("n"))
        new, new_at = kept(met.join(now, "vid").where("n < c").select("vid", F.col("n").alias("c")), "front")
        if new.isEmpty():
            drop(spark, new_at, *([front_at] if front_at else []))
            return now, at
        merged, merged_at = kept(now.unionByName(new).groupBy("vid").agg(F.min("c").alias("c")), "least")
        drop(spark, at, *([front_at] if front_at else []))
        now, at, front, front_at = merged, merged_at, new, new_at


def strong_components(edges: DataFrame) -> DataFrame:
    """vid, comp (the smallest member) of vertices in strongly connected components of two or more.

    Forward and backward colouring: each vertex takes the smallest that reaches it; what reaches that one back within its
    colour is its component, which goes; first, vertices without in- or out-edges go, round by round.
    """
    spark = edges.sparkSession
    left, left_at = kept(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    found: DataFrame | None = None
    while True:
        size = None
        while (n := left.count()) != size:
            size = n
            trimmed = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            fewer, at = kept(trimmed.select("src", "dst"), "edges")
            drop(spark, left_at)
            left, left_at = fewer, at
        if not size:
            drop(spark, left_at)
            break
        vertices = left.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
        colour, colour_at = _least(vertices.select("vid", F.col("vid").alias("c")), left)
        inner = left.join(colour.selectExpr("vid AS src", "c AS c1"), "src").join(colour.selectExpr("vid AS dst", "c AS c2"), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("c"))
        inner, inner_at = kept(inner, "inner")
        back, back_at = _least(vertices.join(colour, "vid").select("vid", F.when(F.col("vid") == F.col("c"), F.col("c")).otherwise(F.lit(2**63 - 1)).alias("c")), inner.selectExpr("dst AS src", "src AS dst"))
        mine, _ = kept(back.where(F.col("c") < 2**63 - 1).select("vid", F.col("c").alias("comp")), "component")
        found = mine if found is None else found.unionByName(mine)
        gone = mine.select("vid")
        fewer, at = kept(left.join(gone.selectExpr("vid AS src"), "src", "left_anti").join(gone.selectExpr("vid AS dst"), "dst", "left_anti").select("src", "dst"), "edges")
        drop(spark, left_at, colour_at, inner_at, back_at)
        left, left_at = fewer, at
    if found is None:
        return edges.selectExpr("src AS vid", "src AS comp").limit(0)
    several = found.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("comp")
    return found.join(several, "comp", "left_semi").select("vid", "comp")


def topological_levels(edges: DataFrame) -> DataFrame:
    """vid, level: the longest path that ends at each vertex of an acyclic graph; raises if there is a cycle.

    A vertex with one in-edge is a level after its predecessor, so such vertices are counted from their root by doubling;
    rounds go over roots only, and a chain takes one of them.
    """
    spark = edges.sparkSession
    edges, edges_at = kept(edges.select("src", "dst").distinct(), "edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    roots = rooted(ends, edges.withColumn("w", F.lit(1)), ends.limit(0))
    if not roots.where("root IS NULL").isEmpty():
        raise ValueError("the graph has a cycle")
    core, core_at = kept(contracted(edges.withColumn("w", F.lit(1)), roots, F.max("w")), "core")
    now, at = kept(roots.where("vid = root").select("vid", F.lit(0).alias("level")), "levels")
    front, front_at, rounds, most = now, None, 0, None
    while True:
        met = front.join(core, F.col("vid") == F.col("src")).groupBy(F.col("dst").alias("vid")).agg(F.max(F.col("level") + F.col("w")).alias("n"))
        new, new_at = kept(met.join(now, "vid").where("n > level").select("vid", F.col("n").alias("level")), "front")
        if new.isEmpty():
            drop(spark, edges_at, core_at)
            return roots.join(now.withColumnRenamed("vid", "root"), "root").select("vid", (F.col("level") + F.col("off")).cast("int").alias("level"))
        rounds += 1
        most = most if most is not None else now.count()
        if rounds >= most:
            raise ValueError("the graph has a cycle")
        merged, merged_at = kept(now.unionByName(new).groupBy("vid").agg(F.max("level").alias("level")), "levels")
        drop(spark, at, *([front_at] if front_at else []))
        now, at, front, front_at = merged, merged_at, new, new_at


def reachability(edges: DataFrame, span: int = 4096) -> DataFrame:
    """src, dst: all pairs with a path of an edge or more. Pairs are made as they are read; only chains and the pairs of chains are written.

    A chain is a path whose inner edges are the only ones out of and into their ends, so it is entered at its head and left at its
    tail, and what reaches its head reaches all of it. Pairs within a chain follow from places, those between chains from
    the closure over chains. `span` places of a chain at a time are joined to what comes after them.
    """
    spark = edges.sparkSession
    edges, edges_at = kept(edges.select("src", "dst").distinct(), "edges")
    chains, heads, heads_at, loops = _chains(edges)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = chains.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"pos div {span}"))))
    placed, _ = kept_in_buckets(dealt.repartition(parts, "chain", "piece"), "chains", "chain", "piece")
    own = placed.where(f"piece = pos div {span}")
    inside = own.select("chain", "piece", F.col("vid").alias("src"), F.col("pos").alias("p")).join(placed.select("chain", "piece", F.col("vid").alias("dst"), F.col("pos").alias("q")), ["chain", "piece"]).where("p < q").select("src", "dst")
    if heads.isEmpty() and loops is None:
        drop(spark, edges_at, heads_at)
        return inside
    steps = edges.join(heads.withColumnRenamed("vid", "dst"), "dst", "left_semi").join(own.select(F.col("vid").alias("src"), "chain"), "src").select(F.col("chain").alias("src"), "dst").distinct()
    over = _doubled(steps if loops is None else steps.unionByName(loops.selectExpr("chain AS src", "chain AS dst").distinct()))
    drop(spark, edges_at, heads_at)
    between = over.selectExpr("src AS c1", "dst AS c2").join(own.selectExpr("chain AS c1", "vid AS src", "pos AS p"), "c1").join(own.selectExpr("chain AS c2", "vid AS dst", "pos AS q"), "c2")
    return inside.unionByName(between.where("c1 <> c2 OR p >= q").select("src", "dst"))


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, str, DataFrame | None]:
    """Of stored edges (src, dst): vid, chain (its head), pos from 0; heads with in-edges (vid), and where they are kept; and closed chains, if any.

    Places are found by doubling. A closed chain has the smallest vertex for its head, and all of its vertices have place 0.
    """
    spark = edges.sparkSession
    none = F.lit(None).cast(edges.schema["src"].dataType)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("vid"), F.lit(1).alias("out"), none.alias("prev")), F.struct(F.col("dst").alias("vid"), F.lit(0).alias("out"), F.col("src").alias("prev")))).alias("e")).select("e.*")
    ends, ends_at = kept(ends.groupBy("vid").agg(F.sum("out").alias("outs"), F.count("prev").alias("ins"), F.max("prev").alias("prev")), "ends")
    # only those with one in-edge move
    single = ends.where("ins = 1 AND prev <> vid").select("vid", "prev").join(ends.where("outs = 1").select(F.col("vid").alias("prev")), "prev").select("vid", F.col("prev").alias("up"))
    first, first_at = kept(ends.select("vid", "ins").join(single, "vid", "left"), "first")
    heads, heads_at = kept(first.where("up IS NULL AND ins > 0").select("vid"), "heads")
    now, at = kept(first.select("vid", F.coalesce("up", "vid").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.col("up").isNull().alias("done")), "places")
    drop(spark, ends_at)
    left, before = now.where("NOT done").count(), -1
    while left and left != before:  # the first places of a chain are settled in each round, so what stays as it was is closed
        above = now.selectExpr("vid AS mid", "up AS top", "pos AS more", "done AS ends")
        longer = now.where("NOT done").join(above, F.col("up") == F.col("mid")).select("vid", F.col("top").alias("up"), (F.col("pos") + F.col("more")).alias("pos"), F.col("ends").alias("done"))
        new, new_at = kept(now.where("done").unionByName(longer), "places")
        drop(spark, at)
        now, at = new, new_at
        left, before = now.where("NOT done").count(), left
    chains = now.where("done").select("vid", F.col("up").alias("chain"), "pos")
    loops = _closed(first.join(now.where("NOT done").select("vid"), "vid", "left_semi").select("vid", "up")) if left else None
    drop(spark, first_at)
    return chains if loops is None else chains.unionByName(loops.select("vid", "chain", F.lit(0).cast("long").alias("pos"))), heads, heads_at, loops


def _closed(links: DataFrame) -> DataFrame:
    """vid, chain: the smallest vertex of each cycle of links (vid, up), by doubling."""
    spark = links.sparkSession
    now, at = kept(links.select("vid", "up", F.least("vid", "up").alias("low"), F.lit(True).alias("new")), "closed")
    while not now.where("new").isEmpty():
        above = now.selectExpr("vid AS mid", "up AS top", "low AS least")
        new, new_at = kept(now.join(above, F.col("up") == F.col("mid")).select("vid", F.col("top").alias("up"), F.least("low", "least").alias("low"), (F.col("least") < F.col("low")).alias("new")), "closed")
        drop(spark, at)
        now, at = new, new_at
    return now.select("vid", F.col("low").alias("chain"))


def _doubled(edges: DataFrame) -> DataFrame:
    """src, dst: all pairs with a path of an edge or more, by doubling of path lengths. A round joins what the last one found only."""
    spark = edges.sparkSession
    now, at = kept(edges.select("src", "dst").distinct(), "reach")
    front, front_at = now, None
    while True:
        longer = lambda a, b: a.selectExpr("src", "dst AS mid").join(b.selectExpr("src AS mid", "dst"), "mid").select("src", "dst")
        met = longer(front, now) if front_at is None else longer(front, now).unionByName(longer(now, front))
        new, new_at = kept(met.distinct().join(now, ["src", "dst"], "left_anti"), "reach-front")
        if new.isEmpty():
            return now
        merged, merged_at = kept(now.unionByName(new), "reach")
        drop(spark, at, *([front_at] if front_at else []))
        now, at, front, front_at = merged, merged_at, new, new_at


def dense_ids(ordered: DataFrame, key: str, position: str, first: int = 0) -> DataFrame:
    """key, id: numbers from `first` on in the order in which keys are first met.

    First positions are sorted in ranges over all tasks; only a count for each range is summed in sequence.
    """
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = ordered.groupBy(key).agg(F.min(position).alias("_at"))
    rows, _ = kept(kept(met, "first-met")[0].repartitionByRange(parts, "_at", key).sortWithinPartitions("_at", key).withColumn("_place", F.monotonically_increasing_id()), "dense-ids")
    rows = rows.withColumn("_part", F.shiftright("_place", 33))
    runs = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_from"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(runs.select("_part", "_from", before.alias("_before")), "_part").select(key, (F.col("_place") - F.col("_from") + F.col("_before") + F.lit(first)).alias("id"))
