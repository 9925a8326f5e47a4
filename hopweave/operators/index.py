"""Distance indexes: hub labels, a pruned form of them, landmarks, and embeddings by reference sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import scatter
from ..plans.graph import LabeledGraph
from ..plans.storage import kept
from .distance import bounded_distances, closure

OUT, IN = 0, 1
#: Pseudo-random orders are below this (see `scatter`).
_RANGE = 1000003


def hub_labels(graph: LabeledGraph, limit: int, labels: tuple[int, int] | None = None) -> DataFrame:
    """vid, dir, hub, d: for OUT the distance from vid to hub, for IN from hub to vid; (v, v, 0) included.

    With all vertices, IN labels are the OUT labels the other way round, so one search serves both.
    """
    graph = graph.stored()
    seeds = graph.vertices if labels is None else graph.labeled(*labels)
    out, _ = kept(closure(seeds, graph.edges, limit, True), "out-labels")
    back = out.selectExpr("dst AS src", "src AS dst", "d") if labels is None else closure(seeds, graph.reversed().edges, limit, True)
    return _tagged(out, OUT).unionByName(_tagged(back, IN))


def _tagged(pairs: DataFrame, way: int) -> DataFrame:
    return pairs.select(F.col("src").alias("vid"), F.lit(way).alias("dir"), F.col("dst").alias("hub"), "d")


def hub_distances(labels: DataFrame) -> DataFrame:
    """src, dst, d: the least sum over common hubs."""
    out = labels.where(F.col("dir") == OUT).selectExpr("vid AS src", "hub", "d AS d1")
    into = labels.where(F.col("dir") == IN).selectExpr("vid AS dst", "hub", "d AS d2")
    return out.join(into, "hub").groupBy("src", "dst").agg(F.min(F.col("d1") + F.col("d2")).alias("d"))


def pruned_hub_labels(graph: LabeledGraph, limit: int, first: int = 64, order: DataFrame | None = None) -> DataFrame:
    """Hub labels that still give all distances of at most limit, with fewer rows.

    Hubs are taken by degree, or by an order (vid, place; see `cover`), in batches that grow fourfold. A label is left out if labels
    of earlier batches give its distance already; that never loses a distance, as the pair's earliest hub on a shortest path is
    never left out.
    """
    graph = graph.stored()
    if order is None:
        order = graph.edges.select(F.explode(F.array("src", "dst")).alias("vid")).groupBy("vid").agg((-F.count(F.lit(1))).alias("place"))
    order, _ = kept(order, "hub-order")
    # batches are ranges of places, from the counts of each place (of degrees, under the square root of twice the edges): no order over all vertices in one task
    counts = order.groupBy("place").agg(F.count(F.lit(1)).alias("c")).orderBy("place").collect()
    batches, size, most = [], 0, first
    for r in counts:
        if not size:
            batches.append([r["place"], r["place"]])
        batches[-1][1] = r["place"]
        size += r["c"]
        if size >= most:
            size, most = 0, most * 4
    found: DataFrame | None = None
    for low, high in batches:
        seeds = order.where(F.col("place").between(low, high)).select("vid")
        to_hub = closure(seeds, graph.reversed().edges, limit, True).selectExpr("dst AS vid", f"{OUT} AS dir", "src AS hub", "d")
        from_hub = closure(seeds, graph.edges, limit, True).selectExpr("dst AS vid", f"{IN} AS dir", "src AS hub", "d")
        if found is not None:
            to_hub, from_hub = (_uncovered(x, found, way) for x, way in ((to_hub, OUT), (from_hub, IN)))
        new = to_hub.unionByName(from_hub)
        found, _ = kept(new if found is None else found.unionByName(new), "pruned-labels")
    if found is None:
        found = graph.vertices.selectExpr("vid", "0 AS dir", "vid AS hub", "0 AS d").limit(0)
    return found


def average_list_length(labels: DataFrame) -> DataFrame:
    """dir, vertices, average: how many labels a vertex has on average."""
    return labels.groupBy("dir", "vid").agg(F.count(F.lit(1)).alias("n")).groupBy("dir").agg(F.count(F.lit(1)).alias("vertices"), (F.sum("n").cast("double") / F.count(F.lit(1)).cast("double")).alias("average"))


def _uncovered(new: DataFrame, found: DataFrame, way: int) -> DataFrame:
    """Labels (vid, dir, hub, d) for which no hub in found gives a distance of at most d; v to v always stays."""
    mine = found.where(F.col("dir") == way).selectExpr("vid", "hub AS via", "d AS d1")
    other = found.where(F.col("dir") == 1 - way).selectExpr("vid AS hub", "hub AS via", "d AS d2")
    by = new.where("vid <> hub").join(mine, "vid").join(other, ["hub", "via"]).where("d1 + d2 <= d").select("vid", "hub").distinct()
    return new.join(by, ["vid", "hub"], "left_anti")


def random_landmarks(graph: LabeledGraph, n: int, salt: int = 0) -> DataFrame:
    """n vertices by pseudo-random order: landmark."""
    return graph.vertices.orderBy(scatter(F.col("vid"), salt), "vid").limit(n).select(F.col("vid").alias("landmark"))


def farthest_landmarks(graph: LabeledGraph, n: int, limit: int, salt: int = 0) -> DataFrame:
    """Landmarks one by one, each the farthest (within limit; smallest vid in ties) from those before it."""
    graph = graph.stored()
    chosen, _ = kept(random_landmarks(graph, 1, salt), "landmarks")
    for _ in range(n - 1):
        reach = bounded_distances(chosen.select(F.lit(0).alias("key"), F.col("landmark").alias("vid")), graph.edges, limit, True)
        far = reach.where("d > 0").orderBy(F.desc("d"), "vid").limit(1).select(F.col("vid").alias("landmark"))
        if far.isEmpty():
            break
        chosen, _ = kept(chosen.unionByName(far), "landmarks")
    return chosen


def landmark_distances(graph: LabeledGraph, landmarks: DataFrame, limit: int) -> DataFrame:
    """landmark, vid, d: distances from landmarks of at most limit."""
    return bounded_distances(landmarks.select(F.col("landmark").alias("key"), F.col("landmark").alias("vid")), graph.edges, limit, graph.simple).withColumnRenamed("key", "landmark")


def landmark_ranges(graph: LabeledGraph, distances: DataFrame) -> DataFrame:
    """label, landmark, nearest, farthest."""
    return distances.join(graph.vertices, "vid").groupBy("label", "landmark").agg(F.min("d").alias("nearest"), F.max("d").alias("farthest"))


def scales_of(vertices: int) -> int:
    """How many sizes of reference sets a graph of so many vertices has: floor(log2) - 1, 1 at least."""
    return max(vertices.bit_length() - 2, 1)


def reference_sets(graph: LabeledGraph, scales: int | None = None) -> DataFrame:
    """dim, vid: scales * scales pseudo-random sets; of those, scales have 2 vertices, scales have 4, and so on.

    Without scales they follow from the number of vertices. The vertices are gone over once for all sets; a set's candidates are
    those under a quantile of its pseudo-random order, so that only they are ranked.
    """
    vertices, _ = kept(graph.vertices.select("vid"), "set-vertices")
    n = vertices.count()
    scales = scales_of(n) if scales is None else scales
    dims = scales * scales
    size = lambda k: 2 << (k // scales)
    # a set of m of n has about m + 6 sqrt(m) + 20 vertices under this value; all have a place if there are few
    under = [min(_RANGE, int(_RANGE * (size(k) + 6 * size(k) ** 0.5 + 20) / max(n, 1)) + 1) for k in range(dims)]
    sets = F.array(*(F.struct(F.lit(k).alias("dim"), F.lit(size(k)).alias("size"), F.lit(under[k]).alias("under")) for k in range(dims)))
    near = vertices.select("vid", F.explode(sets).alias("s")).select("vid", "s.*").withColumn("at", scatter(F.col("vid"), F.col("dim"))).where("at < under")
    place = F.row_number().over(Window.partitionBy("dim").orderBy("at", "vid"))
    return kept(near.withColumn("place", place).where("place <= size").select("dim", "vid"), "reference-sets")[0]


def embedding(graph: LabeledGraph, sets: DataFrame, limit: int) -> DataFrame:
    """vid, dim, d: the distance from vid to the nearest vertex of each set, where that is at most limit."""
    return bounded_distances(sets.select(F.col("dim").alias("key"), "vid"), graph.reversed().edges, limit, graph.simple).select("vid", F.col("key").alias("dim"), "d")


def vectors(graph: LabeledGraph, distances: DataFrame, dims: int, limit: int) -> DataFrame:
    """vid, label, v: an array of `dims` distances, limit + 1 for those beyond.

    Cut off like that, a vertex's distance to a set still changes by no more than the length of an edge along it,
    so bounds from these vectors hold for all pairs.
    """
    have = distances.groupBy("vid").agg(F.map_from_entries(F.collect_list(F.struct("dim", "d"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(limit + 1)))
    return graph.vertices.join(have, "vid", "left").select("vid", "label", full.alias("v"))
