"""Labelled, weighted graphs as a pair of DataFrames: vertices (vid, label) and edges (src, dst, w)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()


@dataclass(frozen=True)
class LabeledGraph:
    """A vertex exists if it is an end of an edge that is no self loop; without a label it has label 0."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    #: Edges stand in the shared folder, one for each pair of ends, without loops.
    simple: bool = False
    #: Makes vertices of the ends of all edges (vid), where the vertices are just those.
    labelled: Callable[[DataFrame], DataFrame] | None = None

    @staticmethod
    def of(edges: DataFrame, labels: DataFrame | Column | None = None, directed: bool = True) -> LabeledGraph:
        """From edges (src, dst[, w]), w being 1 where it is null or missing, and labels (vid, label) or an expression of vid."""
        w = F.coalesce(F.col("w"), F.lit(1)) if "w" in edges.columns else F.lit(1)
        edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), w.cast("int").alias("w")).where("src <> dst")
        if not directed:
            edges = edges.unionByName(edges.selectExpr("dst AS src", "src AS dst", "w"))

        def labelled(ends: DataFrame) -> DataFrame:
            if isinstance(labels, DataFrame):
                return ends.join(labels.select(F.col("vid").cast("long"), F.col("label").cast("int")), "vid", "left").fillna({"label": 0})
            return ends.withColumn("label", F.lit(0) if labels is None else F.coalesce(labels.cast("int"), F.lit(0)))

        return LabeledGraph(labelled(_ends(edges)), edges, directed, labelled=labelled)

    def stored(self) -> LabeledGraph:
        """The graph with its vertices and, of parallel edges, the lightest, written once: for what reads them several times."""
        if self.simple:
            return self
        edges, _ = kept(self.edges.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")), "graph-edges")
        vertices = self.labelled(_ends(edges)) if self.labelled else self.vertices
        vertices, _ = kept(vertices.select("vid", "label"), "graph-vertices")
        return LabeledGraph(vertices, edges, self.directed, True)

    def reversed(self) -> LabeledGraph:
        return LabeledGraph(self.vertices, self.edges.selectExpr("dst AS src", "src AS dst", "w"), self.directed, self.simple, self.labelled)

    def undirected(self) -> LabeledGraph:
        both = self.edges.unionByName(self.edges.selectExpr("dst AS src", "src AS dst", "w"))
        return LabeledGraph(self.vertices, both, False, labelled=self.labelled)

    def restrict(self, alive: DataFrame) -> LabeledGraph:
        """The graph between vertices of alive (vid)."""
        edges = self.edges.join(alive.selectExpr("vid AS src"), "src", "left_semi").join(alive.selectExpr("vid AS dst"), "dst", "left_semi").select("src", "dst", "w")
        return LabeledGraph(self.vertices.join(alive, "vid", "left_semi"), edges, self.directed)

    def without(self, gone: DataFrame) -> LabeledGraph:
        """The graph without vertices of gone (vid), and without edges that end in one."""
        edges = self.edges.join(gone.selectExpr("vid AS src"), "src", "left_anti").join(gone.selectExpr("vid AS dst"), "dst", "left_anti").select("src", "dst", "w")
        return LabeledGraph(self.vertices.join(gone, "vid", "left_anti"), edges, self.directed)

    def labeled(self, first: int, last: int) -> DataFrame:
        """Vertices whose label is between first and last."""
        return self.vertices.where(F.col("label").between(first, last))

    def group_sizes(self) -> DataFrame:
        return self.vertices.groupBy("label").agg(F.count(F.lit(1)).alias("vertices"))

    def label_count(self) -> DataFrame:
        """labels: how many different ones vertices have."""
        return self.vertices.agg(F.countDistinct("label").alias("labels"))


def group_sizes_of(labels: DataFrame) -> DataFrame:
    """label, vertices, of labels (vid, label) whether or not a vertex has an edge."""
    return labels.groupBy("label").agg(F.countDistinct("vid").alias("vertices"))
