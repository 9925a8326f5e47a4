"""Integer text files: `#` begins a line to skip, `*` ends the file, empty cells don't count, other text reads as 0."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import number
from ..operators.topology import dense_ids
from .sinks import joined, write_lines


def lines(spark: SparkSession, path: str, terminated: bool = True) -> DataFrame:
    """value, place: the lines before the first that begins with `*`, but for comments and blank ones.

    place orders lines as the file has them, from where each part of it starts, so no task needs the whole file.
    """
    raw = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    if terminated:
        stop = raw.where(F.trim("value").startswith("*")).agg(F.min("place").alias("p")).first()["p"]
        if stop is not None:
            end = F.struct(F.lit(stop["file"]).alias("file"), F.lit(stop["block"]).alias("block"), F.lit(stop["line"]).alias("line"))
            raw = raw.where(F.col("place") < end)
    return raw.where(~F.trim("value").startswith("#") & (F.trim("value") != ""))


def rows(spark: SparkSession, path: str, delim: str = ",", least: int = 1, terminated: bool = True) -> DataFrame:
    """cells (array of integers), place: rows of at least so many cells."""
    cells = F.transform(F.filter(F.split("value", re.escape(delim)), lambda x: F.trim(x) != ""), number)
    return lines(spark, path, terminated).select(cells.alias("cells"), "place").where(F.size("cells") >= least)


def read_edges(spark: SparkSession, path: str, delim: str = ",") -> DataFrame:
    """src, dst, w: the weight is 1 where a row has none."""
    c = F.col("cells")
    return rows(spark, path, delim, 2).select(c[0].alias("src"), c[1].alias("dst"), F.coalesce(F.get("cells", F.lit(2)), F.lit(1)).cast("int").alias("w"))


def read_labels(spark: SparkSession, path: str, delim: str = ",") -> DataFrame:
    """vid, label: the last row of a vertex counts."""
    c = F.col("cells")
    return rows(spark, path, delim, 2).groupBy(c[0].alias("vid")).agg(F.max_by(c[1], "place").cast("int").alias("label"))


def read_hub_labels(spark: SparkSession, path: str, delim: str = ",", delta: int | None = None) -> DataFrame:
    """vid, dir, hub, d: rows of four cells, of at most delta."""
    c = F.col("cells")
    out = rows(spark, path, delim, 4).where(F.size("cells") == 4).select(c[0].alias("vid"), c[1].cast("int").alias("dir"), c[2].alias("hub"), c[3].cast("int").alias("d"))
    return out if delta is None else out.where(F.col("d") <= delta)


def read_vectors(spark: SparkSession, path: str, delim: str = ",", dims: int | None = None) -> DataFrame:
    """vid, v: distances to sets, landmarks or pivots, of the first `dims` at most; -1 is null (beyond)."""
    end = "size(cells) - 1" if dims is None else f"least(size(cells) - 1, {int(dims)})"
    v = F.transform(F.expr(f"slice(cells, 2, {end})"), lambda x: F.nullif(x, F.lit(-1)).cast("int"))
    return rows(spark, path, delim, 1).select(F.col("cells")[0].alias("vid"), v.alias("v"))


def read_clusters(spark: SparkSession, path: str, delim: str = ",") -> DataFrame:
    """label, c, r, member."""
    c = F.col("cells")
    return rows(spark, path, delim, 4).select(c[0].cast("int").alias("label"), c[1].alias("c"), c[2].cast("int").alias("r"), F.explode(F.expr("slice(cells, 4, size(cells) - 3)")).alias("member"))


def read_relation(spark: SparkSession, path: str, delim: str = ",") -> DataFrame:
    """i, j, x, y."""
    c = F.col("cells")
    return rows(spark, path, delim, 4).select(c[0].cast("int").alias("i"), c[1].cast("int").alias("j"), c[2].alias("x"), c[3].alias("y"))


def read_relation_graph(spark: SparkSession, path: str, delim: str = ",") -> DataFrame:
    """l0, l1, l2, l3: pairs of query edges that share a vertex."""
    return rows(spark, path, delim, 4).select(*(F.col("cells")[k].cast("int").alias(f"l{k}") for k in range(4)))


def read_mapped(spark: SparkSession, path: str, f: Callable[[list[int]], Iterable[tuple]], schema: str, delim: str = ",", least: int = 1) -> DataFrame:
    """What f makes of each row's integers: rows of the schema. f runs where the lines are read, a batch of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [tuple(x) for cells in batch.column("cells").to_pylist() for x in f(cells)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k.type) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return rows(spark, path, delim, least).select("cells").mapInArrow(run, schema)


def encoded(spark: SparkSession, edges_path: str, labels_path: str, delim: str = "\t", label_delim: str = ",") -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) and labels (vid, label) with dense numbers: vertices from 0, labels from 1, as they are first met.

    Labels of vertices without an edge are left out.
    """
    c = F.col("cells")
    raw = rows(spark, edges_path, delim, 2, terminated=False).select(c[0].alias("a"), c[1].alias("b"), "place")
    met = raw.select(F.explode(F.array(F.struct(F.col("a").alias("raw"), F.struct("place", F.lit(0)).alias("at")), F.struct(F.col("b").alias("raw"), F.struct("place", F.lit(1)).alias("at")))).alias("m")).select("m.raw", "m.at")
    ids = dense_ids(met, "raw", "at")
    edges = raw.join(ids.select(F.col("raw").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("raw").alias("b"), F.col("id").alias("dst")), "b").select("src", "dst")
    named = rows(spark, labels_path, label_delim, 2, terminated=False).select(c[0].alias("raw"), c[1].alias("name"), "place").join(ids, "raw")
    labels = dense_ids(named, "name", "place", 1).withColumnRenamed("id", "label")
    return edges, named.join(labels, "name").select(F.col("id").alias("vid"), F.col("label").cast("int"))


def write_encoded(spark: SparkSession, edges_path: str, labels_path: str, edges_to: str, labels_to: str, delim: str = "\t", label_delim: str = ",") -> None:
    """Both files again with dense numbers (see `encoded`), as lines of integers."""
    edges, labels = encoded(spark, edges_path, labels_path, delim, label_delim)
    write_lines(joined(edges, "src", "dst"), edges_to)
    write_lines(joined(labels, "vid", "label"), labels_to)
