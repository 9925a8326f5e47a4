"""Mixing sources to target weights by systematic sampling.

Sources, by code point and null last, weigh 5, 2, 1 and so on again; they share the words of all documents by weight,
no source more than `most` times its own, and what is above is shared again by weight until none is. Each document of
a source is expected as often as the source's words are (target / size). Within a source documents stand in order of
size and doc_id; their expected copies are summed up along that order, from one offset, and a document is taken
once for each integer that its sum passes. In this order each stretch of sizes is taken at the source's rate, so
the words taken come near the target. All sums are of integers, and a rerun gives the same mix.

The order is made by range partitioning over (source, size, doc_id), so a source of any share of the rows is spread
over many tasks; only one count for each partition and source is summed in sequence.

Nulls and the like: null and blank texts have size 0; a source without words has target 0, and nothing of it is
taken; rows with a null doc_id or repeated rows are rows like others; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import kept
from .textcore import as_bytes, chunks

WEIGHTS, MOST = (5, 2, 1), 3
#: The offset of the i-th source is (i * STEP + SEED) mod PRIME out of PRIME of one copy.
STEP, SEED, PRIME = 2654435761, 40503, 1000003
BIG = "decimal(38,0)"


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size (words of the text), and the columns `more`, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for c in chunks(as_bytes(batch.column("text"))):
                c.words()
                n[c.rows] = c.last - c.first
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "source", *more)), pa.array(n)], ["doc_id", "source", *more, "size"])

    rows = docs.select("doc_id", "source", *more, "text")
    fields = [rows.schema[k] for k in ("doc_id", "source", *more)]
    return kept(rows.mapInArrow(run, T.StructType([*fields, T.StructField("size", T.LongType())])), "sizes")[0]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, docs, source_size, target, and the rate num / den of each document's copies, exactly.

    One row for each source. Those are capped whose cap is at most their share: in order of cap by weight,
    the shares of what the capped before them have left.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").cast(BIG).alias("s"))
    scale = lcm(*weights)
    by = by.withColumn("at", F.row_number().over(every) - 1).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast(BIG))
    order = Window.orderBy(F.expr(f"s * {most} * ({scale} div w)"), "at")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    by = by.withColumn("left", (F.sum("s").over(whole) - F.coalesce(F.sum(F.expr(f"s * {most}")).over(past), F.lit(0))).cast(BIG)).withColumn("weights", F.sum("w").over(rest).cast(BIG))
    by = by.withColumn("capped", F.expr(f"s * {most} * weights <= w * left"))
    free = lambda c: F.max(F.when(~F.col("capped"), F.col(c))).over(whole)  # noqa: E731  (the first that is not capped has the most of both)
    by = by.withColumn("left", free("left")).withColumn("weights", free("weights"))
    exact = by.withColumn("num", F.expr(f"CASE WHEN capped THEN {most} ELSE w * left END").cast(BIG)).withColumn("den", F.expr("CASE WHEN capped THEN 1 ELSE weights * s END").cast(BIG))
    target = F.expr(f"CASE WHEN capped THEN CAST(s * {most} AS DOUBLE) ELSE CAST(w * left AS DOUBLE) / CAST(weights AS DOUBLE) END")
    offset = F.expr(f"CAST((at * {STEP} + {SEED}) % {PRIME} AS {BIG}) * den div {PRIME}").cast(BIG)
    return exact.select("source", "docs", F.col("s").cast("long").alias("source_size"), target.alias("target"), "num", "den", offset.alias("off"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken."""
    return mix_sized(sized(docs), weights, most)


def mix_sized(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix of rows (doc_id, source, size); other columns are carried along."""
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "size", "doc_id"]
    ordered, _ = kept(sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("part", F.shiftright("place", 33)).withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    runs = ordered.groupBy("none", "name", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("from"))
    before = Window.partitionBy("none", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    goals = targets(sizes, weights, most).withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).drop("source", "docs")
    runs, _ = kept(runs.join(goals, ["none", "name"]), "runs")
    rank = ordered.join(runs, ["none", "name", "part"]).withColumn("rank", F.expr(f"CAST(place - from + before AS {BIG})"))
    passed = F.expr("CASE WHEN den = 0 THEN 0L ELSE ((rank + 1) * num + off) div den - (rank * num + off) div den END")
    more = [c for c in sizes.columns if c not in order]
    return rank.select("doc_id", "source", *more, "size", "source_size", "target", passed.alias("copies")).withColumn("taken", F.expr("size * copies"))
