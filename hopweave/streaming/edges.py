"""Distances kept up to date while edges arrive, by Structured Streaming's foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.storage import drop, kept


def extended(distances: DataFrame, new: DataFrame, limit: int) -> DataFrame:
    """src, dst, d of at most limit once the edges new (src, dst, w) are added to a graph of those distances.

    Distances only get smaller. A round joins what is known on both sides of a new edge, so the number of new edges on
    a path at least doubles each time. A batch may bring vertices that were not there.
    """
    spark = new.sparkSession
    new, _ = kept(new.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")), "new-edges")
    own = new.select(F.explode(F.array("src", "dst")).alias("v")).distinct().selectExpr("v AS src", "v AS dst", "0 AS d")
    best, at = kept(distances.unionByName(own).groupBy("src", "dst").agg(F.min("d").alias("d")), "distances")
    while True:
        left = best.selectExpr("src", "dst AS a", "d AS d1").join(new.selectExpr("src AS a", "dst AS b", "w"), "a").where(F.col("d1") + F.col("w") <= limit)
        met = left.join(best.selectExpr("src AS b", "dst", "d AS d2"), "b").select("src", "dst", (F.col("d1") + F.col("w") + F.col("d2")).alias("n")).where(F.col("n") <= limit).groupBy("src", "dst").agg(F.min("n").alias("n"))
        better, better_at = kept(met.join(best, ["src", "dst"], "left").where("d IS NULL OR n < d").select("src", "dst", F.col("n").alias("d")), "better")
        if better.isEmpty():
            return best
        merged, merged_at = kept(best.unionByName(better).groupBy("src", "dst").agg(F.min("d").alias("d")), "distances")
        drop(spark, at, better_at)
        best, at = merged, merged_at


def maintained(edges: DataFrame, path: str, limit: int, checkpoint: str) -> StreamingQuery:
    """A query that writes the distances after each batch of edges (src, dst, w) to `path`/batch=<number>.

    A batch that is run again after a failure writes the same folder again, from the one before it.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _latest(spark, path, number)
        empty = batch.selectExpr("src", "dst", "CAST(0 AS INT) AS d").limit(0)
        extended(spark.read.parquet(before) if before else empty, batch, limit).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edges.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(spark: SparkSession, path: str, below: int) -> str | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [n for n in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if n < below and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}/_SUCCESS"))]
    return f"{path}/batch={max(done)}" if done else None
