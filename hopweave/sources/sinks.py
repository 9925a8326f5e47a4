"""Lines of the text formats, as DataFrames with one column `line`; `write_lines` writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """The columns (all, by default) with commas between: hub labels, relations, matches, supports, encoded graphs."""
    return df.select(F.concat_ws(",", *(F.col(c).cast("string") for c in columns or df.columns)).alias("line"))


def vector_lines(vectors: DataFrame, beyond: int | None = None) -> DataFrame:
    """vid and its distances; null, or what is `beyond`, as -1."""
    cell = lambda x: F.coalesce(F.when(x != F.lit(beyond), x) if beyond is not None else x, F.lit(-1)).cast("string")
    return vectors.select(F.concat_ws(",", F.col("vid").cast("string"), F.array_join(F.transform("v", cell), ",")).alias("line"))


def cluster_lines(members: DataFrame) -> DataFrame:
    """label, medoid, radius and members, a line for each cluster."""
    all_of = F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",")
    return members.groupBy("label", "c").agg(F.max("dist").alias("r"), all_of.alias("m")).select(F.concat_ws(",", F.col("label").cast("string"), F.col("c").cast("string"), F.col("r").cast("string"), "m").alias("line"))


def edge_lines(relation: DataFrame) -> DataFrame:
    """[i-j],[x-y],... : the format has one line for each edge of the pattern, so a line is as long as its relation."""
    pairs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y"))), lambda p: F.format_string("[%d-%d]", p["x"], p["y"])), ",")
    return relation.groupBy("i", "j").agg(pairs.alias("p")).select(F.concat_ws(",", F.format_string("[%d-%d]", "i", "j"), "p").alias("line"))


def support_lines(domains: DataFrame, relation: DataFrame, counts: bool = True) -> DataFrame:
    """label,vid,count,[label-vid]...,count,(label-vid)... for each candidate: partners along out-edges, then in-edges."""

    def side(a: str, x: str, b: str, y: str, shape: str, name: str) -> DataFrame:
        all_of = F.array_sort(F.collect_list(F.struct(F.col(b).alias("l"), F.col(y).alias("v"))))
        return relation.groupBy(F.col(a).alias("label"), F.col(x).alias("vid")).agg(F.transform(all_of, lambda p: F.format_string(shape, p["l"], p["v"])).alias(name))

    both = domains.join(side("i", "x", "j", "y", "[%d-%d]", "o"), ["label", "vid"], "left").join(side("j", "y", "i", "x", "(%d-%d)", "n"), ["label", "vid"], "left")
    part = lambda c: F.concat(F.array(F.coalesce(F.size(c), F.lit(0)).cast("string")) if counts else F.array().cast("array<string>"), F.coalesce(c, F.array().cast("array<string>")))
    cells = F.concat(F.array(F.col("label").cast("string"), F.col("vid").cast("string")), part("o"), part("n"))
    return both.select(F.array_join(cells, ",").alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_text(spark: SparkSession, path: str, text: str, append: bool = False) -> None:
    """A file of its own with the text, as for logs."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.append(at) if append and fs.exists(at) else fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
