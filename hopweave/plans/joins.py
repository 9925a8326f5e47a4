"""Joins whose keys have few values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept


def dealt(left: DataFrame, right: DataFrame, key: str | list[str], share: int = 1 << 22) -> DataFrame:
    """The join of two stored tables on a key of few values: one that makes over `share` rows is dealt out in shares, the longer of its sides once."""
    spark = left.sparkSession
    key = [key] if isinstance(key, str) else key
    one, two = (x.groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((left, "n1"), (right, "n2")))
    shares = F.ceil(F.col("n1") * F.col("n2") / share).cast("int")
    hot, _ = kept(one.join(two, key).where(F.col("n1") * F.col("n2") > share).select(*key, F.when(F.col("n1") >= F.col("n2"), shares).otherwise(1).alias("p"), F.when(F.col("n1") >= F.col("n2"), 1).otherwise(shares).alias("q")), "hot-keys")
    dealt_out = hot.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
    if dealt_out is None:
        return left.join(right, key)
    # a partition for each share, as fewer get uneven numbers of them
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), dealt_out)
    own = lambda df, of: F.pmod(F.xxhash64(*df.columns), F.coalesce(of, F.lit(1))).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.coalesce(of, F.lit(1)) - 1))
    spread = lambda df, p, q: df.join(hot, key, "left").select(*df.columns, p.alias("_p"), q.alias("_q")).repartition(n, *key, "_p", "_q")
    p, q = F.col("p"), F.col("q")
    return spread(left, own(left, p), every(q)).join(spread(right, every(p), own(right, q)), [*key, "_p", "_q"]).drop("_p", "_q")
