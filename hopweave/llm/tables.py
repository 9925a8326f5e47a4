"""Reading the corpus tables; intermediate ones are kept in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import drop, kept, shared_dir

__all__ = ["drop", "fresh", "kept", "quoted", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """A column's name that docs does not have."""
    have = {c.lower() for c in docs.columns}
    name = f"_{name}"
    while name in have:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")
