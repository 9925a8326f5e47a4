"""Intermediate tables in the folder that all executors share: the engine's loops cut their lineage there."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_BUCKETED = "-in-buckets"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or what setCheckpointDir was given; a folder of our own only where neither is set and
    all tasks run in this process, as in tests. On a cluster executors would not see such a folder, so that raises."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError(f"{SETTING} is not set: intermediate tables need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="hopweave-")
    return _own[app]


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables written by `kept` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        if p.endswith(_BUCKETED):
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(p)}")
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """Writes df once to the shared folder, in a folder for each value of `by`, and reads it from there; its path, for `drop`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hopweave/{uuid.uuid4().hex}-{name}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    atexit.register(_forget, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    return (back.select(*df.columns) if by else back), path


def kept_in_buckets(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """As kept, in a bucket for each shuffle partition of `by`: joins and groups on these columns do not move it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hopweave/{uuid.uuid4().hex}-{name}{_BUCKETED}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(_table_name(path))
    atexit.register(_forget, spark, path)
    return spark.table(_table_name(path)), path


def _table_name(path: str) -> str:
    return "hopweave_" + path.rsplit("/", 1)[-1][:32]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session has ended; what is left there goes with the cluster's own clean-up
        pass
