"""What a run has taken: stages with their seconds, and sizes of tables."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("hopweave")


class Run:
    """Stages in order; `table` has one row for each."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: list[tuple[str, float, int | None]] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self._add(name, time.monotonic() - began, None)

    def counted(self, name: str, df: DataFrame) -> DataFrame:
        """df as it is, once its rows have been counted."""
        began = time.monotonic()
        n = df.count()
        self._add(name, time.monotonic() - began, n)
        return df

    def _add(self, name: str, seconds: float, n: int | None) -> None:
        self.rows.append((name, seconds, n))
        LOG.info("%s: %.3f s%s", name, seconds, "" if n is None else f", {n} rows")

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "stage string, seconds double, rows long")
