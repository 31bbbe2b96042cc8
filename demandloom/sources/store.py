"""Demand kept as a partitioned and bucketed table, so that per-series work reads it without a shuffle.

Files are dealt by store and year, which filters prune, and by buckets of series, which
windows, groupings and joins per series take as they are.  A load replaces only the
stores and years that it holds.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import KEYS

#: Rows a bucket should hold over all stores and years.
BUCKET_ROWS = 4_000_000
#: Partition columns: a copy of the store, since buckets are made of it, and the year.
PARTS = ["store_part", "year_part"]


class DemandStore:
    """A table of the session's catalog whose files lie at ``path``."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path

    def _parted(self, demand: DataFrame, buckets: int) -> DataFrame:
        # Dealt as the buckets are, so a task writes one bucket: one file per bucket, store and year.
        return demand.withColumns({PARTS[0]: F.col("store_id"), PARTS[1]: F.year("date")}).repartition(buckets, *KEYS)

    def create(self, demand: DataFrame, buckets: int | None = None) -> DemandStore:
        """Write the table anew. Without ``buckets``, their number follows that of the rows."""
        n = buckets or max(1, -(-demand.count() // BUCKET_ROWS))
        out = self._parted(demand, n).write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", self.path)
        out.partitionBy(*PARTS).bucketBy(n, *KEYS).sortBy(*KEYS, "date").saveAsTable(self.name)
        return self

    def buckets(self) -> int:
        told = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect()}
        return int(told["Num Buckets"])

    def replace(self, demand: DataFrame) -> None:
        """Put these rows in the place of all rows of their stores and years; other partitions stay as they are.

        The rows must come from elsewhere: Spark refuses to overwrite a table that it reads.
        """
        order = self.spark.table(self.name).columns
        rows = self._parted(demand, self.buckets()).select(*order)
        key = "spark.sql.sources.partitionOverwriteMode"  # insertInto reads the session's setting alone
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")
        try:
            rows.write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(key, before)

    def read(self, stores: Iterable[str] | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
        """Rows of some stores and days: partitions are pruned by store and year, row groups by day."""
        rows = self.spark.table(self.name)
        if stores is not None:
            rows = rows.where(F.col(PARTS[0]).isin(*stores))
        if first is not None:
            rows = rows.where((F.col(PARTS[1]) >= first.year) & (F.col("date") >= F.lit(first)))
        if last is not None:
            rows = rows.where((F.col(PARTS[1]) <= last.year) & (F.col("date") <= F.lit(last)))
        return rows.drop(*PARTS)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
