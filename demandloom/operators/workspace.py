"""Tables written to the shared folder, so that lineage ends there and lost executors cost no more than a task."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _delete(files: Any, path: Any) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        files.delete(path, True)


class Workspace:
    """A folder below spark.checkpoint.dir; where that is unset, a local one if all runs on this machine (tests).

    Results are lazy and read their tables late, so the folder goes when the driver's
    Python ends; ``drop`` deletes what is no longer read before that.
    """

    def __init__(self, spark: SparkSession):
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        self.spark, self.root, self.n = spark, f"{place or '/tmp/checkpoints'}/{uuid.uuid4().hex}", 0
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(_delete, self.files, self.path(self.root))

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: int | None = None) -> None:
        """Delete the table saved as the table-th, or all of them."""
        _delete(self.files, self.path(self.root if table is None else f"{self.root}/{table}"))
