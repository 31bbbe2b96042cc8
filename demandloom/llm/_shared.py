"""What several training-data operators need: shared tables, arrow plumbing, hold-out folds, components."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one of our own if all run on this machine (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", place)
        atexit.register(shutil.rmtree, place, ignore_errors=True)
    return place


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of df bears them."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", 0
        self.paths: list[str] = []

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no plan needs any more."""
        self._delete([t.scratch_path for t in tables])

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all saved tables but these, and let the shuffle files of finished jobs go."""
        self._delete([p for p in self.paths if p not in {t.scratch_path for t in kept}])
        self.release()

    def release(self) -> None:
        """Spark deletes a finished job's shuffle files only once the driver has collected its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.paths.remove(p)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


#: Batches larger than this are worked on in parts, so that a worker's memory doesn't follow the batch size.
PART_BYTES = 8 << 20


def in_parts(batches: Iterator[pa.RecordBatch], part_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = max(1, -(-b.nbytes // part_bytes))
        step = max(1, -(-b.num_rows // parts))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType | str, part_bytes: int = PART_BYTES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, part_bytes):
            yield from fn(b)

    return df.mapInArrow(run, schema)


def remainder(col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % mod


def training_rows(labels: DataFrame, label: str, held_mod: int, held_at: int, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id, y) of each label 0 and 1 outside the held-out fold, by hash of the id.

    A document labelled more than once counts as its largest label; null ids and labels don't count.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", held_mod) != held_at))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    pick = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return pick(0).union(pick(1))


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): one row (id, component) for every id met, component the smallest id.

    Alternates large-star and small-star steps; each is an aggregate with map-side
    minimum plus an equi-join, and the edge set is rewritten to the shared folder
    after each round, so no task or driver ever holds a component.
    """
    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = _neighbours(edges)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        small = small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        old, edges = edges, scratch.save(small)
        scratch.drop(old)
        got = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == state:
            break
        state = got
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
