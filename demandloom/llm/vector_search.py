"""Exact top-k search by inner product over a vector-approximation file.

* Entries become integers, ``floor(scale * c)``.  Of equal vectors only the k + 1 of
  smallest id can be among any query's k best, ties going to smaller ids, so only
  those are candidates; every row that is a query remains one.
* The file: blocks of vectors in which every entry is a cell of 4 bits, cut at equal
  frequencies of the block, with each cell's least and largest entry.
* Scan: for each block and group of queries, two matrix products of the cells' middles
  and half widths give bounds of all scores.  A pair is kept if its upper bound reaches
  the (k + 1)-th largest lower bound that the query has met in the task; then the same
  test is made with the largest such bound over all tasks.
* Refinement: what is left of a query is read in order of upper bounds, in rounds of
  growing size, by joins with the exact vectors, until no unread pair's bound reaches
  the k-th exact score.

Queries pass through the driver in waves of at most WAVE_BYTES, each of which scans the
file once; blocks are never replicated.  Null vectors, empty ones and those with a null
or non-finite entry take no part; vectors of different lengths have no score.  A query's
own row is no candidate, but other rows of its id are.  Null ids come last among ties;
repeated ids are told apart by place.  Integers are kept within 2**31, and so that
every score fits a long (2**28 at 64 dimensions).  Empty tables have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, in_parts
from ._vectors import finite_rows, floored

BLOCK, CELLS = 4096, 16
GROUP, GROUP_BYTES, WAVE_BYTES = 512, 1 << 20, 16 << 20


def limit(dim: int) -> int:
    """Entries up to this have inner products that fit a long."""
    return min((1 << 31) - 1, 1 << (62 - math.ceil(math.log2(dim))) // 2)


def _codes(df: DataFrame, vec_id: str, vector: str, query: Column, scale: float) -> DataFrame:
    """Rows (vec_id, is_query, dim, code): integers of sound vectors, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            for dim, (at, x) in finite_rows(b.column(2)).items():
                code = floored(x, scale, limit(dim)).astype("<i4")
                at = pa.array(at)
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(code), dim, np.int32)), pa.array([r.tobytes() for r in code], pa.binary())], ["vec_id", "is_query", "dim", "code"])

    rows = df.select(F.col(vec_id).alias("vec_id"), F.coalesce(query, F.lit(False)).alias("is_query"), vector)
    return rows.mapInArrow(run, f"vec_id {df.schema[vec_id].dataType.simpleString()}, is_query boolean, dim int, code binary")


def _matrix(codes: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), "<i4").reshape(-1, dim)


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a block's entries (two a byte), and each cell's least and largest entry by dimension."""
    n, dim = x.shape
    ordered = np.sort(x, axis=0)
    edges = ordered[(np.arange(1, CELLS) * n) // CELLS]
    cell = np.zeros((n, dim), np.uint8)
    for e in edges:
        cell += x >= e
    low, high = np.zeros((CELLS, dim), np.int32), np.zeros((CELLS, dim), np.int32)
    for c in range(CELLS):
        inside = cell == c
        met = inside.any(axis=0)
        low[c] = np.where(met, np.where(inside, x, np.iinfo(np.int32).max).min(axis=0), 0)
        high[c] = np.where(met, np.where(inside, x, np.iinfo(np.int32).min).max(axis=0), 0)
    even = np.zeros((n, dim + dim % 2), np.uint8)
    even[:, :dim] = cell
    return even[:, ::2] | even[:, 1::2] << 4, low, high


def bounds(cells: np.ndarray, low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of all queries with all vectors of a block."""
    dim = low.shape[1]
    cell = np.empty((len(cells), 2 * cells.shape[1]), np.uint8)
    cell[:, ::2], cell[:, 1::2] = cells & 15, cells >> 4
    at, cell = np.arange(dim), cell[:, :dim]
    low, high = low.astype(float), high.astype(float)
    middle, half, q = ((low + high) / 2)[cell, at], ((high - low) / 2)[cell, at], queries.astype(float)
    m, h = q @ middle.T, np.abs(q) @ half.T
    most = dim * np.abs(q).max(initial=0) * max(np.abs(low).max(), np.abs(high).max())
    slack = 0.0 if most < 2.0**50 else most * dim * 2.0**-50  # halves are exact below, rounded above
    return m - h - slack, m + h + slack


_BLOCK = "dim int, places binary, cells binary, low binary, high binary"


def build_file(rows: DataFrame) -> DataFrame:
    """Blocks of the approximation file from rows (place, dim, code)."""

    def block(dim: int, places: list[int], codes: list[bytes]) -> pa.RecordBatch:
        cells, low, high = approximate(_matrix(codes, dim))
        return pa.record_batch([pa.array([dim], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (np.array(places, "<i8"), cells, low.astype("<i4"), high.astype("<i4")))], ["dim", "places", "cells", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}
        for b in in_parts(batches):
            for place, dim, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                places, codes = held.setdefault(dim, ([], []))
                places.append(place)
                codes.append(code)
                if len(places) == BLOCK:
                    yield block(dim, *held.pop(dim))
        for dim, (places, codes) in held.items():
            yield block(dim, places, codes)

    return rows.select("place", "dim", "code").mapInArrow(run, _BLOCK)


def query_groups(rows: DataFrame, n: int) -> DataFrame:
    """Rows (dim, places, codes): up to GROUP queries of a length, in at most GROUP_BYTES or one query."""

    def group(dim: int, places: list[int], codes: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([np.array(places, "<i8").tobytes()], pa.binary()), pa.array([b"".join(codes)], pa.binary())], ["dim", "places", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}
        for b in in_parts(batches):
            for place, dim, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                places, codes = held.setdefault(dim, ([], []))
                places.append(place)
                codes.append(code)
                if len(places) >= min(GROUP, max(1, GROUP_BYTES // (4 * dim))):
                    yield group(dim, *held.pop(dim))
        for dim, (places, codes) in held.items():
            yield group(dim, places, codes)

    return rows.select("place", "dim", "code").repartition(max(1, n // GROUP)).mapInArrow(run, "dim int, places binary, codes binary")


def scan(file: DataFrame, wave: list[tuple[int, bytes, bytes]], k: int) -> DataFrame:
    """Pairs (query, place, lower, upper) of a wave of query groups that their bounds don't rule out."""
    sent = file.sparkSession.sparkContext.broadcast(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(dim, np.frombuffer(places, "<i8"), np.frombuffer(codes, "<i4").reshape(-1, dim)) for dim, places, codes in sent.value]
        best = [np.full((len(places), k + 1), -np.inf) for _, places, _ in groups]
        for b in batches:
            for dim, places, cells, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                places = np.frombuffer(places, "<i8")
                cells, low, high = np.frombuffer(cells, np.uint8).reshape(len(places), -1), np.frombuffer(low, "<i4").reshape(CELLS, dim), np.frombuffer(high, "<i4").reshape(CELLS, dim)
                for g, (size, asked, codes) in enumerate(groups):
                    if size != dim:
                        continue
                    lower, upper = bounds(cells, low, high, codes)
                    near = np.partition(lower, -k - 1, axis=1)[:, -k - 1 :] if lower.shape[1] > k + 1 else lower
                    best[g] = np.sort(np.concatenate((best[g], near), axis=1), axis=1)[:, -k - 1 :]
                    i, j = np.nonzero(upper >= best[g][:, :1])
                    own = asked[i] == places[j]
                    i, j = i[~own], j[~own]
                    yield pa.record_batch({"query": asked[i], "place": places[j], "lower": lower[i, j], "upper": upper[i, j]})

    return file.mapInArrow(run, "query long, place long, lower double, upper double")


def _scores(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (query, place, ...) with their exact scores and the candidate's vec_id; vectors are read by equi-joins."""
    both = pairs.join(rows.select("place", "vec_id", "code"), "place").join(rows.where("is_query").select(F.col("place").alias("query"), F.col("code").alias("asked")), "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            x, y = b.column("code").to_pylist(), b.column("asked").to_pylist()
            size = np.array([len(v) for v in x])
            score = np.zeros(len(x), np.int64)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                p, q = (_matrix([v[i] for i in at], n // 4).astype(np.int64) for v in (x, y))
                score[at] = (p * q).sum(axis=1)
            yield pa.record_batch([b.column("query"), b.column("place"), b.column("vec_id"), pa.array(score)], ["query", "place", "vec_id", "score"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return both.select("query", "place", "vec_id", "code", "asked").mapInArrow(run, f"query long, place long, vec_id {kind}, score long")


def top_k(df: DataFrame, query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256) -> DataFrame:
    """For each row where ``query`` holds: its k best other rows, as (query_id, rank, vec_id, score)."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    # The place is written, so that every later read sees the same one.
    rows = scratch.save(_codes(df, vec_id, vector, query, scale).withColumn("place", F.monotonically_increasing_id()))
    first = Window.partitionBy("code").orderBy(F.col("vec_id").asc_nulls_last(), "place")
    file = scratch.save(build_file(rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)))
    asked = rows.where("is_query")
    groups = scratch.save(query_groups(asked, asked.count()).withColumn("wave_key", F.monotonically_increasing_id()))
    found, wave, size = [], [], 0
    sizes = groups.select("wave_key", F.octet_length("codes").alias("bytes")).orderBy("wave_key").collect()  # a row per GROUP queries
    for at, r in enumerate(sizes):
        wave, size = [*wave, r["wave_key"]], size + r["bytes"]
        if at + 1 == len(sizes) or size + sizes[at + 1]["bytes"] > WAVE_BYTES:
            held = [tuple(x) for x in groups.where(F.col("wave_key").isin(wave)).select("dim", "places", "codes").collect()]
            found.append(scratch.save(scan(file, [(d, bytes(p), bytes(c)) for d, p, c in held], k)))
            wave, size = [], 0
    if not found:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.union(f)
    # The own row may be among the k + 1 best lower bounds of a task, but the k-th of the others is no smaller than the (k + 1)-th of all.
    reach = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))).where(F.col("r") == k).select("query", F.col("lower").alias("reach"))
    pairs = pairs.join(reach, "query", "left").where("reach IS NULL OR upper >= reach")
    pairs = scratch.save(pairs.select("query", "place", "upper", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "place")).alias("r")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "place")
    sure = scratch.save(_scores(pairs.where(F.col("r") <= 2 * k), rows))
    done = 2 * k
    while True:
        best = sure.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        worst = best.where(F.col("rank") == k).select("query", F.col("score").alias("worst"))
        left = scratch.save(pairs.where(F.col("r") > done).join(worst, "query", "left").where("worst IS NULL OR upper >= worst").select("query", "place", "upper", "r"))
        if left.isEmpty():
            break
        done *= 4
        sure = scratch.save(best.select(*sure.columns).union(_scores(left.where(F.col("r") <= done), rows)))
        pairs = left
    ids = asked.select(F.col("place").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(ids, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
