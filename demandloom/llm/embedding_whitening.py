"""Embedding whitening: exact distributed scatter, cyclic Jacobi on the driver, whitened components from executors.

* Entries become integers, ``floor(scale * c) + shift``.  Executors add them up per
  dimension, then subtract the integer next to the mean and add up the products of
  all pairs of dimensions.  Both sums are whole numbers, so they are exact and the
  same in any order; the mean's remaining fraction is taken out exactly on the driver.
* The driver, which holds numbers by pairs of dimensions only, applies symmetric
  Jacobi rotations, all disjoint pairs of a round at once, until every off-diagonal
  entry is negligible beside the two diagonal ones.  That criterion keeps the digits
  of small eigenvalues, too.
* The sorted whitening matrix goes to executors with the task; the covariance of
  what they return is measured, not assumed.

Null vectors, empty ones and those with a null or non-finite entry take no part, nor
do vectors of another length than the most frequent one (ties: the longer).  Null and
repeated ids are ordinary rows.  Integers stay within 2**40 of the shift, which
entries beyond 1e9 would leave.  Where an eigenvalue is 0 next to the largest, its
whitened values are null; ``identity_error`` is over the others, null if there are
none.  An empty table has no rows.  Other columns are not read.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, in_parts
from ._vectors import finite_rows, floored

LIMIT = 1 << 40
#: Eigenvalues below this part of the largest count as 0.
NEGLIGIBLE = 1e-13
_BIG = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """What a fit tells: number of vectors, sums by dimension, eigenvalues falling, unit eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def sound(self) -> np.ndarray:
        return self.values > NEGLIGIBLE * max(self.values[0], 0.0)


def jacobi(a: np.ndarray, most_sweeps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, as columns, of a symmetric matrix."""
    a, n = np.array(a, float), len(a)
    v, seats = np.eye(n), list(range(n + n % 2))
    for _ in range(most_sweeps):
        size = np.sqrt(np.abs(np.diag(a)))
        off = np.abs(a - np.diag(np.diag(a)))
        if (off <= 1e-16 * np.outer(size, size)).all():
            break
        for _ in range(len(seats) - 1):
            pairs = [(p, q) for p, q in zip(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1], strict=True) if max(p, q) < n]
            seats.insert(1, seats.pop())
            p, q = np.array([pair for pair in pairs if a[pair] != 0], int).reshape(-1, 2).T
            if not len(p):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
            a[p, q] = a[q, p] = 0
            v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    return np.diag(a)[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(n)] < 0, -1, 1)


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([decimal.Decimal(x) for x in values], _BIG)


def _sums(df: DataFrame, vector: str, scale: float, shift: int) -> DataFrame:
    """Rows (dim, pos, n, s): number of vectors by length and their sums by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in in_parts(batches):
            for dim, (_, x) in finite_rows(b.column(0)).items():
                n, s = total.get(dim, (0, np.zeros(dim, object)))
                total[dim] = n + len(x), s + floored(x, scale, LIMIT).sum(axis=0) + shift * len(x)
        for dim, (n, s) in total.items():
            yield pa.record_batch({"dim": pa.array(np.full(dim, dim, np.int32)), "pos": pa.array(np.arange(dim, dtype=np.int32)), "n": pa.array(np.full(dim, n, np.int64)), "s": _decimals(s.tolist())})

    parts = df.select(vector).mapInArrow(run, "dim int, pos int, n long, s decimal(38,0)")
    return parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _products(d: np.ndarray) -> np.ndarray:
    """d.T @ d, exact: in doubles where all sums stay below 2**53, else in Python's integers."""
    most = int(np.abs(d).max(initial=0))
    if most * most * len(d) < 1 << 53:
        f = d.astype(float)
        return (f.T @ f).astype(np.int64)
    wide = d.astype(object)
    return wide.T @ wide


def _scatter(df: DataFrame, vector: str, scale: float, shift: int, centre: list[int]) -> DataFrame:
    """Rows (i, j, s): sums of products of centred entries for all pairs i <= j of positions."""
    dim = len(centre)
    i, j = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centre, np.int64)
        total, near, bound = np.zeros((dim, dim), object), np.zeros((dim, dim), np.int64), 0
        met = False
        for b in in_parts(batches):
            for size, (_, x) in finite_rows(b.column(0)).items():
                if size == dim:
                    met = True
                    got = _products(floored(x, scale, LIMIT) + shift - middle)
                    most = int(np.abs(got).max())
                    if got.dtype == object or bound + most >= 1 << 62:
                        total, near, bound = total + near, np.zeros((dim, dim), np.int64), 0
                    if got.dtype == object:
                        total = total + got
                    else:
                        near, bound = near + got, bound + most
        if met:
            yield pa.record_batch({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "s": _decimals((total + near)[i, j].tolist())})

    return df.select(vector).mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))


def fit(df: DataFrame, vector: str = "embedding", scale: float = 1024, shift: int = 100_000) -> Whitening | None:
    """The whitening of all sound vectors of the most frequent length; None if there are none.

    The driver gets one number per pair of positions, whatever the number of rows.
    """
    scratch = Scratch(df.sparkSession)
    sums = scratch.save(_sums(df, vector, scale, shift))
    top = sums.where("pos = 0").orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not top:
        scratch.drop(sums)
        return None
    dim, n = top[0]["dim"], top[0]["n"]
    s = [int(r["s"]) for r in sums.where(F.col("dim") == dim).orderBy("pos").collect()]
    scratch.drop(sums)
    centre = [(2 * x + n) // (2 * n) for x in s]
    rest = [x - n * c for x, c in zip(s, centre, strict=True)]
    table = _scatter(df, vector, scale, shift, centre).toArrow()
    v = np.zeros((dim, dim))
    for i, j, x in zip(table["i"].to_pylist(), table["j"].to_pylist(), table["s"].to_pylist(), strict=True):
        v[i, j] = v[j, i] = (n * int(x) - rest[i] * rest[j]) / (n * n)
    values, vectors = jacobi(v)
    return Whitening(n, tuple(s), values, vectors, float(np.trace(v)))


def transform(df: DataFrame, w: Whitening, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024, shift: int = 100_000) -> DataFrame:
    """Rows (vec_id, deviation, z) of the fitted length: n-fold squared distance from the mean, and whitened components.

    deviation is exact; null if it has more than 38 digits.
    """
    dim, n = len(w.sums), w.n
    k = min(components, dim)
    centre = [(2 * x + n) // (2 * n) for x in w.sums]
    rest = [x - n * c for x, c in zip(w.sums, centre, strict=True)]
    sound = w.sound[:k]
    matrix = np.where(sound, w.vectors[:, :k] / np.sqrt(np.where(sound, w.values[:k], 1)), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centre, np.int64)
        for b in in_parts(batches):
            at, x = finite_rows(b.column(1)).get(dim, (None, None))
            if at is None:
                continue
            d = floored(x, scale, LIMIT) + shift - middle
            most = n * (int(np.abs(d).max()) + 1)
            far = (d * n - np.array(rest, np.int64)) if most < 1 << 62 else d.astype(object) * n - np.array(rest, object)
            square = (far * far).sum(axis=1) if most * most * dim < 1 << 63 else (far.astype(object) ** 2).sum(axis=1)
            told = pa.array(square).cast(_BIG) if square.dtype == np.int64 else pa.array([decimal.Decimal(v) if v < 10**38 else None for v in square.tolist()], _BIG)
            z = (far.astype(float) / n) @ matrix
            flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
            yield pa.record_batch([b.column(0).take(pa.array(at)), told, pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), flat)], ["vec_id", "deviation", "z"])

    kind = df.schema[vec_id].dataType.simpleString()
    return df.select(F.col(vec_id).alias("vec_id"), vector).mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), z array<double>")


def whiten(df: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024, shift: int = 100_000) -> DataFrame:
    """A row per sound vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    w = fit(df, vector, scale, shift)
    kind = df.schema[vec_id].dataType.simpleString()
    if w is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = Scratch(spark).save(transform(df, w, components, vec_id, vector, scale, shift))
    k = min(components, len(w.sums))
    sound = [i for i in range(k) if w.sound[i]]
    z = [F.get("z", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in sound for j in sound if i <= j]
    error = None
    if pairs:
        told = rows.agg(*(F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(told[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*(F.lit(float(v / w.trace) if w.trace else None).cast("double") for v in w.values[:k]))
    out = rows.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
