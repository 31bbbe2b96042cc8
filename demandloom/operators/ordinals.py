"""Global numbering and exact quantiles without a global sort in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Half width of the part of a bracket's rows that the next bracket takes in, and the sketch's accuracy.
NARROW, ACCURACY = 2e-4, 20_000


def numbered(df: DataFrame, order: list[str], name: str, space: Workspace) -> DataFrame:
    """df with each row's 0-based place in the order of these columns, nulls first.

    Rows are dealt by ranges and written with their partition's number, so that no later
    read deals them otherwise; partitions are counted, and a row's place is its place in
    the partition and the rows of all partitions before it.
    """
    part, before = f"{name}__part", f"{name}__before"
    rows = space.save(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = sorted(tuple(r) for r in rows.groupBy(part).count().collect())  # a row per partition
    starts = [0, *accumulate(n for _, n in counts)]
    offsets = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], f"{part} int, {before} long")
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return rows.withColumn(name, inside).join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def coded(df: DataFrame, column: str, name: str, space: Workspace) -> DataFrame:
    """df with the place of column's value among its distinct values, null being the first."""
    value = f"{name}__value"
    codes = numbered(df.select(F.col(column).alias(value)).distinct(), [value], name, space)
    return df.join(codes, df[column].eqNullSafe(codes[value])).drop(value)


def value_at(values: DataFrame, rank: int, n: int) -> float:
    """The rank-th smallest (from 1) of n values (column v, no null): exact selection by shrinking brackets.

    A sketch names a value near the rank and two around it; exact counts tell on which
    side the rank lies.  Each pass but the last leaves some thousandth of the rows.
    """
    below, live, left = 0, values, n
    while True:
        p = (rank - below - 0.5) / left
        a, t, b = live.agg(F.percentile_approx("v", [max(0.0, p - NARROW), p, min(1.0, p + NARROW)], ACCURACY)).first()[0]
        c = live.agg(*(F.count_if(F.col("v") < x).alias(f"under{k}") for k, x in enumerate((a, t, b))), *(F.count_if(F.col("v") <= x).alias(f"upto{k}") for k, x in enumerate((a, t, b)))).first()
        place = rank - below
        for k, x in enumerate((a, t, b)):
            if c[f"under{k}"] < place <= c[f"upto{k}"]:
                return x
        edges = [(None, 0), (a, c["upto0"]), (t, c["upto1"]), (b, c["upto2"]), (None, left)]
        k = next(k for k in range(1, 5) if place <= edges[k][1])
        (low, under), (high, upto) = edges[k - 1], edges[k]
        live = live.where(" AND ".join([f"v > {_double(low)}"] * (low is not None) + [f"v < {_double(high)}"] * (high is not None)))
        below, left = below + under, (c[f"under{k - 1}"] if k < 4 else left) - under


def _double(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def nearest_quantile(frame: DataFrame, column: str, q: float, space: Workspace) -> float | None:
    """The q-quantile without interpolation: the value at the nearest index of 0..n-1; null values don't count."""
    values = space.save(frame.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"))
    n = values.count()
    if not n:
        return None
    # As Spark rounds: halves away from 0.
    rank = int(q * (n - 1) + 0.5) + 1
    return value_at(values, rank, n)
