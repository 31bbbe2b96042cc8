"""Drift between two windows of a panel: mergeable histograms and the population stability index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feature, its value and the width of its bins; values from bin MOST_BIN on share one, nulls have bin -1.
FEATURES = {"quantity": ("quantity_sold", 2.0), "price": ("unit_price", 50.0), "sold": ("CAST(quantity_sold > 0 AS INT)", 1.0)}
MOST_BIN = 40
ALERT = 0.2


def histograms(rows: DataFrame, by: list[str], features: dict[str, tuple[str, float]] = FEATURES) -> DataFrame:
    """Rows (by, feature, bin, n) with counts that add up: histograms of parts make that of the whole by ``merge``."""
    bins = [F.struct(F.lit(name).alias("feature"), F.when(F.expr(value).isNull(), -1).otherwise(F.least(F.floor(F.expr(value) / width), F.lit(MOST_BIN))).cast("int").alias("bin")) for name, (value, width) in features.items()]
    told = rows.select(*by, F.inline(F.array(*bins)))
    return told.groupBy(*by, "feature", "bin").agg(F.count("*").alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    all_ = reduce(DataFrame.unionByName, parts)
    return all_.groupBy(*(c for c in all_.columns if c != "n")).agg(F.sum("n").alias("n"))


def stability(reference: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Per group and feature: rows of both windows, population stability index, whether it calls for a look.

    Half a row is added to each bin that either window has, so that empty ones count.
    A group that one window lacks is compared with nothing there.
    """
    keys = [*by, "feature"]
    both = reference.select(*keys, "bin", F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(current.select(*keys, "bin", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    both = both.groupBy(*keys, "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = both.groupBy(*keys).agg(F.sum("a").alias("reference_rows"), F.sum("b").alias("current_rows"), F.count("*").alias("bins"))
    share = lambda n, all_: (F.col(n) + 0.5) / (F.col(all_) + 0.5 * F.col("bins"))
    p, q = share("a", "reference_rows"), share("b", "current_rows")
    index: Column = F.sum((q - p) * F.ln(q / p))
    told = both.join(total, keys).groupBy(*keys, "reference_rows", "current_rows").agg(index.alias("stability_index"))
    return told.withColumn("drifted", F.col("stability_index") > ALERT)
