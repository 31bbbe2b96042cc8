"""Paired comparison of models: observed differences, cluster bootstrap, probabilistic scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS, pinball
from .validate import require, unique_on

def paired(challengers: DataFrame, baselines: DataFrame, challenger: str, baseline: str) -> DataFrame:
    """Series of both models side by side; keys must be unique on either side."""
    keys = ["fold_id", *KEYS]
    one = challengers.where((F.col("horizon_band") == "all") & (F.col("model_id") == challenger)).select(*keys, F.col("rmsse").alias("challenger_rmsse"), "weight_revenue")
    two = baselines.where((F.col("horizon_band") == "all") & (F.col("model_id") == baseline)).select(*keys, F.col("rmsse").alias("baseline_rmsse"))
    return unique_on(one, keys, challenger).join(unique_on(two, keys, baseline), keys)


def observed_difference(pairs: DataFrame) -> DataFrame:
    """One row: mean over folds of the revenue-weighted RMSSE difference."""
    d = F.col("challenger_rmsse") - F.col("baseline_rmsse")
    fold = pairs.where(d.isNotNull()).groupBy("fold_id").agg(F.try_divide(F.sum(d * F.col("weight_revenue")), F.sum("weight_revenue")).alias("d"))
    return fold.agg(F.avg("d").alias("difference"), F.count("*").alias("fold_count"))


def _by_weights(rows: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(b, value): Poisson weights by hash of series and iteration; only sums per fold and iteration are shuffled."""
    u = F.pmod(F.xxhash64(*KEYS, "b", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    # Cumulative probabilities of a Poisson law of mean 1, up to where they round to 1.
    cuts = np.cumsum([np.exp(-1) / float(math.factorial(k)) for k in range(18)])
    weight = sum((u > float(c)).cast("int") for c in cuts)
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("b")).withColumn("m", weight)
    sums = drawn.groupBy("b", "fold_id").agg(F.try_divide(F.sum(F.col("m") * F.col("d") * F.col("w")), F.sum(F.col("m") * F.col("w"))).alias("v"))
    return sums.groupBy("b").agg(F.avg("v").alias("value"))


def _by_index(rows: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(b, value): one stream of series indices, shared by the folds, as published; the series go to every task."""
    table = rows.orderBy("fold_id", *KEYS).collect()
    folds = sorted({r["fold_id"] for r in table})
    data = [np.array([(r["d"], r["w"]) for r in table if r["fold_id"] == f]) for f in folds]
    n = len(data[0])

    def resample(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, at = np.random.default_rng(seed), 0
        for part in parts:
            for b in sorted(part["id"]):
                while at <= b:  # one stream of indices, whatever the partitioning
                    index = rng.integers(0, n, size=n, dtype=np.int32)
                    at += 1
                yield pd.DataFrame({"b": [b], "value": [float(np.mean([(x[index, 0] * x[index, 1]).sum() / x[index, 1].sum() for x in data]))]})

    return rows.sparkSession.range(0, iterations, 1, 8).mapInPandas(resample, "b long, value double")


def bootstrap(pairs: DataFrame, iterations: int = 2000, seed: int = 42, level: float = 0.95, by_index: bool = False) -> DataFrame:
    """One row: observed difference and percentile interval from resampled series, the same series in all folds.

    Series get Poisson weights at every size of the table.  ``by_index`` draws the
    published stream of indices instead; it collects the series, so it is for panels
    that fit the driver.
    """
    d = F.col("challenger_rmsse") - F.col("baseline_rmsse")
    rows = pairs.select("fold_id", *KEYS, d.alias("d"), F.col("weight_revenue").alias("w")).where("d IS NOT NULL")
    shape = rows.groupBy("fold_id").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()
    require(shape[0] == shape[1] and shape[0], "folds must hold the same series")
    samples = (_by_index if by_index else _by_weights)(rows, iterations, seed)
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    ci = samples.agg(F.percentile("value", low).alias("ci_lower"), F.percentile("value", high).alias("ci_upper"))
    return observed_difference(pairs).join(ci).withColumn("interval_excludes_zero", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))


def ordered_quantiles(df: DataFrame, names: tuple[str, str, str] = ("q10", "q50", "q90")) -> DataFrame:
    """Quantiles clipped at 0 and sorted; crossed tells rows where they were out of order."""
    clipped = [F.greatest(F.lit(0.0), n) for n in names]
    done = df.withColumns({"crossed": (clipped[0] > clipped[1]) | (clipped[1] > clipped[2]), "s__": F.array_sort(F.array(*clipped))})
    return done.withColumns({n: F.get("s__", F.lit(i)) for i, n in enumerate(names)}).drop("s__")


def probabilistic_metrics(df: DataFrame) -> DataFrame:
    """Coverage and width of the 80 % interval and pinball losses, over all series and by segment."""
    sets = df.groupingSets([["fold_id", "model_id"], ["fold_id", "model_id", "segment"]], "fold_id", "model_id", "segment")
    out = sets.agg(
        F.grouping("segment").alias("all__"), F.count("*").alias("observation_count"), F.avg(F.col("actual").between(F.col("q10"), F.col("q90")).cast("double")).alias("interval_80_coverage"),
        F.avg(F.col("q90") - F.col("q10")).alias("interval_80_mean_width"), *(F.avg(pinball(q, F.col("actual") - F.col(f"q{int(100 * q)}"))).alias(f"pinball_q{int(100 * q)}") for q in (0.1, 0.5, 0.9)),
    )
    return out.withColumn("segment", F.when(F.col("all__") == 1, "all").otherwise(F.col("segment"))).drop("all__")
