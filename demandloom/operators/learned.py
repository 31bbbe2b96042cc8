"""Learned forecasts: boosted trees with recursive features, and a pluggable batch predictor."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Fold
from ..functions.columns import KEYS, iso_weekday
from . import boosting
from .features import CODES, FEATURE_SETS, LAGS, LONGEST, WINDOWS, fill_prices, price_medians, training_frame
from .validate import require
from .workspace import Workspace

def state(demand: DataFrame, catalog: DataFrame, fold: Fold, context_days: int) -> DataFrame:
    """One row per series: the last 56 quantities, the last 7 prices, sums and counts, and known future flags."""
    first = fold.train_end - timedelta(days=context_days - 1)
    rows = demand.join(catalog.select(*KEYS, "active_start_date", "segment", *CODES), KEYS).where((F.col("date") >= F.col("active_start_date")) & F.col("date").between(first, fold.evaluation_end))
    past = f"date <= DATE'{fold.train_end}'"
    filled = fill_prices(rows.withColumn("unit_price", F.expr(f"IF({past}, unit_price, NULL)")))
    tail = lambda value, n: F.expr(f"slice(transform(array_sort(collect_list(struct(date, {value} AS v)) FILTER (WHERE {past})), x -> x.v), -{n}, {n})")
    ahead = lambda flag: F.expr(f"transform(array_sort(collect_list(struct(date, coalesce({flag}, false) AS v)) FILTER (WHERE NOT {past})), x -> CAST(x.v AS DOUBLE))")
    told = filled.groupBy(*KEYS, "segment", *CODES).agg(
        tail("quantity_sold", LONGEST).alias("target"), tail("filled_price", 7).alias("price"), ahead("event_flag").alias("events"), ahead("snap_eligible").alias("snaps"),
        F.expr(f"transform(array_sort(collect_list(struct(date, quantity_sold AS v)) FILTER (WHERE NOT {past})), x -> x.v)").alias("actual"),
        F.expr(f"sum(quantity_sold) FILTER (WHERE {past})").alias("total"), F.expr(f"count(quantity_sold) FILTER (WHERE {past})").alias("days"),
        F.expr(f"sum(filled_price) FILTER (WHERE {past})").alias("price_total"), F.expr(f"count(filled_price) FILTER (WHERE {past})").alias("price_days"),
        F.expr(f"datediff(DATE'{fold.train_end}', max(date) FILTER (WHERE {past} AND quantity_sold > 0)) + 1").alias("since"),
    )
    return told


def long_enough(told: DataFrame, fold: Fold) -> DataFrame:
    """A written state, after a check that every series has as much history as the longest lag."""
    short = told.where(F.size("target") < LONGEST).count()
    require(not short, f"{fold.fold_id}: {short} series have fewer than {LONGEST} days before the forecast")
    return told


def step_features(s: DataFrame, fold: Fold, horizon: int) -> DataFrame:
    """The features of one horizon step from the state alone, by the definitions of training."""
    at = lambda n: F.element_at("target", -n)
    mean = lambda n: F.aggregate(F.slice("target", -n, n), F.lit(0.0), lambda a, x: a + x) / n
    square = lambda n: F.aggregate(F.slice("target", -n, n), F.lit(0.0), lambda a, x: a + x * x) / n
    day = F.lit(fold.train_end + timedelta(days=horizon))
    out = {f"lag_{n}": at(n) for n in LAGS} | {f"rolling_mean_{n}": mean(n) for n in WINDOWS} | {f"rolling_std_{n}": F.sqrt(F.greatest(square(n) - mean(n) * mean(n), F.lit(0.0))) for n in WINDOWS}
    out["nonzero_rate_28"] = F.size(F.filter(F.slice("target", -28, 28), lambda x: x > 0)) / 28
    out["days_since_nonzero"] = F.coalesce(F.col("since"), F.lit(LONGEST + 1)).cast("double")
    out["context_mean"] = F.col("total") / F.col("days")
    one = F.element_at("price", -1)
    out |= {"price_lag_1": one, "price_change_7": F.try_divide(one, F.when(F.size("price") >= 7, F.element_at("price", -7))) - 1, "relative_price": F.try_divide(one, F.try_divide("price_total", "price_days"))}
    s = s.withColumn("day__", day)
    out |= {
        "day_of_week": iso_weekday("day__"), "week_of_year": F.weekofyear("day__"), "month": F.month("day__"), "day_of_month": F.dayofmonth("day__"), "is_weekend": (F.weekday("day__") >= 5).cast("double"),
        "event_flag_feature": F.get("events", F.lit(horizon - 1)), "snap_eligible_feature": F.get("snaps", F.lit(horizon - 1)),
    }
    return s.withColumns(out).drop("day__")


def advance(s: DataFrame, prediction: str = "prediction") -> DataFrame:
    """The state after a day with this prediction; the last price is carried."""
    y, last = F.greatest(F.lit(0.0), prediction), F.element_at("price", -1)
    return s.withColumns({
        "since": F.when(y > 0, 1).otherwise(F.col("since") + 1), "target": F.concat(F.slice("target", 2, LONGEST - 1), F.array(y)), "total": F.col("total") + y, "days": F.col("days") + 1,
        "price": F.when(F.size("price") >= 7, F.concat(F.slice("price", 2, 6), F.array(last))).otherwise(F.concat("price", F.array(last))),
        "price_total": F.col("price_total") + F.coalesce(last, F.lit(0.0)), "price_days": F.col("price_days") + last.isNotNull().cast("int"),
    })


class Recursion:
    """The state of a batch of series as matrices, with the rules of step_features and advance."""

    def __init__(self, batch: pa.RecordBatch, fold: Fold):
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
        self.fold, self.n = fold, batch.num_rows
        self.codes = {c: column(c) for c in CODES}
        self.target = np.array(batch.column("target").to_pylist(), float).reshape(self.n, LONGEST)
        # Null prices and those before the first are NaN.
        self.price = np.array([[math.nan] * (7 - len(p)) + p for p in batch.column("price").to_pylist()], float).reshape(self.n, 7)
        self.total, self.days, self.price_total, self.price_days, self.since = (column(c) for c in ("total", "days", "price_total", "price_days", "since"))
        self.events, self.snaps = batch.column("events").to_pylist(), batch.column("snaps").to_pylist()

    def features(self, horizon: int) -> dict[str, np.ndarray]:
        """The features of a step; price features that have no value are NaN."""
        day = self.fold.train_end + timedelta(days=horizon)
        same = lambda v: np.full(self.n, float(v))
        told = lambda flags: np.array([f[horizon - 1] if len(f) >= horizon else math.nan for f in flags], float)
        ratio = lambda x, y: np.where(y != 0, x / np.where(y != 0, y, 1), math.nan)
        last = {n: self.target[:, LONGEST - n :] for n in WINDOWS}
        mean = {n: x.mean(axis=1) for n, x in last.items()}
        one = self.price[:, -1]
        out = dict(self.codes) | {f"lag_{n}": self.target[:, -n] for n in LAGS} | {f"rolling_mean_{n}": m for n, m in mean.items()}
        out |= {f"rolling_std_{n}": np.sqrt(np.maximum((x * x).mean(axis=1) - mean[n] * mean[n], 0)) for n, x in last.items()}
        out |= {"nonzero_rate_28": (self.target[:, -28:] > 0).mean(axis=1), "days_since_nonzero": np.where(np.isnan(self.since), LONGEST + 1, self.since), "context_mean": ratio(self.total, self.days)}
        out |= {"price_lag_1": one, "price_change_7": ratio(one, self.price[:, 0]) - 1, "relative_price": ratio(one, ratio(self.price_total, self.price_days))}
        out |= {"day_of_week": same(day.isoweekday()), "week_of_year": same(day.isocalendar().week), "month": same(day.month), "day_of_month": same(day.day), "is_weekend": same(day.isoweekday() >= 6)}
        return out | {"event_flag_feature": told(self.events), "snap_eligible_feature": told(self.snaps)}

    def advance(self, prediction: np.ndarray) -> None:
        y, last = np.maximum(prediction, 0), self.price[:, -1]
        self.since = np.where(y > 0, 1, self.since + 1)
        self.target = np.concatenate((self.target[:, 1:], y[:, None]), axis=1)
        self.price = np.concatenate((self.price[:, 1:], last[:, None]), axis=1)
        known = ~np.isnan(last)
        self.total, self.days = self.total + y, self.days + 1
        self.price_total, self.price_days = self.price_total + np.where(known, last, 0), self.price_days + known


def recursive_forecast(told: DataFrame, trees: boosting.Trees, medians: dict[str, float], fold: Fold, horizon: int) -> DataFrame:
    """The state table with an array of predictions: all steps of a series in one pass, the trees sent along with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, made = Recursion(b, fold), []
            for h in range(1, horizon + 1):
                x = s.features(h)
                x |= {c: np.where(np.isnan(x[c]), medians[c], x[c]) for c in medians}
                made.append(np.maximum(trees.predict(np.stack([x[c] for c in trees.names], axis=1)), 0))
                s.advance(made[-1])
            flat = pa.array(np.stack(made, axis=1).ravel()) if made else pa.array([], pa.float64())
            made_ = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * horizon), flat)
            yield pa.record_batch([*(b.column(c) for c in (*KEYS, "segment", "actual")), made_], [*KEYS, "segment", "actual", "made"])

    return told.mapInArrow(run, "store_id string, sku_id string, segment string, actual array<double>, made array<double>")


def boosted_trees(demand: DataFrame, catalog: DataFrame, fold: Fold, feature_set: str = "full", horizon: int = 28, window_days: int = 730, rounds: int = 200, depth: int = 8, seed: int = 42, save_to: str | None = None, rows_in_task: int = boosting.ROWS_IN_TASK) -> DataFrame:
    """Train on the fold's window and forecast the horizon recursively: a row per series and day.

    ``save_to``: folder for the trained nodes and the parameters, as tables.  A series
    with less history than the longest lag is an error.
    """
    spark, names, space = demand.sparkSession, FEATURE_SETS[feature_set], Workspace(demand.sparkSession)
    told = long_enough(space.save(state(demand, catalog, fold, max(window_days + LONGEST, 512))), fold)
    # Forecasts carry the last price on, so training does, too; else a missing price would tell that nothing was sold.
    order = Window.partitionBy(*KEYS).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    carried = demand.where(F.col("date") <= fold.train_end).withColumn("unit_price", F.last("unit_price", True).over(order))
    training = space.save(training_frame(carried, catalog, fold, window_days).select(F.xxhash64(*KEYS, "date").alias("row"), "target", *names))
    medians = price_medians(training).first().asDict() if "price_lag_1" in names else {}
    filled = training.withColumns({c: F.coalesce(c, F.lit(float(v))) for c, v in medians.items()})
    p = boosting.Parameters(rounds=rounds, depth=depth, seed=seed)
    trees = boosting.fit(filled, names, p, space, rows_in_task)
    if save_to:
        spark.createDataFrame(trees.nodes(), "tree int, node int, feature string, cut double, value double").write.mode("overwrite").parquet(f"{save_to}/nodes")
        more = {"names": names, "base": trees.base, "medians": medians, "parameters": asdict(p)}
        spark.createDataFrame([(json.dumps(more),)], "parameters string").write.mode("overwrite").parquet(f"{save_to}/parameters")
    s = space.save(recursive_forecast(told, trees, medians, fold, horizon))
    out = s.select(*KEYS, "segment", "actual", F.posexplode("made").alias("h0", "prediction"))
    return out.select(F.lit(fold.fold_id).alias("fold_id"), F.lit(f"gbt_{feature_set}").alias("model_id"), *KEYS, "segment", (F.col("h0") + 1).alias("horizon"), "prediction", F.get("actual", F.col("h0")).alias("actual"))


def batch_predictor(frame: DataFrame, predict: Callable[[list[list[float]], int], list[tuple[list[float], list[float], list[float]]]], horizon: int = 28, context: int = 512, batch: int = 8) -> DataFrame:
    """Quantile forecasts of any model that maps batches of contexts to (q10, q50, q90): one row per series with arrays."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                piece = part.iloc[at : at + batch]
                made = predict([[x["q"] for x in h][-context:] for h in piece["history"]], horizon)
                yield pd.DataFrame({"fold_id": piece["fold_id"], "store_id": piece["store_id"], "sku_id": piece["sku_id"], "q10": [list(m[0]) for m in made], "q50": [list(m[1]) for m in made], "q90": [list(m[2]) for m in made]})

    return frame.select("fold_id", *KEYS, "history").mapInPandas(run, "fold_id string, store_id string, sku_id string, q10 array<double>, q50 array<double>, q90 array<double>")


def seasonal_quantiles(contexts: list[list[float]], horizon: int, levels: tuple[float, float, float] = (0.1, 0.5, 0.9)) -> list[tuple[list[float], list[float], list[float]]]:
    """A predictor for batch_predictor: each day's quantiles are those of its weekday in the context (of all days, where it has none)."""
    out = []
    for context in contexts:
        x = np.array(context, float)
        days = [x[(len(x) - 1 + h) % 7 :: 7] for h in range(1, horizon + 1)]
        told = np.array([np.quantile(d if len(d) else x, levels) if len(x) else [0.0] * 3 for d in days])
        out.append(tuple(told.T.tolist()))
    return out
