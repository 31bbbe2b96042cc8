"""Exponential smoothing with a weekly season, and ensembles of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Protocol
from .forecast import SERIES

SEASON = 7
#: Smoothing of the level and of the season, all pairs of which are tried.
LEVELS, SEASONS = (0.02, 0.1, 0.3), (0.0, 0.1, 0.3)


def grid() -> list[tuple[float, float]]:
    return [(a, g) for a in LEVELS for g in SEASONS]


def ets(history: Column, horizon: int) -> Column:
    """struct(alpha, gamma, sse, forecast): additive errors, a level and an additive season of seven days.

    The state is run for every pair of the grid side by side, in one pass over the
    history.  Errors are normal, so at an equal number of states the likelihood is
    largest where squared errors of the days after the first two weeks are least (ties:
    the first pair).  Level and season start from those two weeks; a history that is
    shorter has no forecast.
    """
    start = F.slice(history, 1, 2 * SEASON)
    level = F.aggregate(start, F.lit(0.0), lambda s, x: s + x) / (2 * SEASON)
    season = F.transform(F.sequence(F.lit(0), F.lit(SEASON - 1)), lambda k: (F.get(history, k) + F.get(history, k + SEASON)) / 2 - level)
    first = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(g).alias("g"), level.alias("level"), season.alias("season"), F.lit(0.0).alias("sse")) for a, g in grid()))

    def step(states: Column, y: Column) -> Column:
        def one(s: Column) -> Column:
            e = y - s["level"] - s["season"][0]
            return F.struct(s["a"].alias("a"), s["g"].alias("g"), (s["level"] + s["a"] * e).alias("level"), F.concat(F.slice(s["season"], 2, SEASON - 1), F.array(s["season"][0] + s["g"] * e)).alias("season"), (s["sse"] + e * e).alias("sse"))

        return F.transform(states, one)

    def finish(states: Column) -> Column:
        best = F.reduce(F.slice(states, 2, len(grid()) - 1), states[0], lambda s, x: F.when(x["sse"] < s["sse"], x).otherwise(s))
        ahead = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: best["level"] + F.get(best["season"], (h % SEASON).cast("int")))
        return F.struct(best["a"].alias("alpha"), best["g"].alias("gamma"), best["sse"].alias("sse"), ahead.alias("forecast"))

    rest = F.slice(history, 2 * SEASON + 1, F.greatest(F.size(history) - 2 * SEASON, F.lit(0)))
    return F.when(F.size(history) >= 2 * SEASON, F.aggregate(rest, first, step, finish))


def ets_forecasts(frame: DataFrame, protocol: Protocol, window_days: int = 730) -> DataFrame:
    """A row per fold, series and horizon, as forecasts() has them, from a series' last days since its active start."""
    live = F.transform(F.filter("history", lambda x: (x["date"] >= F.col("active_start_date")) & (x["date"] > F.date_sub("train_end", window_days))), lambda x: x["q"])
    rows = frame.select(*SERIES, "segment", "train_end", "actual", ets(live, protocol.horizon)["forecast"].alias("made"))
    # An outer generator: for the plain one Spark adds a filter on the array, and with it computes the array once more.
    rows = rows.select(*SERIES, "segment", "train_end", "actual", F.posexplode_outer("made").alias("h0", "raw")).where("h0 IS NOT NULL")
    return rows.select(
        *SERIES, "segment", F.lit("ets_weekly").alias("model_id"), F.col("train_end").alias("cutoff_date"), F.date_add("train_end", F.col("h0") + 1).alias("forecast_date"),
        (F.col("h0") + 1).alias("horizon"), F.greatest(F.lit(0.0), "raw").alias("prediction"), F.get("actual", F.col("h0")).alias("actual"), "raw",
    )


def ensemble(predictions: DataFrame, metrics: DataFrame, fold_order: list[str], name: str = "ensemble", weighted: bool = True) -> DataFrame:
    """Weighted mean of the models' predictions.

    A fold's weights come from earlier folds alone: a model's is the inverse of its mean
    squared RMSSE over series and those folds.  Without earlier folds, or without
    ``weighted``, all weigh the same.
    """
    order = F.array_position(F.array(*map(F.lit, fold_order)), F.col("fold_id"))
    score = metrics.where("horizon_band = 'all'").groupBy("fold_id", "model_id").agg(F.sum(F.col("rmsse") * F.col("rmsse")).alias("s"), F.count("rmsse").alias("n"))
    # A row per fold and model.
    before = Window.partitionBy("model_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    mean = F.try_divide(F.sum("s").over(before), F.sum("n").over(before))
    weights = score.select("fold_id", "model_id", F.coalesce(F.try_divide(F.lit(1.0), mean), F.lit(1.0)).alias("w") if weighted else F.lit(1.0).alias("w"))
    rows = predictions.join(F.broadcast(weights), ["fold_id", "model_id"])
    keys = [*SERIES, "segment", "cutoff_date", "forecast_date", "horizon", "actual"]
    made = rows.groupBy(*keys).agg((F.sum(F.col("raw") * F.col("w")) / F.sum("w")).alias("raw"))
    return made.select(*SERIES, "segment", F.lit(name).alias("model_id"), "cutoff_date", "forecast_date", "horizon", F.greatest(F.lit(0.0), "raw").alias("prediction"), "actual", "raw")
