"""Baseline forecasts and their scores, as one plan over all folds, series, models and horizons."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Fold, Protocol
from ..functions.columns import KEYS
from .validate import require

SERIES = ["fold_id", *KEYS]


def fold_table(spark: SparkSession, protocol: Protocol, folds: list[Fold] | None = None) -> DataFrame:
    """Fold dates with the start of the weight window. Locked folds are left out unless named."""
    rows = [(f.fold_id, f.train_start, f.train_end, f.evaluation_start, f.evaluation_end, f.train_end - timedelta(days=protocol.weight_window - 1)) for f in (protocol.development if folds is None else folds)]
    return spark.createDataFrame(rows, "fold_id string, train_start date, train_end date, evaluation_start date, evaluation_end date, weight_start date")


def fold_frame(demand: DataFrame, manifest: DataFrame, folds: DataFrame) -> DataFrame:
    """One row per fold and included series: history (date, q) and actual in date order, revenue weight.

    A single scan and a single list per series serve all folds: only then the handful of
    folds, a small side by protocol, multiplies the rows.
    """
    chosen = manifest.where("included").select(*KEYS, "segment", "active_start_date")
    rows = demand.select("date", *KEYS, "quantity_sold", "unit_price").join(chosen, KEYS)
    days = F.array_sort(F.collect_list(F.struct("date", F.col("quantity_sold").alias("q"), (F.col("quantity_sold") * F.coalesce("unit_price", F.lit(0.0))).alias("r"))))
    lists = rows.groupBy(*KEYS).agg(F.any_value("segment").alias("segment"), F.any_value("active_start_date").alias("active_start_date"), days.alias("days"))
    out = lists.join(F.broadcast(folds), F.expr("days[0].date <= evaluation_end"))
    within = lambda a, b, value: F.transform(F.filter("days", lambda x: (x["date"] >= F.col(a)) & (x["date"] <= F.col(b))), value)
    revenue = F.aggregate(within("weight_start", "train_end", lambda x: F.coalesce(x["r"], F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    past = F.transform(F.filter("days", lambda x: x["date"] <= F.col("train_end")), lambda x: F.struct(x["date"].alias("date"), x["q"].alias("q")))
    return out.select(*SERIES, "segment", "active_start_date", "train_end", past.alias("history"), within("evaluation_start", "evaluation_end", lambda x: x["q"]).alias("actual"), revenue.alias("weight_revenue"))


def check_fold_frame(frame: DataFrame, manifest: DataFrame, protocol: Protocol) -> DataFrame:
    """frame, after a check of series counts and lengths."""
    want = manifest.where("included").count()
    told = frame.groupBy("fold_id").agg(F.count("*").alias("n"), F.count_if((F.size("history") < protocol.minimum_history) | (F.size("actual") != protocol.horizon)).alias("bad")).collect()
    for r in told:
        require(r["n"] == want, f"{r['fold_id']} has {r['n']} series, expected {want}")
        require(r["bad"] == 0, f"{r['fold_id']} has {r['bad']} series of wrong length")
    return frame


def seasonal_naive(history: Column, horizon: int, lag: int) -> Column:
    """The last ``lag`` values over and over: the recursive rule in closed form. Null if history is shorter."""
    at = lambda h: F.get(history, F.size(history) - lag + F.pmod(h - 1, F.lit(lag)))
    return F.when(F.size(history) >= lag, F.transform(F.sequence(F.lit(1), F.lit(horizon)), at))


def croston_sba(history: Column, horizon: int, alpha: float) -> Column:
    """Croston's method with the Syntetos-Boylan correction; a history without demand forecasts 0."""
    a, zero = F.lit(alpha), F.lit(0.0)
    start = F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("gap"))

    def step(s: Column, y: Column) -> Column:
        gap = s["gap"] + 1.0
        size = F.when(s["z"].isNull(), y).otherwise(s["z"] + a * (y - s["z"]))
        interval = F.when(s["p"].isNull(), gap).otherwise(s["p"] + a * (gap - s["p"]))
        return F.when(y > 0, F.struct(size.alias("z"), interval.alias("p"), zero.alias("gap"))).otherwise(F.struct(s["z"].alias("z"), s["p"].alias("p"), gap.alias("gap")))

    value = F.aggregate(history, start, step, lambda s: F.coalesce(F.greatest(zero, (1 - a / 2) * F.try_divide(s["z"], s["p"])), zero))
    return F.array_repeat(value, horizon)


def model_ids(protocol: Protocol) -> dict[str, int | None]:
    """Model id and seasonal lag; None for Croston."""
    return {("naive_last" if lag == 1 else f"seasonal_naive_lag_{lag}"): lag for lag in protocol.lags} | {"croston_sba": None}


def scales(history: Column) -> Column:
    """struct(squared, absolute): mean first differences from the first positive value on; null where undefined or 0."""
    first = F.array_position(F.transform(history, lambda v: v > 0), True)
    live = F.when(first > 0, F.slice(history, first.cast("int"), F.greatest(F.size(history) - first.cast("int") + 1, F.lit(0)))).otherwise(F.array().cast("array<double>"))
    n = F.size(live)
    diffs = F.when(n >= 2, F.zip_with(F.slice(live, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(live, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: x - y))
    mean = lambda f: F.try_divide(F.aggregate(diffs, F.lit(0.0), lambda s, d: s + f(d)), n - 1)
    null0 = lambda c: F.when(c != 0, c)
    return F.struct(null0(mean(lambda d: d * d)).alias("squared"), null0(mean(F.abs)).alias("absolute"))


def forecasts(frame: DataFrame, protocol: Protocol, scored: bool = False) -> DataFrame:
    """A row per fold, series, model and horizon; ``scored``: with the series' weight and scales, which series_metrics then needn't join."""
    q = F.col("q__")
    live = F.transform(F.filter("history", lambda x: x["date"] >= F.col("active_start_date")), lambda x: x["q"])
    made = F.array(*(F.struct(F.lit(m).alias("model_id"), (croston_sba(F.col("live__"), protocol.horizon, protocol.alpha) if lag is None else seasonal_naive(q, protocol.horizon, lag)).alias("values")) for m, lag in model_ids(protocol).items()))
    more = ["weight_revenue", "scale"] if scored else []
    rows = frame.select(*SERIES, "segment", "train_end", "actual", "weight_revenue", F.transform("history", lambda x: x["q"]).alias("q__"), live.alias("live__"))
    rows = rows.withColumn("scale", scales(q)) if scored else rows
    # Outer generators: for plain ones Spark filters on the arrays first, and so makes all forecasts twice.
    rows = rows.select(*SERIES, "segment", "train_end", "actual", *more, F.inline_outer(made))
    rows = rows.select(*SERIES, "segment", "train_end", "actual", *more, "model_id", F.posexplode_outer("values").alias("h0", "raw")).where("h0 IS NOT NULL")
    return rows.select(
        *SERIES, "segment", "model_id", F.col("train_end").alias("cutoff_date"), F.date_add("train_end", F.col("h0") + 1).alias("forecast_date"),
        (F.col("h0") + 1).alias("horizon"), F.greatest(F.lit(0.0), "raw").alias("prediction"), F.get("actual", F.col("h0")).alias("actual"), "raw", *more,
    )


def band_table(spark: SparkSession, protocol: Protocol) -> DataFrame:
    return spark.createDataFrame(protocol.all_bands(), "horizon_band string, horizon_start int, horizon_end int")


def series_metrics(predictions: DataFrame, frame: DataFrame, bands: DataFrame, forecast: str = "raw") -> DataFrame:
    """RMSSE, MASE, WAPE and bias per fold, model, series and band; scaled metrics are null where the scale is."""
    known = {"weight_revenue", "scale"} <= set(predictions.columns)
    e = F.col(forecast) - F.col("actual")
    # A handful of bands: the small side of a range join.
    rows = predictions.join(F.broadcast(bands), F.col("horizon").between(F.col("horizon_start"), F.col("horizon_end")))
    sums = rows.groupBy(*SERIES, "model_id", "segment", "horizon_band", "horizon_start", "horizon_end").agg(
        F.sum("actual").alias("actual_sum"), F.sum(forecast).alias("forecast_sum"), F.sum(F.abs(e)).alias("absolute_error_sum"),
        F.sum(e * e).alias("squared_error_sum"), F.sum(e).alias("error_sum"), F.count("*").alias("observation_count"),
        *([F.first("weight_revenue").alias("weight_revenue"), F.first("scale").alias("scale")] if known else []),
    )
    if not known:
        sums = sums.join(frame.select(*SERIES, "weight_revenue", scales(F.transform("history", lambda x: x["q"])).alias("scale")), SERIES)
    return scored(sums)


def scored(sums: DataFrame) -> DataFrame:
    """The metrics of sums per fold, model, series and band."""
    n, total = F.col("observation_count"), F.col("actual_sum")
    return sums.select(
        *SERIES, "model_id", "segment", "horizon_band", "horizon_start", "horizon_end", "weight_revenue",
        F.sqrt(F.col("squared_error_sum") / n / F.col("scale.squared")).alias("rmsse"), (F.col("absolute_error_sum") / n / F.col("scale.absolute")).alias("mase"),
        F.when(total > 0, F.col("absolute_error_sum") / total).alias("wape"), F.when(total > 0, F.col("error_sum") / total).alias("normalized_bias"),
        "actual_sum", "forecast_sum", "absolute_error_sum", "squared_error_sum", "error_sum", "observation_count",
    )


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    """Revenue-weighted and pooled metrics per fold, model and band, over all series and by segment."""
    band = ["horizon_band", "horizon_start", "horizon_end"]
    base = ["fold_id", "model_id", *band]
    sets = metrics.groupingSets([base, [*base, "segment"]], *base, "segment")
    total, valid = F.sum("weight_revenue"), F.sum(F.when(F.col("rmsse").isNotNull(), F.col("weight_revenue")))
    actual = F.sum("actual_sum")
    out = sets.agg(
        F.grouping("segment").alias("all__"), F.count("*").alias("series_count"), F.count("rmsse").alias("rmsse_valid_count"), (F.count("*") - F.count("rmsse")).alias("rmsse_invalid_count"),
        F.count("mase").alias("mase_valid_count"), F.count_if(F.col("actual_sum") == 0).alias("zero_actual_series_count"), total.alias("weight_revenue"),
        F.when(total > 0, F.coalesce(valid, F.lit(0.0)) / total).alias("weight_coverage"), F.when(valid > 0, F.sum(F.col("rmsse") * F.col("weight_revenue")) / valid).alias("weighted_rmsse"),
        F.avg("mase").alias("mase_mean"), F.when(actual > 0, F.sum("absolute_error_sum") / actual).alias("wape"), F.when(actual > 0, F.sum("error_sum") / actual).alias("normalized_bias"),
    )
    return out.withColumn("segment", F.when(F.col("all__") == 1, "all").otherwise(F.col("segment"))).drop("all__")


def ranking(aggregate: DataFrame) -> DataFrame:
    """Models by mean weighted RMSSE over folds, ties by id. The models are few: a global order is fine."""
    from pyspark.sql import Window

    mean = aggregate.where("segment = 'all' AND horizon_band = 'all'").groupBy("model_id").agg(
        F.avg("weighted_rmsse").alias("mean_weighted_rmsse"), F.stddev_pop("weighted_rmsse").alias("std_weighted_rmsse"), F.avg("mase_mean").alias("mean_mase"),
        F.avg("wape").alias("mean_wape"), F.avg("normalized_bias").alias("mean_normalized_bias"), F.count("*").alias("fold_count"),
    )
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_weighted_rmsse").asc_nulls_last(), "model_id")))


def union_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metric tables one below the other; columns that one lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def champion(aggregate: DataFrame, incumbent: str, gain: float = 0.05, folds: float = 2 / 3, worse: float = 0.03) -> DataFrame:
    """Models that beat the incumbent by ``gain`` on the mean, in ``folds`` of the folds, at most ``worse`` on intermittent series."""
    score = aggregate.where("horizon_band = 'all' AND segment IN ('all', 'intermittent')").select("fold_id", "model_id", "segment", "weighted_rmsse")
    pair = score.where(F.col("model_id") != incumbent).join(score.where(F.col("model_id") == incumbent).select("fold_id", "segment", F.col("weighted_rmsse").alias("reference")), ["fold_id", "segment"])
    change = F.try_divide("weighted_rmsse", "reference") - 1
    told = pair.groupBy("model_id").agg(
        (F.avg(F.when(F.col("segment") == "all", F.col("weighted_rmsse"))) / F.avg(F.when(F.col("segment") == "all", F.col("reference"))) - 1).alias("change"),
        F.avg(F.when(F.col("segment") == "all", (change < 0).cast("double"))).alias("folds_won"), F.max(F.when(F.col("segment") == "intermittent", change)).alias("worst_intermittent"),
    )
    return told.withColumn("champion", (F.col("change") <= -gain) & (F.col("folds_won") >= folds) & (F.coalesce("worst_intermittent", F.lit(0.0)) <= worse))
