"""Baselines and scores of series given by their weeks with sales, so that work follows sales, not the length of the calendar.

Results are those of manifest.build, forecast.fold_frame, forecast.forecasts and
forecast.series_metrics over a panel without gaps, to the last bit: days without sales
add zeros to sums, which are left out, and change nothing of Croston's state but the gap.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Protocol, Settings
from ..functions.columns import KEYS, segment
from . import forecast

#: Days are numbered from the Monday on which price weeks are.
MONDAY = date(1995, 1, 2)


def _day(d: date) -> int:
    return (d - MONDAY).days


def _held(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """df with made columns, behind a generator: later filters and lambdas read them and don't compute them anew."""
    return df.select(*keep, F.inline_outer(F.array(F.struct(*(c.alias(k) for k, c in made.items())))))


def _between(sales: str, a: Column | int, b: Column | int) -> Column:
    return F.filter(sales, lambda x: (x["day"] >= a) & (x["day"] <= b))


def _dense(sales: Column, start: Column, end: Column) -> Column:
    """One value per day from start to end, 0 where nothing was sold; sales lie within."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    state = F.struct(F.array().cast("array<double>").alias("a"), start.cast("int").alias("next"))
    step = lambda s, x: F.struct(F.concat(s["a"], zeros(x["day"] - s["next"]), F.array(x["q"])).alias("a"), (x["day"] + 1).alias("next"))
    return F.aggregate(sales, state, step, lambda s: F.concat(s["a"], zeros(end + 1 - s["next"])))


def series(weeks: DataFrame, store: str, tasks: int) -> DataFrame:
    """A row per series with dated sales: sales (day, q, price) in order, without quantities of 0, and its priced weeks. Weeks need sku_id, wk, unit_price and units."""
    rows = weeks.where("sku_id IS NOT NULL AND wk IS NOT NULL").select("sku_id", "wk", "unit_price", "units")
    # Much work on few bytes: a fixed number of tasks, which adaptive execution leaves alone.
    listed = rows.repartition(tasks, "sku_id").groupBy("sku_id").agg(F.array_sort(F.collect_list(F.struct("wk", "unit_price", "units"))).alias("w"))
    days = F.flatten(F.transform("w", lambda w: F.transform(w["units"], lambda u, i: F.struct((w["wk"] * 7 + i).cast("int").alias("day"), u.alias("q"), w["unit_price"].alias("price")))))
    priced = F.array_min(F.transform(F.filter("w", lambda w: w["unit_price"].isNotNull()), lambda w: (w["wk"] * 7).cast("int")))
    return _held(listed.select(F.lit(store).alias("store_id"), "sku_id", "w"), KEYS, sales=F.filter(days, lambda x: x["q"] != 0), priced=priced)


def included(listed: DataFrame, first: date, reference_end: date, cutoff: date, settings: Settings) -> DataFrame:
    """The manifest's included series with segment and first active day."""
    a, ref, cut = _day(first), _day(reference_end), _day(cutoff)
    n = ref - a + 1
    sold = F.array_min(F.transform(F.filter("sales", lambda x: x["q"] > 0), lambda x: x["day"]))
    start = F.least(F.greatest("priced", F.lit(a)), sold)
    total = F.aggregate(_between("sales", a, cut), F.lit(0.0), lambda s, x: s + x["q"])
    zero = (F.lit(n) - F.size(_between("sales", a, ref))).cast("double") / n
    one = _held(listed, [*KEYS, "sales"], start=start, total=total, zero=zero)
    how = settings.segmentation
    kept = one.where((F.col("start") <= ref) & (F.col("total") > 0) & (cut - F.col("start") + 1 >= settings.forecast.minimum_history))
    return kept.select(*KEYS, "sales", "start", segment(F.col("zero"), how.fast_max_zero_ratio, how.intermittent_min_zero_ratio).alias("segment"))


def croston_sba(sales: Column, start: Column, horizon: int, alpha: float) -> Column:
    """forecast.croston_sba of the days from start on, by days with demand alone."""
    a, zero, none = F.lit(alpha), F.lit(0.0), F.lit(None).cast("double")
    state = F.struct(none.alias("z"), none.alias("p"), (start - 1).cast("int").alias("last"))

    def step(s: Column, x: Column) -> Column:
        gap = (x["day"] - s["last"]).cast("double")
        size = F.when(s["z"].isNull(), x["q"]).otherwise(s["z"] + a * (x["q"] - s["z"]))
        return F.struct(size.alias("z"), F.when(s["p"].isNull(), gap).otherwise(s["p"] + a * (gap - s["p"])).alias("p"), x["day"].alias("last"))

    value = F.aggregate(F.filter(sales, lambda x: (x["day"] >= start) & (x["q"] > 0)), state, step, lambda s: F.coalesce(F.greatest(zero, (1 - a / 2) * F.try_divide(s["z"], s["p"])), zero))
    return F.array_repeat(value, horizon)


def scales(past: Column, end: Column) -> Column:
    """forecast.scales of a history up to day end: between days that don't adjoin, demand falls to 0 and rises again."""
    null, nothing = F.lit(None), F.lit(0.0)
    state = F.struct(null.cast("int").alias("first"), null.cast("int").alias("last"), nothing.alias("q"), nothing.alias("squared"), nothing.alias("absolute"))

    def add(total: Column, s: Column, x: Column, f) -> Column:
        return F.when(x["day"] == s["last"] + 1, total + f(x["q"] - s["q"])).otherwise(total + f(s["q"]) + f(x["q"]))

    def step(s: Column, x: Column) -> Column:
        began = F.struct(x["day"].alias("first"), x["day"].alias("last"), x["q"].alias("q"), nothing.alias("squared"), nothing.alias("absolute"))
        on = F.struct(s["first"].alias("first"), x["day"].alias("last"), x["q"].alias("q"), add(s["squared"], s, x, lambda d: d * d).alias("squared"), add(s["absolute"], s, x, F.abs).alias("absolute"))
        return F.when(s["first"].isNotNull(), on).when(x["q"] > 0, began).otherwise(s)

    def done(s: Column) -> Column:
        mean = lambda total, f: F.try_divide(F.when(s["last"] < end, total + f(s["q"])).otherwise(total), end - s["first"])
        null0 = lambda c: F.when(c != 0, c)
        return F.struct(null0(mean(s["squared"], lambda d: d * d)).alias("squared"), null0(mean(s["absolute"], F.abs)).alias("absolute"))

    return F.aggregate(past, state, step, done)


def metrics(chosen: DataFrame, first: date, protocol: Protocol) -> DataFrame:
    """forecast.series_metrics of all baselines on all development folds, the history beginning at first."""
    a, h, back = _day(first), protocol.horizon, max(protocol.lags)
    keys = [*forecast.SERIES, "segment"]
    folds = F.array(*(F.struct(F.lit(f.fold_id).alias("fold_id"), F.lit(_day(f.train_end)).alias("end")) for f in protocol.development))
    rows, end = chosen.select(*KEYS, "segment", "sales", "start", F.inline_outer(folds)), F.col("end")
    low = F.greatest(end - back + 1, F.lit(a))
    revenue = F.aggregate(_between("sales", end - protocol.weight_window + 1, end), F.lit(0.0), lambda s, x: s + x["q"] * F.coalesce(x["price"], F.lit(0.0)))
    rows = _held(rows, [*keys, "start", "end"], past=_between("sales", a, end), tail=_dense(_between("sales", low, end), low, end), actual=_dense(_between("sales", end + 1, end + h), end + 1, end + h), weight_revenue=revenue)
    made = F.array(*(F.struct(F.lit(m).alias("model_id"), (croston_sba(F.col("past"), F.col("start"), h, protocol.alpha) if lag is None else forecast.seasonal_naive(F.col("tail"), h, lag)).alias("values")) for m, lag in forecast.model_ids(protocol).items()))
    rows = _held(rows, [*keys, "actual", "weight_revenue"], scale=scales(F.col("past"), end), made=made)
    rows = rows.select(*keys, "actual", "weight_revenue", "scale", F.inline_outer("made")).where("values IS NOT NULL")
    pairs = F.zip_with("values", "actual", lambda v, y: F.struct(v.alias("v"), y.alias("y")))
    names = ["actual_sum", "forecast_sum", "absolute_error_sum", "squared_error_sum", "error_sum"]

    def add(s: Column, x: Column) -> Column:
        e = x["v"] - x["y"]
        return F.struct(*((s[n] + v).alias(n) for n, v in zip(names, (x["y"], x["v"], F.abs(e), e * e, e), strict=True)))

    zero = F.struct(*(F.lit(0.0).alias(n) for n in names))
    of = lambda b, e: F.aggregate(F.slice("pairs", b, e - b + 1), zero, add)
    bands = F.array(*(F.struct(F.lit(n).alias("horizon_band"), F.lit(b).alias("horizon_start"), F.lit(e).alias("horizon_end"), F.lit(e - b + 1).cast("long").alias("observation_count"), of(b, e).alias("sums")) for n, b, e in protocol.all_bands()))
    rows = _held(rows, [*keys, "model_id", "weight_revenue", "scale"], pairs=pairs).select(*keys, "model_id", "weight_revenue", "scale", F.inline_outer(bands))
    return forecast.scored(rows.select("*", "sums.*").drop("sums"))
