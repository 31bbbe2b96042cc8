"""Causal features: every window ends at the day before the row."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CALENDAR, CODES, FEATURE_SETS, LAGS, LONGEST, PRICE, TARGET, WINDOWS, Fold
from ..functions.columns import KEYS, iso_weekday
from .ordinals import coded, numbered
from .validate import unique_on
from .workspace import Workspace


def causal(df: DataFrame) -> DataFrame:
    """Adds all features but the codes. One partitioning and order serves every window."""
    order = Window.partitionBy(*KEYS).orderBy("date")
    back = lambda n: order.rowsBetween(-n, -1)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    q, p = F.col("quantity_sold"), F.col("unit_price")
    full = lambda n, c: F.when(F.count(q).over(back(n)) == n, c)
    out = {f"lag_{n}": F.lag(q, n).over(order) for n in LAGS}
    for n in WINDOWS:
        out[f"rolling_mean_{n}"] = full(n, F.avg(q).over(back(n)))
        out[f"rolling_std_{n}"] = full(n, F.stddev_pop(q).over(back(n)))
    out["nonzero_rate_28"] = full(28, F.avg((q > 0).cast("double")).over(back(28)))
    out["days_since_nonzero"] = F.coalesce(F.datediff("date", F.last(F.when(q > 0, F.col("date")), True).over(before)), F.lit(LONGEST + 1))
    out["context_mean"] = F.avg(q).over(before)
    one, week = F.lag(p, 1).over(order), F.lag(p, 7).over(order)
    out |= {"price_lag_1": one, "price_change_7": F.try_divide(one, week) - 1, "relative_price": F.try_divide(one, F.avg(p).over(before))}
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    day = {
        "day_of_week": iso_weekday("date"), "week_of_year": F.weekofyear("date"), "month": F.month("date"), "day_of_month": F.dayofmonth("date"),
        "is_weekend": (F.weekday("date") >= 5).cast("double"), "event_flag_feature": flag("event_flag"), "snap_eligible_feature": flag("snap_eligible"),
    }
    return df.withColumns(out | day)


def catalog(demand: DataFrame, manifest: DataFrame) -> DataFrame:
    """Included series with codes by order of name: ranks over all series, numbered range by range."""
    space = Workspace(demand.sparkSession)
    # A series without a name joins nothing, so several of them are no clash.
    attributes = unique_on(demand.select(*KEYS, "category", "subcategory").dropna(subset=KEYS).distinct(), KEYS, "series attributes")
    chosen = unique_on(manifest.where("included").select(*KEYS, "segment", "active_start_date"), KEYS, "manifest")
    series = numbered(chosen.join(attributes, KEYS), KEYS, "sku_code", space)
    return coded(coded(series, "category", "category_code", space), "subcategory", "subcategory_code", space)


def training_frame(demand: DataFrame, catalog_: DataFrame, fold: Fold, window_days: int = 730) -> DataFrame:
    """Rows of the fold's training window with all features; context reaches far enough back for the longest lag."""
    start = fold.train_end - timedelta(days=window_days - 1)
    rows = demand.where(F.col("date").between(start - timedelta(days=LONGEST), fold.train_end)).select("date", *KEYS, "quantity_sold", "unit_price", "event_flag", "snap_eligible")
    rows = rows.join(catalog_.select(*KEYS, "active_start_date", *CODES), KEYS).where("date >= active_start_date")
    known = " AND ".join(f"{c} IS NOT NULL" for c in TARGET)
    return causal(rows).where((F.col("date") >= F.lit(start)) & F.expr(known)).select("date", *KEYS, F.col("quantity_sold").alias("target"), *FEATURE_SETS["full"])


def price_medians(training: DataFrame) -> DataFrame:
    """One row: exact medians of the price features, 0 where there is none."""
    return training.agg(*(F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in PRICE))


def fill_prices(demand: DataFrame) -> DataFrame:
    """Prices carried forward, and back over the days before the first one; null if the series has none."""
    order = Window.partitionBy(*KEYS).orderBy("date")
    forward = F.last("unit_price", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first("unit_price", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return demand.withColumn("filled_price", F.coalesce(forward, back))
