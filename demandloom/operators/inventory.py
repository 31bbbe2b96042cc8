"""Lead-time demand and order quantities under stated assumptions, and what they would have cost.

No stock is observed, so all recommendations are simulated: the inventory position is
the demand of the last days under review, and an order is judged by the demand of its
lead time alone.

The error of the lead time is the sum of one error a day.  Each day's error has the
empirical distribution of the seasonal-naive errors of that weekday; the sum's
distribution is their convolution, built up day by day as whole counts per total, by
joins and sums that stay within a series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .forecast import SERIES
from .validate import require

SEASON = 7


@dataclass(frozen=True)
class Assumptions:
    """Costs a unit, by which the service level is shortage / (shortage + holding)."""

    assumption_set_id: str
    shortage: float
    holding: float


#: The three scenarios asked for at least.
SCENARIOS = (Assumptions("balanced", 1.0, 1.0), Assumptions("shortage_sensitive", 9.0, 1.0), Assumptions("holding_sensitive", 1.0, 3.0))


def lead_time_inputs(frame: DataFrame, lead_days: int, seasons: int = 12, review_days: int = SEASON) -> DataFrame:
    """Per fold and series: expected demand of the lead time, inventory position, actual demand, errors as (day, error) pairs.

    Expected is the seasonal-naive forecast.  Series with less history than the errors
    need are left out.
    """
    require(1 <= lead_days <= SEASON, f"lead time must be 1 to {SEASON} days")
    n = SEASON * seasons
    q = F.transform("history", lambda x: x["q"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    errors = F.zip_with(F.slice(q, -n, n), F.slice(q, -n - SEASON, n), lambda x, y: F.round(x - y).cast("long"))
    return frame.where(F.size("history") >= n + SEASON).select(
        *SERIES, "segment", F.col("train_end").alias("as_of_date"), F.lit(lead_days).alias("lead_time_days"), total(F.slice(q, -SEASON, lead_days)).alias("forecast_during_lead_time"),
        total(F.slice(q, -review_days, review_days)).alias("inventory_position"), total(F.slice("actual", 1, lead_days)).alias("actual_demand"), errors.alias("errors"),
    )


def lead_time_distribution(inputs: DataFrame, lead_days: int) -> DataFrame:
    """Rows (fold, series, total, weight): in how many ways the days' errors add up to each total."""
    day = inputs.repartition(*SERIES).select(*SERIES, F.posexplode("errors").alias("at", "error"))
    day = day.groupBy(*SERIES, (F.col("at") % SEASON + 1).alias("day"), "error").agg(F.count("*").alias("n"))
    one = lambda h: day.where(F.col("day") == h).select(*SERIES, "error", "n")
    made = one(1).select(*SERIES, F.col("error").alias("total"), F.col("n").alias("weight"))
    for h in range(2, lead_days + 1):
        pairs = made.join(one(h), SERIES).select(*SERIES, (F.col("total") + F.col("error")).alias("total"), (F.col("weight") * F.col("n")).alias("weight"))
        made = pairs.groupBy(*SERIES, "total").agg(F.sum("weight").alias("weight"))
    return made


def error_quantiles(distribution: DataFrame, levels: dict[str, float]) -> DataFrame:
    """Per fold and series: for each level, the smallest total at which the distribution reaches it."""
    series = Window.partitionBy(*SERIES)
    upto = F.sum("weight").over(series.orderBy("total").rowsBetween(Window.unboundedPreceding, 0))
    rows = distribution.select(*SERIES, "total", upto.alias("upto"), F.sum("weight").over(series).alias("all"))
    return rows.groupBy(*SERIES).agg(*(F.min(F.when(F.col("upto") >= level * F.col("all"), F.col("total"))).alias(name) for name, level in levels.items()))


def recommend(frame: DataFrame, lead_days: int = 5, scenarios: tuple[Assumptions, ...] = SCENARIOS, seasons: int = 12) -> DataFrame:
    """A row per fold, series and scenario: safety stock, order quantity and the simulated outcome of the lead time.

    The order lifts the inventory position to expected demand plus safety stock, which is
    the error's quantile at the scenario's service level and may be negative where holding
    is dear.  What the position exceeds is kept.
    """
    inputs = lead_time_inputs(frame, lead_days, seasons)
    levels = {s.assumption_set_id: s.shortage / (s.shortage + s.holding) for s in scenarios}
    table = scenario_table(frame.sparkSession, scenarios)
    stock = F.create_map(*(x for k in levels for x in (F.lit(k), F.col(k))))
    # A handful of scenarios.
    rows = inputs.drop("errors").join(error_quantiles(lead_time_distribution(inputs, lead_days), levels), SERIES).join(F.broadcast(table))
    rows = rows.withColumn("safety_stock", F.element_at(stock, F.col("assumption_set_id")).cast("double")).drop(*levels)
    target = F.greatest(F.lit(0.0), F.col("forecast_during_lead_time") + F.col("safety_stock"))
    rows = rows.withColumn("recommended_order_qty", F.greatest(F.lit(0.0), F.ceil(target - F.col("inventory_position")).cast("double")))
    have = F.col("inventory_position") + F.col("recommended_order_qty")
    return rows.withColumns({"lost_units": F.greatest(F.lit(0.0), F.col("actual_demand") - have), "left_units": F.greatest(F.lit(0.0), have - F.col("actual_demand")), "policy_name": F.lit("lead_time_quantile")})


def scenario_table(spark: SparkSession, scenarios: tuple[Assumptions, ...]) -> DataFrame:
    return spark.createDataFrame([(s.assumption_set_id, s.shortage, s.holding) for s in scenarios], "assumption_set_id string, shortage_cost double, holding_cost double")


def scenario_metrics(recommended: DataFrame) -> DataFrame:
    """Per fold and scenario, over all series and by segment: units, stock-outs, fill rate and simulated costs."""
    sets = recommended.groupingSets([["fold_id", "assumption_set_id"], ["fold_id", "assumption_set_id", "segment"]], "fold_id", "assumption_set_id", "segment")
    out = sets.agg(
        F.grouping("segment").alias("all__"), F.count("*").alias("series_count"), F.sum("recommended_order_qty").alias("ordered_units"), F.sum("actual_demand").alias("demand_units"),
        F.count_if(F.col("lost_units") > 0).alias("stockout_series"), F.sum("lost_units").alias("lost_units"), F.sum("left_units").alias("left_units"),
        (1 - F.try_divide(F.sum("lost_units"), F.sum("actual_demand"))).alias("fill_rate"), F.sum(F.col("lost_units") * F.col("shortage_cost")).alias("lost_sales_cost"), F.sum(F.col("left_units") * F.col("holding_cost")).alias("holding_cost"),
    )
    out = out.withColumns({"segment": F.when(F.col("all__") == 1, "all").otherwise(F.col("segment")), "total_cost": F.col("lost_sales_cost") + F.col("holding_cost")})
    return out.drop("all__")
