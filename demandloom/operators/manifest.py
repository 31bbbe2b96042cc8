"""Series manifest: activity, segment, eligibility and cohort, from one pass over the panel."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import KEYS, SEGMENTS, segment, selection_score


def profile(demand: DataFrame, reference_end: date, cutoff: date, minimum: int = 112, fast: float = 0.20, slow: float = 0.60) -> DataFrame:
    """One row per series with rows up to the reference end: one aggregate, with filters instead of joins."""
    ref, live = f"date <= DATE'{reference_end}'", "(unit_price IS NOT NULL OR quantity_sold > 0)"
    start = F.min(F.when(F.expr(f"{ref} AND {live}"), F.col("date"))).over(Window.partitionBy(*KEYS))
    one = demand.withColumn("active_start__", start).groupBy(*KEYS).agg(
        F.count("*").alias("history_days"),
        F.expr(f"sum(quantity_sold) FILTER (WHERE date <= DATE'{cutoff}') AS eligibility_total_sales"),
        F.expr(f"count(*) FILTER (WHERE {ref}) AS reference_history_days"),
        F.expr(f"sum(quantity_sold) FILTER (WHERE {ref}) AS total_sales"),
        F.expr(f"min(date) FILTER (WHERE {ref} AND {live}) AS active_start_date"),
        F.expr(f"max(date) FILTER (WHERE {ref} AND quantity_sold > 0) AS last_positive_date"),
        F.expr(f"avg(CAST(quantity_sold = 0 AS DOUBLE)) FILTER (WHERE {ref}) AS zero_sales_ratio"),
        F.expr(f"avg(CAST(unit_price IS NULL AS DOUBLE)) FILTER (WHERE {ref}) AS missing_price_ratio"),
        F.expr(f"avg(CAST(unit_price IS NULL AS DOUBLE)) FILTER (WHERE {ref} AND date >= active_start__) AS active_missing_price_ratio"),
    ).where("reference_history_days > 0")
    end, cut = F.lit(reference_end), F.lit(cutoff)
    one = one.withColumns({
        "active_history_days": (F.datediff(end, "active_start_date") + 1).cast("long"),
        "trailing_zero_days": F.datediff(end, "last_positive_date").cast("long"),
        "eligibility_history_days": (F.datediff(cut, "active_start_date") + 1).cast("long"),
        "segment": segment(F.col("zero_sales_ratio"), fast, slow),
    })
    sales, days = F.col("eligibility_total_sales"), F.col("eligibility_history_days")
    # Three-valued logic on purpose: a series without rows up to the cutoff has neither verdict.
    reason = F.when(sales <= 0, "no_positive_sales_before_eligibility_cutoff").when(F.col("active_start_date").isNull(), "no_observed_activity_in_reference").when(days < minimum, "insufficient_active_history")
    return one.withColumns({"eligible": (sales > 0) & (days >= minimum), "eligibility_exclusion_reason": reason})


def quotas(limit: int) -> dict[str, int]:
    """A third each, what is left over to earlier segments; short segments are not filled up from others."""
    each, rest = divmod(limit, len(SEGMENTS))
    return {s: each + (i < rest) for i, s in enumerate(SEGMENTS)}


def stratified(profiled: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """Marks per segment the eligible series with the smallest selection scores."""
    w = Window.partitionBy("segment").orderBy(selection_score(seed), "sku_id")
    quota = F.lit(0)
    for s, n in quotas(limit).items():
        quota = F.when(F.col("segment") == s, n).otherwise(quota)
    chosen = profiled.where("eligible").select(*KEYS, "segment", F.row_number().over(w).alias("rank")).where(F.col("rank") <= quota)
    return chosen


def build(demand: DataFrame, dataset_version: str, reference_end: date, cutoff: date, settings: Settings) -> DataFrame:
    one = profile(demand, reference_end, cutoff, settings.forecast.minimum_history, settings.segmentation.fast_max_zero_ratio, settings.segmentation.intermittent_min_zero_ratio)
    reason = F.col("eligibility_exclusion_reason")
    if settings.data.profile == "development":
        chosen = stratified(one, settings.data.series_limit, settings.data.seed).select(*KEYS, F.lit(True).alias("chosen"))
        one = one.join(chosen, KEYS, "left").withColumn("included", F.coalesce("chosen", F.lit(False)))
        one = one.withColumn("exclusion_reason", F.when(F.col("included"), None).when(~F.col("eligible"), reason).otherwise("not_selected_for_development"))
    else:
        one = one.withColumns({"included": F.col("eligible"), "exclusion_reason": reason})
    return one.select(
        F.lit(dataset_version).alias("dataset_version"), *KEYS, "zero_sales_ratio", "history_days", "segment", F.lit(settings.data.seed).alias("selection_seed"), F.lit(settings.data.profile).alias("cohort_role"),
        "included", "exclusion_reason", "eligible", F.lit(reference_end).alias("reference_end_date"), F.lit(cutoff).alias("eligibility_cutoff_date"), "eligibility_history_days", "eligibility_total_sales",
        "reference_history_days", "active_start_date", "active_history_days", "last_positive_date", "trailing_zero_days", "total_sales", "missing_price_ratio", "active_missing_price_ratio",
    )
