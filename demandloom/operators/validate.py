"""Validation and quality profiles. Counters are single passes; the driver gets one row each."""

from __future__ import annotations

from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..artifacts import content_hash
from ..config import COHORT_VERSION, FEATURE_SETS, LAGS, SCHEMA_VERSION, Thresholds
from ..functions.columns import KEYS, SEGMENTS, any_null, any_of, distinct_count
from .ordinals import nearest_quantile
from .workspace import Workspace

REQUIRED = ["date", "store_id", "sku_id", "category", "quantity_sold", "source"]
MANIFEST_REQUIRED = ["dataset_version", *KEYS, "zero_sales_ratio", "history_days", "segment", "selection_seed", "cohort_role", "included", "eligible", "reference_end_date", "eligibility_cutoff_date", "eligibility_history_days", "reference_history_days", "active_start_date"]


def _count(condition) -> Any:
    return F.coalesce(F.count_if(condition), F.lit(0))


def duplicated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows belong to a key that occurs more than once (a pair counts two)."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("duplicate_keys"))


def canonical_checks(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    required = required or [c for c in [*REQUIRED, "ingested_at"] if c in df.columns]
    one = df.agg(
        F.count("*").alias("row_count"), F.count_distinct(F.struct(*KEYS)).alias("series_count"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        _count(F.col("quantity_sold") < 0).alias("negative_quantity_rows"), _count(any_null(required)).alias("null_required_rows"),
    )
    return one.join(duplicated_rows(df, ["date", *KEYS]))


def validate_canonical(df: DataFrame, required: list[str] | None = None) -> dict[str, Any]:
    missing = sorted(set(required or REQUIRED) - set(df.columns))
    if missing:
        return {"status": "failed", "missing_columns": missing}
    told = canonical_checks(df, required).first().asDict()
    bad = told["row_count"] == 0 or any(told[k] for k in ("duplicate_keys", "negative_quantity_rows", "null_required_rows"))
    return {"status": "failed" if bad else "passed", "missing_columns": [], **told}


def manifest_checks(df: DataFrame, required: list[str]) -> DataFrame:
    one = df.agg(F.count("*").alias("row_count"), _count(any_null(required)).alias("null_required_rows"), _count(~F.col("segment").isin(SEGMENTS)).alias("invalid_segment_rows"), _count(F.col("history_days") <= 0).alias("nonpositive_history_rows"))
    return one.join(duplicated_rows(df, ["dataset_version", *KEYS]))


def validate_manifest(df: DataFrame, required: list[str] | None = None) -> dict[str, Any]:
    required = required or MANIFEST_REQUIRED
    missing = sorted(set(required) - set(df.columns))
    if missing:
        return {"status": "failed", "missing_columns": missing}
    told = manifest_checks(df, required).first().asDict()
    bad = told["row_count"] == 0 or any(told[k] for k in told if k != "row_count")
    return {"status": "failed" if bad else "passed", "missing_columns": [], **told}


def raw_checks(sales: DataFrame, calendar: DataFrame, prices: DataFrame, days: DataFrame) -> DataFrame:
    """Blocking counters over raw tables: sales (id), calendar (d, date), prices (store_id, item_id, wm_yr_wk, sell_price), days (d)."""
    s = sales.agg((F.count("*") == 0).alias("store_missing"), (F.count("*") - distinct_count("id")).alias("duplicate_sales_ids"), _count(F.col("id").isNull()).alias("null_sales_ids"))
    c = calendar.agg((F.count("*") - distinct_count("d")).alias("duplicate_calendar_days"), _count(F.col("date").isNull()).alias("null_calendar_dates"))
    m = days.join(calendar, "d", "left_anti").agg(F.count("*").alias("missing_calendar_days"))
    p = prices.agg((F.count("*") - F.count_distinct(F.struct("store_id", "item_id", "wm_yr_wk"))).alias("duplicate_price_keys"), _count(F.col("sell_price") <= 0).alias("nonpositive_price_rows"), _count(F.col("sell_price").isNull()).alias("null_price_rows"))
    # Each side is a single row.
    return s.join(c).join(m).join(p)


def unordered_rows(stored: DataFrame, keys: list[str] = KEYS, day: str = "date") -> DataFrame:
    """One row: how many rows of a Parquet table stand behind a later day of the same series in their file."""
    rows = stored.select(*keys, day, F.col("_metadata.file_path").alias("file__"), F.col("_metadata.row_index").alias("at__"))
    w = Window.partitionBy(*keys, "file__").orderBy("at__")
    return rows.select((F.col(day) < F.lag(day).over(w)).alias("back")).agg(_count(F.col("back")).alias("unordered_rows"))


def quality_counters(frame: DataFrame, manifest: DataFrame, dataset_version: str) -> DataFrame:
    """Blocking counters of the selected panel, all of which must be 0, and the number of selected series."""
    q, p = F.col("quantity_sold"), F.col("unit_price")
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    event, name = F.col("event_flag"), F.col("event_name")
    rows = {
        "empty_required_rows": any_of([F.char_length(F.coalesce(c, F.lit(""))) == 0 for c in ("store_id", "sku_id", "category", "source")]),
        "nonfinite_quantity_rows": odd(q), "nonfinite_price_rows": p.isNotNull() & odd(p), "nonpositive_price_rows": p <= 0,
        "event_semantic_mismatch_rows": (event & name.isNull()) | (~event & name.isNotNull()),
    }
    # The frame is grouped once; series and manifest then meet once, a row per series.
    series = frame.groupBy(*KEYS).agg(F.count_distinct("date").alias("dates"), distinct_count("category").alias("categories"), F.lit(True).alias("seen"), *(_count(c).alias(k) for k, c in rows.items()))
    listed = manifest.groupBy(*KEYS).agg(_count(F.col("included")).alias("chosen"), _count(F.col("dataset_version") != dataset_version).alias("other_version"))
    # Keys may be null in a frame that is to be found wrong.
    same = F.lit(True)
    for k in KEYS:
        same = same & series[k].eqNullSafe(listed[k])
    both = series.join(listed, same, "full").join(frame.agg(F.count_distinct("date").alias("date_count")))
    seen, chosen = F.coalesce("seen", F.lit(False)), F.coalesce("chosen", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        *(total(k).alias(k) for k in rows), _count(seen & (F.col("dates") != F.col("date_count"))).alias("incomplete_series_count"), _count(seen & (F.col("categories") != 1)).alias("category_instability_series_count"),
        total(F.when(~seen, chosen)).alias("missing_selected_keys"), _count(seen & (chosen == 0)).alias("unexpected_frame_keys"),
        total("chosen").alias("selected_series_count"), total("other_version").alias("manifest_version_mismatch_rows"),
    )


def active(frame: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of selected series from their active start on. The manifest has one narrow row per series."""
    return frame.join(manifest.where("included").select(*KEYS, "active_start_date"), KEYS).where("date >= active_start_date")


def zero_runs(frame: DataFrame) -> DataFrame:
    """Longest run of days without sales of each series that has one."""
    w = Window.partitionBy(*KEYS).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    island = frame.select(*KEYS, "quantity_sold", F.sum((F.col("quantity_sold") > 0).cast("int")).over(w).alias("island"))
    runs = island.where("quantity_sold = 0").groupBy(*KEYS, "island").count()
    return runs.groupBy(*KEYS).agg(F.max("count").alias("max_zero_run_days"))


def price_changes(frame: DataFrame) -> DataFrame:
    """Relative change against the last known price of the series."""
    w = Window.partitionBy(*KEYS).orderBy("date")
    known = frame.where("unit_price IS NOT NULL")
    return known.select(*KEYS, "date", F.abs(F.try_divide("unit_price", F.lag("unit_price").over(w)) - 1).alias("price_change"))


def quality_profile(frame: DataFrame, manifest: DataFrame, limits: Thresholds = Thresholds()) -> dict[str, Any]:
    """Ratios and warning counts; warnings never fail a dataset."""
    live, chosen = active(frame, manifest), manifest.where("included")
    ratio = lambda df: df.agg(F.avg(F.col("unit_price").isNull().cast("double"))).first()[0]
    top = nearest_quantile(frame, "quantity_sold", limits.extreme_quantity_quantile, Workspace(frame.sparkSession))
    runs = zero_runs(live).agg(_count(F.col("max_zero_run_days") > limits.long_zero_run_days), F.max("max_zero_run_days")).first()
    told = {
        "canonical_missing_price_ratio": ratio(frame),
        "active_missing_price_ratio": ratio(live),
        "high_missing_price_series_count": chosen.where(F.col("active_missing_price_ratio") > limits.series_missing_price).count(),
        "long_zero_run_series_count": runs[0],
        "max_zero_run_days": runs[1],
        "inactive_tail_series_count": chosen.where(F.col("trailing_zero_days") > limits.inactive_tail_days).count(),
        "quantity_extreme_threshold": top,
        "extreme_quantity_rows": frame.where(F.col("quantity_sold") > top).count(),
        "extreme_price_change_rows": price_changes(frame).where(F.col("price_change") > limits.extreme_price_change).count(),
    }
    codes = {"GLOBAL_MISSING_PRICE": (told["active_missing_price_ratio"] or 0) > limits.global_missing_price}
    codes |= {c: told[k] > 0 for c, k in (("HIGH_MISSING_PRICE_SERIES", "high_missing_price_series_count"), ("LONG_ZERO_RUN_SERIES", "long_zero_run_series_count"), ("INACTIVE_TAIL_SERIES", "inactive_tail_series_count"), ("EXTREME_QUANTITY_ROWS", "extreme_quantity_rows"), ("EXTREME_PRICE_CHANGE_ROWS", "extreme_price_change_rows"))}
    return {"profile": told, "warnings": [c for c, on in codes.items() if on]}


def protocol_coverage(demand: DataFrame) -> DataFrame:
    """Dates and series, read from key columns only: target values stay out of the plan."""
    return demand.select("date", *KEYS).agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count_distinct(F.struct(*KEYS)).alias("series_count"))


def protocol_checks(demand: DataFrame, manifest: DataFrame, protocol, dataset_version: str, metadata: dict[str, Any] | None = None, frozen: dict[str, Any] | None = None) -> dict[str, Any]:
    """Leakage and consistency checks of a protocol against its panel and manifest, and, where given,
    against the dataset's metadata and what an earlier freeze has pinned."""
    seen = protocol_coverage(demand).first()
    folds, locked = protocol.folds, protocol.folds[-1]
    chosen = manifest.where("included")
    short = {f.fold_id: chosen.where(F.col("eligibility_history_days") + (f.train_end - folds[0].train_end).days < protocol.minimum_history).count() for f in folds}
    ends = manifest.agg(F.collect_set("reference_end_date"), F.collect_set("eligibility_cutoff_date"), F.collect_set("dataset_version")).first()
    checks = {
        "dataset_version_match": ends[2] == [dataset_version],
        "selected_series_count_match": chosen.count() == seen["series_count"],
        "dataset_start_match": seen["min_date"] == folds[0].train_start,
        "dataset_end_match": seen["max_date"] == locked.evaluation_end,
        "folds_chronological": all(a.evaluation_end < b.evaluation_start and a.train_end < b.train_end for a, b in zip(folds, folds[1:], strict=False)),
        "segment_reference_matches_final_cutoff": ends[0] == [locked.train_end],
        "eligibility_cutoff_match": ends[1] == [folds[0].train_end],
        "minimum_history_satisfied": not any(short.values()),
        "final_targets_excluded_from_development": all(f.evaluation_end < locked.evaluation_start for f in protocol.development),
        "evaluation_windows_contiguous": all(b.evaluation_start == a.evaluation_end + timedelta(days=1) for a, b in zip(folds, folds[1:], strict=False)),
        "segment_not_used_as_model_feature": all("segment" not in names for names in FEATURE_SETS.values()),
        "target_features_are_lagged": min(LAGS) >= 1,
        "transforms_fit_per_fold": protocol.transforms_fit_scope == "fold_training_only",
        "seasonal_naive_is_recursive": protocol.recursive,
        "future_price_is_lagged": all("unit_price" not in names for names in FEATURE_SETS.values()),
    }
    if metadata is not None:
        checks |= {
            "metadata_dataset_version_match": metadata.get("dataset_version") == dataset_version,
            "metadata_eligibility_cutoff_match": metadata.get("eligibility_cutoff_date") == str(folds[0].train_end),
            "schema_version_match": metadata.get("schema_version") == SCHEMA_VERSION,
            "cohort_definition_version_match": metadata.get("cohort_definition_version") == COHORT_VERSION,
        }
    if frozen is not None:
        checks["manifest_checksum_match"] = frozen.get("manifest_hash") == content_hash(manifest)
    return {"status": "passed" if all(checks.values()) else "failed", "checks": checks, "short_series": short, "target_columns_read": [], "min_date": seen["min_date"], "max_date": seen["max_date"]}


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def unique_on(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, after a check that its keys are unique."""
    require(duplicated_rows(df, keys).first()[0] == 0, f"{what}: keys {keys} are not unique")
    return df


def dates_of(df: DataFrame) -> tuple[date, date]:
    r = df.agg(F.min("date"), F.max("date")).first()
    return r[0], r[1]
