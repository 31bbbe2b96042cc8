"""Whole runs: preparing a dataset, freezing a protocol, running and reproducing the baseline suite."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..artifacts import content_hash, read_json, source_manifest, stable_id, write_json, write_table
from ..config import COHORT_VERSION, FEATURE_SETS, SCHEMA_VERSION, Protocol, Settings, rolling_protocol
from ..functions.columns import KEYS
from ..sources import files, retail_csv
from . import compare, features, forecast, learned, manifest, validate
from .publish import publish, readable


def prepare(spark: SparkSession, folder: str, output: str, settings: Settings) -> dict[str, Any]:
    """Raw files to canonical table, manifest and reports under ``output``."""
    found = retail_csv.discover(folder)
    version = stable_id({"files": {k: v["sha256"] for k, v in source_manifest(found)["files"].items()}, "settings": settings.model_dump(mode="json"), "versions": [SCHEMA_VERSION, COHORT_VERSION, retail_csv.ADAPTER_VERSION]}, f"retail-{settings.data.profile}")
    sales, prices = retail_csv.read_sales(spark, found["sales"]), retail_csv.read_prices(spark, found["prices"])
    calendar = retail_csv.read_calendar(spark, found["calendar"], settings.data.store_id)
    days = retail_csv.day_columns(sales.columns)
    mine = lambda df: df.where(F.col("store_id") == settings.data.store_id)
    raw = validate.raw_checks(mine(sales), calendar, mine(prices), spark.createDataFrame([(d,) for d in days], "d string")).first().asDict()
    validate.require(not any(raw.values()), f"raw tables failed validation: {raw}")
    limit = settings.data.series_limit if settings.data.profile == "smoke" else None
    everything = retail_csv.canonical(sales, calendar, prices, settings.data.store_id, days, limit)
    write_table(everything, f"{output}/all", [*KEYS, "date"])
    everything = spark.read.parquet(f"{output}/all")
    told = validate.validate_canonical(everything)
    validate.require(told["status"] == "passed", f"canonical table failed validation: {told}")
    first, last = validate.dates_of(everything)
    protocol = rolling_protocol(first, last, settings.forecast.horizon, settings.forecast.development_folds, bands=[(1, settings.forecast.horizon)], minimum_history=settings.forecast.minimum_history)
    cutoff = protocol.folds[0].train_end
    made = manifest.build(everything, version, protocol.folds[-1].train_end, cutoff, settings)
    write_table(made, f"{output}/manifest", KEYS)
    made = spark.read.parquet(f"{output}/manifest")
    validate.require(made.where("included").limit(1).count() > 0, "no eligible series remain")
    manifest_told = validate.validate_manifest(made)
    validate.require(manifest_told["status"] == "passed", f"manifest failed validation: {manifest_told}")
    demand = everything.join(made.where("included").select(*KEYS), KEYS, "left_semi")
    write_table(demand, f"{output}/demand", [*KEYS, "date"])
    demand = spark.read.parquet(f"{output}/demand")
    blocking = validate.quality_counters(demand, made, version).first().asDict() | validate.unordered_rows(demand).first().asDict()
    passed = blocking["selected_series_count"] > 0 and not any(v for k, v in blocking.items() if k != "selected_series_count")
    report = {"dataset_version": version, "status": "passed" if passed else "failed", "raw_validation": raw, "validation": told, "manifest_validation": manifest_told, "blocking_checks": blocking, **validate.quality_profile(demand, made, settings.thresholds), "rows": demand.count(), "series": made.where("included").count()}
    write_json(report, f"{output}/quality_report.json")
    write_json(source_manifest(found), f"{output}/source_manifest.json")
    write_json({"dataset_version": version, "eligibility_cutoff_date": str(cutoff), "reference_end_date": str(protocol.folds[-1].train_end), "series_count": report["series"], "row_count": report["rows"], "quality_status": report["status"], "profile": settings.data.profile, "schema_version": SCHEMA_VERSION, "cohort_definition_version": COHORT_VERSION}, f"{output}/metadata.json")
    return report


def freeze(demand: DataFrame, made: DataFrame, protocol: Protocol, dataset_version: str, output: str, metadata: dict[str, Any] | None = None) -> dict[str, Any]:
    """Checks a protocol and writes it with content hashes; raises if a check fails.

    What an earlier freeze in the same place has pinned must not have changed.
    """
    earlier = f"{output}/freeze.json"
    report = validate.protocol_checks(demand, made, protocol, dataset_version, metadata, read_json(earlier) if files.exists(earlier) else None)
    validate.require(report["status"] == "passed", f"protocol checks failed: {report['checks']}")
    write_json(protocol.model_dump(mode="json"), f"{output}/protocol.json")
    write_json(report, f"{output}/leakage_report.json")
    frozen = {"protocol_id": stable_id(protocol.model_dump(mode="json"), "protocol"), "manifest_hash": content_hash(made), "dataset_version": dataset_version}
    write_json(frozen, f"{output}/freeze.json")
    return frozen


def run_baselines(demand: DataFrame, made: DataFrame, protocol: Protocol, output: str) -> dict[str, Any]:
    """Forecasts, scores and ranking of the development folds, published whole with content hashes."""
    return publish(demand.sparkSession, output, lambda at: _baselines(demand, made, protocol, at), ["folds", "predictions", "series_metrics", "aggregate_metrics"], ["result.json", "summary.json"])


def _baselines(demand: DataFrame, made: DataFrame, protocol: Protocol, output: str) -> dict[str, Any]:
    spark = demand.sparkSession
    frame = forecast.fold_frame(demand, made, forecast.fold_table(spark, protocol))
    write_table(frame, f"{output}/folds")
    frame = forecast.check_fold_frame(spark.read.parquet(f"{output}/folds"), made, protocol)
    write_table(forecast.forecasts(frame, protocol), f"{output}/predictions", [*forecast.SERIES, "model_id", "horizon"])
    predictions = spark.read.parquet(f"{output}/predictions")
    write_table(forecast.series_metrics(predictions, frame, forecast.band_table(spark, protocol)), f"{output}/series_metrics")
    metrics = spark.read.parquet(f"{output}/series_metrics")
    write_table(forecast.aggregate_metrics(metrics), f"{output}/aggregate_metrics")
    aggregate = spark.read.parquet(f"{output}/aggregate_metrics")
    rank = [r.asDict() for r in forecast.ranking(aggregate).orderBy("rank").collect()]
    tables = {"predictions": predictions, "series_metrics": metrics, "aggregate_metrics": aggregate}
    result = {"run_id": stable_id({"protocol": protocol.model_dump(mode="json"), "manifest": content_hash(made)}, "baselines"), "folds": [f.fold_id for f in protocol.development], "models": sorted(forecast.model_ids(protocol)), "rows": {k: t.count() for k, t in tables.items()}, "hashes": {k: content_hash(t) for k, t in tables.items()}, "locked_fold_read": False}
    write_json(result, f"{output}/result.json")
    write_json({"ranking": rank, "best_model_id": rank[0]["model_id"] if rank else None, "scope": "development_folds_only"}, f"{output}/summary.json")
    return result


def verify_baselines(demand: DataFrame, made: DataFrame, protocol: Protocol, reference: str, output: str) -> dict[str, Any]:
    """Runs the suite again and compares everything that must be equal."""
    before, now = read_json(f"{readable(reference)}/result.json"), run_baselines(demand, made, protocol, output)
    checks = {k: before[k] == now[k] for k in ("run_id", "folds", "models", "rows", "hashes", "locked_fold_read")}
    report = {"status": "passed" if all(checks.values()) else "failed", "checks": checks}
    write_json(report, f"{output}/reproducibility.json")
    return report


def pinned(made: DataFrame, protocol: Protocol, baselines: str) -> dict[str, Any]:
    """The baseline run's result, after a check that it was made from this manifest and protocol and is as it was written."""
    baselines, spark = readable(baselines), made.sparkSession
    result = read_json(f"{baselines}/result.json")
    run = stable_id({"protocol": protocol.model_dump(mode="json"), "manifest": content_hash(made)}, "baselines")
    validate.require(result["run_id"] == run, f"baselines were made from another manifest or protocol: {result['run_id']}, expected {run}")
    validate.require(result["locked_fold_read"] is False, "baselines have read the locked fold")
    for name, want in result["hashes"].items():
        validate.require(content_hash(spark.read.parquet(f"{baselines}/{name}")) == want, f"{name} of the baselines has changed")
    return result


def run_challengers(demand: DataFrame, made: DataFrame, protocol: Protocol, baselines: str, output: str, series_limit: int | None = None, iterations: int = 2000, **training: Any) -> dict[str, Any]:
    """Boosted trees of every feature set on the development folds, scored like the baselines, ranked with them, compared in pairs, and published whole."""
    make = lambda at: _challengers(demand, made, protocol, baselines, at, series_limit, iterations, **training)
    return publish(demand.sparkSession, output, make, ["series_metrics", "aggregate_metrics"], ["result.json"])


def _challengers(demand: DataFrame, made: DataFrame, protocol: Protocol, baselines: str, output: str, series_limit: int | None, iterations: int, **training: Any) -> dict[str, Any]:
    spark, base, baselines = demand.sparkSession, pinned(made, protocol, baselines), readable(baselines)
    codes = features.catalog(demand, made)
    codes = codes.where(F.col("sku_code") < series_limit) if series_limit else codes
    paths = []
    for fold in protocol.development:
        for name in FEATURE_SETS:
            paths.append(f"{output}/predictions/{fold.fold_id}_{name}")
            made_ = learned.boosted_trees(demand, codes, fold, name, protocol.horizon, save_to=f"{output}/models/{fold.fold_id}_{name}", **training)
            write_table(made_.withColumn("raw", F.col("prediction")), paths[-1])
    predictions, frame = spark.read.parquet(*paths), spark.read.parquet(f"{baselines}/folds")
    write_table(forecast.series_metrics(predictions, frame, forecast.band_table(spark, protocol)), f"{output}/series_metrics")
    metrics, theirs = spark.read.parquet(f"{output}/series_metrics"), spark.read.parquet(f"{baselines}/series_metrics")
    # Only series that the challengers forecast are compared and ranked.
    theirs = theirs.join(metrics.select(*forecast.SERIES).distinct(), forecast.SERIES, "left_semi")
    write_table(forecast.aggregate_metrics(forecast.union_metrics(theirs, metrics)), f"{output}/aggregate_metrics")
    rank = [r.asDict() for r in forecast.ranking(spark.read.parquet(f"{output}/aggregate_metrics")).orderBy("rank").collect()]
    models = sorted(r[0] for r in metrics.select("model_id").distinct().collect())
    against = [m for m in ("croston_sba", "seasonal_naive_lag_7") if m in base["models"]]
    compared = [{"challenger": m, "baseline": b, **compare.bootstrap(compare.paired(metrics, theirs, m, b), iterations).first().asDict()} for m in models for b in against]
    result = {"baseline_run_id": base["run_id"], "folds": [f.fold_id for f in protocol.development], "models": models, "ranking": rank, "comparisons": compared, "locked_fold_read": False}
    write_json(result, f"{output}/result.json")
    return result
