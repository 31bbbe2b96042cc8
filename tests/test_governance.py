"""Bootstrap against NumPy, pinning of upstream runs, the challenger suite and the checks around them."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_demand import DAY, SMALL, panel, suite_tables

from demandloom.config import COHORT_VERSION, SCHEMA_VERSION, Fold
from demandloom.functions.columns import KEYS
from demandloom.operators import compare, features, forecast, learned, suite, validate


def pairs(spark, n=40):
    rng = np.random.default_rng(1)
    rows = [(f, "S", f"k{i:03d}", float(rng.normal()), float(rng.normal()), float(rng.random()) + 0.1) for f in ("f1", "f2") for i in range(n)]
    return rows, spark.createDataFrame(rows, "fold_id string, store_id string, sku_id string, challenger_rmsse double, baseline_rmsse double, weight_revenue double")


def interval(values):
    return pytest.approx((np.quantile(values, 0.025), np.quantile(values, 0.975)))


def test_bootstrap_by_index_equals_numpy(spark):
    rows, table = pairs(spark)
    data = [np.array([(r[3] - r[4], r[5]) for r in rows if r[0] == f]) for f in ("f1", "f2")]
    index = np.random.default_rng(42).integers(0, 40, size=(50, 40), dtype=np.int32)
    values = [np.mean([(x[i, 0] * x[i, 1]).sum() / x[i, 1].sum() for x in data]) for i in index]
    r = compare.bootstrap(table, 50, by_index=True).first()
    assert (r.ci_lower, r.ci_upper) == interval(values) and r.fold_count == 2


def test_bootstrap_by_weights_equals_numpy(spark):
    """The same weights, drawn once more from the hashes; both folds get a series' weight, which is 1 on average."""
    rows, table = pairs(spark)
    keys = table.select(*KEYS).distinct().select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(199))).alias("b"))
    u = {(r.sku_id, r.b): r.u for r in keys.select("sku_id", "b", (F.pmod(F.xxhash64(*KEYS, "b", F.lit(42)), F.lit(1 << 52)) / float(1 << 52)).alias("u")).collect()}
    law = np.cumsum(np.exp(-1) / np.array([float(np.prod(np.arange(1, k + 1))) for k in range(18)]))
    m = {k: int((law < x).sum()) for k, x in u.items()}
    assert np.mean(list(m.values())) == pytest.approx(1, abs=0.05) and np.var(list(m.values())) == pytest.approx(1, abs=0.1)
    values = []
    for b in range(200):
        fold = lambda f: [(m[r[2], b], r[3] - r[4], r[5]) for r in rows if r[0] == f]
        values.append(np.mean([sum(k * d * w for k, d, w in fold(f)) / sum(k * w for k, _, w in fold(f)) for f in ("f1", "f2")]))
    r = compare.bootstrap(table, 200).first()
    assert (r.ci_lower, r.ci_upper) == interval(values)
    other = compare.bootstrap(table, 2000, by_index=True).first()
    one = compare.bootstrap(table, 2000).first()
    assert abs(one.ci_upper - one.ci_lower - other.ci_upper + other.ci_lower) < 0.15 * (other.ci_upper - other.ci_lower)


def test_fold_frame_cuts_each_fold_from_one_list(spark):
    df, made = suite_tables(spark)
    folds = forecast.fold_table(spark, SMALL, SMALL.folds)
    frame = forecast.fold_frame(df, made, folds)
    got = {(r.fold_id, r.sku_id): r for r in frame.collect()}
    one = got["development_1", "ITEM_1"]
    assert [x["q"] for x in one.history] == [float((i + 1) % 4) for i in range(8)] and one.actual == [1.0, 2.0]
    assert one.weight_revenue == float(6 % 4 + 1 + 8 % 4) - 1 + 0.0 or one.weight_revenue == sum(float((i + 1) % 4) for i in (6, 7))
    assert len(got["locked_final", "ITEM_2"].history) == 10
    assert frame._jdf.queryExecution().executedPlan().toString().count("ObjectHashAggregate") >= 1


def test_short_series_are_an_error(spark):
    df = panel(spark, {"a": (lambda i: i % 3, lambda i: 1.0)}, 40)
    made = df.select(*KEYS).distinct().selectExpr("*", "true AS included", "'fast' AS segment", f"DATE'{DAY}' AS active_start_date")
    end = DAY + timedelta(days=37)
    fold = Fold(fold_id="f", role="development", train_start=DAY, train_end=end, evaluation_start=end + timedelta(days=1), evaluation_end=end + timedelta(days=2))
    with pytest.raises(ValueError, match="fewer than 56 days"):
        learned.long_enough(learned.state(df, features.catalog(df, made), fold, 100), fold)


def test_unordered_rows_are_counted_in_their_file(spark, tmp_path):
    rows = [("a", date(2026, 1, d)) for d in (1, 3, 2, 4)] + [("b", date(2026, 1, d)) for d in (3, 2, 1)]
    table = spark.createDataFrame(rows, "k string, date date").coalesce(1)
    table.write.parquet(str(tmp_path / "t"))
    assert validate.unordered_rows(spark.read.parquet(str(tmp_path / "t")), ["k"]).first()[0] == 3


def test_protocol_checks_read_metadata_and_pins(spark):
    df, made = suite_tables(spark)
    metadata = {"dataset_version": "v", "eligibility_cutoff_date": "2026-01-08", "schema_version": SCHEMA_VERSION, "cohort_definition_version": COHORT_VERSION}
    told = validate.protocol_checks(df, made, SMALL, "v", metadata, {"manifest_hash": "x"})
    assert [k for k, ok in told["checks"].items() if not ok] == ["manifest_checksum_match"]
    assert len(told["checks"]) == 20
    loose = SMALL.model_copy(update={"transforms_fit_scope": "all_rows", "recursive": False})
    told = validate.protocol_checks(df, made, loose, "v", metadata)
    assert [k for k, ok in told["checks"].items() if not ok] == ["transforms_fit_per_fold", "seasonal_naive_is_recursive"]
    metadata["schema_version"] = "other"
    assert not validate.protocol_checks(df, made, SMALL, "v", metadata)["checks"]["schema_version_match"]


def test_challengers_are_pinned_scored_ranked_and_compared(spark, tmp_path, monkeypatch):
    df, made = suite_tables(spark)
    suite.run_baselines(df, made, SMALL, str(tmp_path / "b"))
    saved = []

    def croston(demand, codes, fold, name, horizon, save_to=None, **more):
        saved.append((fold.fold_id, name, save_to))
        frame = forecast.fold_frame(demand, made, forecast.fold_table(spark, SMALL, [fold]))
        rows = forecast.forecasts(frame, SMALL).where("model_id = 'croston_sba'")
        return rows.select("fold_id", F.lit(f"gbt_{name}").alias("model_id"), *KEYS, "segment", "horizon", "prediction", "actual")

    monkeypatch.setattr(learned, "boosted_trees", croston)
    got = suite.run_challengers(df, made, SMALL, str(tmp_path / "b"), str(tmp_path / "c"), iterations=20)
    assert got["models"] == ["gbt_calendar", "gbt_full", "gbt_lag"] and {s[0] for s in saved} == {"development_1"} and all(s[2] for s in saved)
    score = {r["model_id"]: r["mean_weighted_rmsse"] for r in got["ranking"]}
    assert score["gbt_lag"] == pytest.approx(score["croston_sba"]) and len(score) == 6
    assert [c["difference"] for c in got["comparisons"] if c["baseline"] == "croston_sba"] == pytest.approx([0.0] * 3)
    other = made.withColumn("segment", F.lit("medium"))
    with pytest.raises(ValueError, match="another manifest"):
        suite.pinned(other, SMALL, str(tmp_path / "b"))
    spark.read.parquet(str(tmp_path / "b/series_metrics")).limit(1).write.mode("append").parquet(str(tmp_path / "b/aggregate_metrics"))
    with pytest.raises(ValueError, match="has changed"):
        suite.pinned(made, SMALL, str(tmp_path / "b"))


def test_a_second_freeze_keeps_to_the_first(spark, tmp_path):
    df, made = suite_tables(spark)
    frozen = suite.freeze(df, made, SMALL, "v", str(tmp_path))
    assert suite.freeze(df, made, SMALL, "v", str(tmp_path)) == frozen
    with pytest.raises(ValueError, match="manifest_checksum_match"):
        suite.freeze(df, made.withColumn("segment", F.lit("medium")), SMALL, "v", str(tmp_path))


def test_quality_counters_of_a_bad_panel(spark):
    """Each fault is counted once, in frames and manifests that don't fit one another."""
    kind = "date date, store_id string, sku_id string, category string, source string, quantity_sold double, unit_price double, event_flag boolean, event_name string"
    day = [date(2026, 1, k) for k in (1, 2, 3)]
    rows = [(d, "S", "A", "c", "s", 1.0, 2.0, False, None) for d in day]
    rows += [(day[0], "S", "B", "c", "s", float("nan"), -1.0, True, None), (day[1], "S", "B", "other", "", float("inf"), float("inf"), False, "x")]
    rows += [(day[0], None, "C", "c", "s", 1.0, None, False, None)]
    frame = spark.createDataFrame(rows, kind)
    listed = spark.createDataFrame([("v", "S", "A", True), ("old", "S", "B", True), ("v", "S", "D", True), ("v", "S", "E", False)], "dataset_version string, store_id string, sku_id string, included boolean")
    got = validate.quality_counters(frame, listed, "v").first().asDict()
    assert got == {
        "empty_required_rows": 2, "nonfinite_quantity_rows": 2, "nonfinite_price_rows": 1, "nonpositive_price_rows": 1, "event_semantic_mismatch_rows": 2, "incomplete_series_count": 2,
        "category_instability_series_count": 1, "missing_selected_keys": 1, "unexpected_frame_keys": 1, "selected_series_count": 3, "manifest_version_mismatch_rows": 1,
    }
    none = validate.quality_counters(frame.limit(0), listed.limit(0), "v").first().asDict()
    assert set(none.values()) == {0}
