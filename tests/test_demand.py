"""Pinned values and invariants of the demand pipeline."""

from __future__ import annotations

import json
import math
import threading
import urllib.request
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from demandloom import serve
from demandloom.artifacts import content_hash, stable_id
from demandloom.cli import main
from demandloom.config import Data, Protocol, Segmentation, Settings, merged, rolling_protocol
from demandloom.functions.columns import joined_names, segment
from demandloom.operators import compare, features, forecast, learned, manifest, suite, validate
from demandloom.sources import retail_csv

DAY = date(2026, 1, 1)
DEMAND = "date date, store_id string, sku_id string, category string, subcategory string, quantity_sold double, unit_price double, event_flag boolean, event_name string, snap_eligible boolean, source string"
SMALL = Protocol(folds=[{"fold_id": "development_1", "role": "development", "train_start": DAY, "train_end": date(2026, 1, 8), "evaluation_start": date(2026, 1, 9), "evaluation_end": date(2026, 1, 10)}, {"fold_id": "locked_final", "role": "locked", "train_start": DAY, "train_end": date(2026, 1, 10), "evaluation_start": date(2026, 1, 11), "evaluation_end": date(2026, 1, 12)}], horizon=2, minimum_history=4, lags=[1, 2], bands=[(1, 1), (2, 2)], weight_window=2)


def panel(spark, series, days):
    """series: sku -> (quantity of a day, price of a day)."""
    rows = [(DAY + timedelta(days=i), "CA_1", k, "C", "S", float(q(i)), p(i), False, None, False, "t") for k, (q, p) in series.items() for i in range(days)]
    return spark.createDataFrame(rows, DEMAND)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def array(values):
    return F.array(*map(F.lit, map(float, values)))


def test_seasonal_naive_repeats_its_tail(spark):
    assert one(spark, forecast.seasonal_naive(array(range(1, 8)), 10, 7)) == [1, 2, 3, 4, 5, 6, 7, 1, 2, 3]
    assert one(spark, forecast.seasonal_naive(array([1, 2]), 3, 7)) is None


def test_croston(spark):
    z, p, gap = None, None, 0
    for y in [0, 2, 0, 0, 2]:
        gap += 1
        if y > 0:
            z, p, gap = (y, gap, 0) if z is None else (z + 0.1 * (y - z), p + 0.1 * (gap - p), 0)
    got = one(spark, forecast.croston_sba(array([0, 2, 0, 0, 2]), 3, 0.1))
    assert got == pytest.approx([0.95 * z / p] * 3) and got[0] > 0
    assert one(spark, forecast.croston_sba(array([0, 0, 0]), 2, 0.1)) == [0.0, 0.0]


def test_scales(spark):
    assert one(spark, forecast.scales(array([0, 1, 2, 3]))) == (1.0, 1.0)
    assert one(spark, forecast.scales(array([0, 0, 0]))) == (None, None)
    assert one(spark, forecast.scales(array([0, 5]))) == (None, None)


def test_segment_bounds_are_strict(spark):
    assert [one(spark, segment(F.lit(x))) for x in (0.19, 0.20, 0.60, 0.61)] == ["fast", "medium", "medium", "intermittent"]


def test_event_names(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("a", "b")], "x string, y string").select(joined_names("x", "y").alias("v"))
    assert [r.v for r in df.collect()] == ["a", None, "a | b"]


def test_metrics_of_a_series(spark):
    frame = spark.createDataFrame([("f", "CA_1", "A", "fast", [(DAY + timedelta(days=i), float(i)) for i in range(4)], [4.0, 5.0], 2.0, DAY + timedelta(days=3))], "fold_id string, store_id string, sku_id string, segment string, history array<struct<date:date,q:double>>, actual array<double>, weight_revenue double, train_end date")
    made = spark.createDataFrame([("f", "CA_1", "A", "fast", "m", h, 3.0, a) for h, a in ((1, 4.0), (2, 5.0))], "fold_id string, store_id string, sku_id string, segment string, model_id string, horizon int, raw double, actual double")
    r = forecast.series_metrics(made, frame, spark.createDataFrame([("all", 1, 2)], "horizon_band string, horizon_start int, horizon_end int")).first()
    assert (r.rmsse, r.mase, r.wape, r.normalized_bias) == pytest.approx((math.sqrt(2.5), 1.5, 1 / 3, -1 / 3))


def test_csv_to_canonical(spark, tmp_path):
    (tmp_path / "sales_train_validation.csv").write_text("id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2\nF1_v,FOODS_1_001,FOODS_1,FOODS,CA_1,CA,1,2\nF2_v,FOODS_1_002,FOODS_1,FOODS,CA_1,CA,0,1\n")
    (tmp_path / "calendar.csv").write_text("date,wm_yr_wk,d,event_name_1,event_name_2,snap_CA\n2011-01-29,11101,d_1,,,0\n2011-01-30,11101,d_2,Sporting,,1\n")
    with pytest.raises(FileNotFoundError, match=r"sell_prices\.csv"):
        retail_csv.discover(tmp_path)
    (tmp_path / "sell_prices.csv").write_text("store_id,item_id,wm_yr_wk,sell_price\nCA_1,FOODS_1_001,11101,2.5\nCA_1,FOODS_1_002,11101,3.25\n")
    settings = Settings(data=Data(profile="smoke", series_limit=1), forecast={"horizon": 1, "minimum_history": 1, "development_folds": 0})
    report = suite.prepare(spark, str(tmp_path), str(tmp_path / "out"), settings)
    rows = spark.read.parquet(str(tmp_path / "out/demand")).orderBy("date").collect()
    assert [(r.sku_id, r.quantity_sold, r.unit_price, r.event_flag, r.event_name, r.snap_eligible) for r in rows] == [("FOODS_1_001", 1.0, 2.5, False, None, False), ("FOODS_1_001", 2.0, 2.5, True, "Sporting", True)]
    assert report["status"] == "passed" and report["blocking_checks"]["event_semantic_mismatch_rows"] == 0
    assert serve.metadata(tmp_path / "out/metadata.json")["row_count"] == 2
    assert retail_csv.day_columns(["d_10", "d_2", "x", "d_1"]) == ["d_1", "d_2", "d_10"]


def test_stratified_sample_is_even_and_repeatable(spark):
    kinds = {"f": lambda i: 1, "m": lambda i: i >= 5, "s": lambda i: i >= 8}
    df = panel(spark, {f"{k}{n}": (q, lambda i: 1.0) for k, q in kinds.items() for n in range(3)}, 10)
    end = DAY + timedelta(days=8)
    made = manifest.profile(df, end, end, 1)
    once = manifest.stratified(made, 6).collect()
    assert {s: sum(r.segment == s for r in once) for s in ("fast", "medium", "intermittent")} == {"fast": 2, "medium": 2, "intermittent": 2}
    assert sorted(once) == sorted(manifest.stratified(made, 6).collect())
    assert manifest.quotas(8) == {"fast": 3, "medium": 3, "intermittent": 2}


def test_eligibility_counts_active_days(spark):
    df = panel(spark, {"early": (lambda i: 1, lambda i: 1.0), "late": (lambda i: i >= 5, lambda i: 1.0 if i >= 5 else None)}, 10)
    got = {r.sku_id: r for r in manifest.profile(df, DAY + timedelta(days=8), DAY + timedelta(days=6), 4).collect()}
    assert (got["early"].eligibility_history_days, got["early"].eligible) == (7, True)
    assert (got["late"].eligibility_history_days, got["late"].eligibility_exclusion_reason) == (2, "insufficient_active_history")


def test_canonical_validation(spark):
    df = panel(spark, {"a": (lambda i: 1, lambda i: 1.0)}, 2)
    assert validate.validate_canonical(df)["status"] == "passed"
    again = validate.validate_canonical(df.union(df.limit(1)))
    assert (again["status"], again["duplicate_keys"]) == ("failed", 2)
    assert validate.validate_canonical(df.drop("source"))["missing_columns"] == ["source"]
    with pytest.raises(ValueError, match="not unique"):
        validate.unique_on(df, ["store_id"], "x")


def test_features_are_causal_and_share_one_exchange(spark):
    made = [features.causal(panel(spark, {"a": (lambda i, last=last: last if i == 69 else i % 5 + 1, lambda i: 2.0)}, 70)) for last in (1.0, 999.0)]
    a, b = ([r.asDict() for r in m.orderBy("date").collect()] for m in made)
    assert a[:69] == b[:69]
    assert (b[69]["lag_1"], b[69]["lag_7"], b[69]["rolling_mean_7"]) == pytest.approx((4.0, 3.0, 22 / 7))
    assert {k: v for k, v in a[69].items() if k != "quantity_sold"} == {k: v for k, v in b[69].items() if k != "quantity_sold"}
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_recursive_state_uses_predictions_not_actuals(spark):
    row = ("CA_1", "A", [float(i) for i in range(5, 61)], [1.0] * 7, [0.0, 1.0], [0.0, 0.0], 1830.0, 60, 60.0, 60, 1, 10.0)
    s = spark.createDataFrame([row], "store_id string, sku_id string, target array<double>, price array<double>, events array<double>, snaps array<double>, total double, days long, price_total double, price_days long, since int, prediction double")
    fold = SMALL.folds[0]
    assert learned.step_features(s, fold, 1).first()["lag_1"] == 60.0
    r = learned.step_features(learned.advance(s), fold, 2).first()
    assert (r["lag_1"], r["event_flag_feature"], r["days_since_nonzero"], r["context_mean"]) == (10.0, 1.0, 1.0, 1840.0 / 61)


def suite_tables(spark):
    df = panel(spark, {f"ITEM_{k}": (lambda i, k=k: (i + k) % 4, lambda i, k=k: float(k)) for k in (1, 2)}, 12)
    rows = [("v", "CA_1", f"ITEM_{k}", True, "fast", DAY, date(2026, 1, 10), date(2026, 1, 8), 8) for k in (1, 2)]
    return df, spark.createDataFrame(rows, "dataset_version string, store_id string, sku_id string, included boolean, segment string, active_start_date date, reference_end_date date, eligibility_cutoff_date date, eligibility_history_days long")


def test_baseline_suite_is_reproducible_and_leaves_the_locked_fold(spark, tmp_path):
    df, made = suite_tables(spark)
    assert validate.protocol_checks(df, made, SMALL, "v")["status"] == "passed"
    first = suite.run_baselines(df, made, SMALL, str(tmp_path / "a"))
    assert first["folds"] == ["development_1"] and first["rows"]["predictions"] == 12
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert suite.verify_baselines(df, made, SMALL, str(tmp_path / "a"), str(tmp_path / "b"))["status"] == "passed"
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = spark.read.parquet(str(tmp_path / "a/predictions"))
    assert got.agg(F.max("forecast_date")).first()[0] == date(2026, 1, 10)
    assert "Python" not in forecast.forecasts(forecast.fold_frame(df, made, forecast.fold_table(spark, SMALL)), SMALL)._jdf.queryExecution().executedPlan().toString()


def test_coverage_reads_no_target(spark, tmp_path):
    df, _ = suite_tables(spark)
    df.write.parquet(str(tmp_path / "d"))
    plan = validate.protocol_coverage(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<date:date,store_id:string,sku_id:string>" in plan


def test_protocol_invariants():
    p = rolling_protocol(date(2020, 1, 1), date(2021, 12, 31))
    assert [f.fold_id for f in p.development] == ["development_1", "development_2", "development_3"] and p.folds[-1].locked
    bad = p.model_dump()
    bad["folds"][1]["evaluation_start"] -= timedelta(days=1)
    with pytest.raises(ValueError, match="evaluation must start"):
        Protocol(**bad)
    with pytest.raises(ValueError, match="ordered"):
        Segmentation(fast_max_zero_ratio=0.7)
    with pytest.raises(ValueError, match="release"):
        Data(profile="release", series_limit=3)
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert stable_id({"b": 1, "a": 2}, "x") == stable_id({"a": 2, "b": 1}, "x")


def test_late_quantiles_and_probabilistic_scores(spark):
    base = spark.range(101).select(F.lit("f").alias("fold_id"), F.lit("m").alias("model_id"), F.lit("fast").alias("segment"), F.lit(1.0).alias("actual"))
    late = base.limit(1).withColumns({"q10": F.lit(3.0), "q50": F.lit(1.0), "q90": F.lit(2.0)})
    both = forecast.union_metrics(base, late)
    assert dict(both.dtypes)["q90"] == "double" and both.where("q90 IS NULL").count() == 101
    r = compare.ordered_quantiles(late).first()
    assert (r.q10, r.q50, r.q90, r.crossed) == (1.0, 2.0, 3.0, True)
    got = compare.probabilistic_metrics(compare.ordered_quantiles(late)).where("segment = 'all'").first()
    assert (got.interval_80_coverage, got.interval_80_mean_width, got.pinball_q50) == (1.0, 2.0, 0.5)


def test_content_hash_ignores_partitioning(spark):
    df = spark.range(50).select("id", (F.col("id") / 3).alias("x"))
    assert content_hash(df) == content_hash(df.repartition(7)) != content_hash(df.limit(49))


def test_api_and_cli(tmp_path, capsys):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"dataset_version": "v", "profile": "smoke", "quality_status": "passed", "series_count": 30, "row_count": 58230}))
    http = serve.server(path)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    get = lambda p: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{p}", timeout=5).read())
    assert get("/health")["status"] == "ok"
    assert (get("/metadata")["series_count"], get("/metadata")["row_count"]) == (30, 58230)
    http.shutdown()
    assert serve.metadata(tmp_path / "none")["dataset_version"] == "unavailable"
    assert main(["validate-config"]) == 0 and json.loads(capsys.readouterr().out)["forecast"]["horizon"] == 28
