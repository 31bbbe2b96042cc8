"""Storage without shuffles, order quantities, drift and smoothing, against plain computations."""

from __future__ import annotations

import itertools
import random
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.config import rolling_protocol
from demandloom.operators import drift, features, forecast, inventory, smoothing
from demandloom.operators.workspace import Workspace
from demandloom.sources.store import DemandStore

START = date(1998, 10, 1)


def demand(spark, days=500, series=5, stores=("S1", "S2"), seed=1):
    rng = random.Random(seed)
    rows = [(START + timedelta(days=t), s, f"I{k}", float(rng.randrange(k + 2)), 1.0 + k) for s in stores for k in range(series) for t in range(days)]
    return spark.createDataFrame(rows, "date date, store_id string, sku_id string, quantity_sold double, unit_price double")


@pytest.fixture()
def store(spark, tmp_path):
    made = DemandStore(spark, "demand_of_test", str(tmp_path / "demand")).create(demand(spark).withColumns({"event_flag": F.lit(False), "snap_eligible": F.lit(True)}), 3)
    yield made
    made.drop()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_work_needs_no_exchange(spark, store):
    rows = store.read()
    causal = features.causal(rows)
    assert "Exchange" not in plan(causal)
    assert causal.count() == 5000 and sorted(causal.columns)[0] == "context_mean"
    made = rows.select("store_id", "sku_id").distinct().selectExpr("*", "true AS included", "'fast' AS segment", f"DATE'{START}' AS active_start_date", "0 AS sku_code", "0 AS category_code", "0 AS subcategory_code")
    made = Workspace(spark).save(made)
    fold = rolling_protocol(START, START + timedelta(days=499)).development[0]
    for df in (features.training_frame(rows, made, fold, 100), forecast.fold_frame(rows, made, forecast.fold_table(spark, rolling_protocol(START, START + timedelta(days=499))))):
        p = plan(df)
        assert "hashpartitioning" not in p and "BroadcastHashJoin" in p, p


def test_filters_prune_partitions(spark, store):
    df = store.read(["S2"], date(1999, 2, 1), date(1999, 3, 31))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "store_part" in p.split("PartitionFilters")[1].split("]")[0] and "year_part" in p.split("PartitionFilters")[1].split("]")[0]
    assert df.count() == 59 * 5 and df.columns == ["date", "store_id", "sku_id", "quantity_sold", "unit_price", "event_flag", "snap_eligible"]


def test_a_load_replaces_its_partitions_only(spark, store):
    before = {tuple(r) for r in store.read().groupBy("store_id", F.year("date")).agg(F.sum("quantity_sold")).collect()}
    again = demand(spark, stores=("S2",)).where("year(date) = 1999").withColumns({"quantity_sold": F.lit(7.0), "event_flag": F.lit(False), "snap_eligible": F.lit(True)})
    store.replace(again)
    after = {tuple(r) for r in store.read().groupBy("store_id", F.year("date")).agg(F.sum("quantity_sold")).collect()}
    assert after - before == {("S2", 1999, 7.0 * 365 * 5)} and len(after) == len(before) == 6
    assert store.buckets() == 3 and "Exchange" not in plan(features.causal(store.read()))


def frames(spark, days=200, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(5):
        history = [(START + timedelta(days=t), float(rng.randrange(1 + 3 * k))) for t in range(days)]
        rows.append(("f", "S1", f"I{k}", "fast", START, START + timedelta(days=days - 1), history, [float(rng.randrange(5)) for _ in range(28)], 1.0))
    return spark.createDataFrame(rows, "fold_id string, store_id string, sku_id string, segment string, active_start_date date, train_end date, history array<struct<date:date,q:double>>, actual array<double>, weight_revenue double"), rows


def test_order_quantities_against_all_sums_of_errors(spark):
    df, rows = frames(spark)
    got = {(r.sku_id, r.assumption_set_id): r for r in inventory.recommend(df, lead_days=3, seasons=4).collect()}
    assert len(got) == 15
    for r in rows:
        q, actual = [x[1] for x in r[6]], r[7]
        days = [[q[len(q) - 28 + 7 * w + h] - q[len(q) - 35 + 7 * w + h] for w in range(4)] for h in range(3)]
        sums = sorted(sum(e) for e in itertools.product(*days))
        for s in inventory.SCENARIOS:
            x, level = got[r[2], s.assumption_set_id], s.shortage / (s.shortage + s.holding)
            count, safety = Counter(sums), None
            for total in sorted(count):
                if sum(n for t, n in count.items() if t <= total) >= level * len(sums):
                    safety = total
                    break
            assert (x.forecast_during_lead_time, x.inventory_position, x.safety_stock) == (sum(q[-7:-4]), sum(q[-7:]), safety)
            order = max(0, max(0, sum(q[-7:-4]) + safety) - sum(q[-7:]))
            assert x.recommended_order_qty == order and x.lost_units == max(0, sum(actual[:3]) - order - sum(q[-7:]))
    told = {(r.assumption_set_id, r.segment): r for r in inventory.scenario_metrics(inventory.recommend(df, 3, seasons=4)).collect()}
    assert len(told) == 6 and told["balanced", "all"].total_cost == sum(r.lost_units + r.left_units for k, r in got.items() if k[1] == "balanced")
    assert inventory.recommend(df.withColumn("history", F.slice("history", 1, 20))).count() == 0
    with pytest.raises(ValueError, match="lead time"):
        inventory.recommend(df, 8)


def test_histograms_of_halves_make_the_whole(spark):
    df = demand(spark, 60).withColumn("unit_price", F.when(F.col("sku_id") != "I2", F.col("unit_price") * 37))
    whole = sorted(map(tuple, drift.histograms(df, ["store_id"]).collect()))
    halves = [drift.histograms(df.where(c), ["store_id"]) for c in ("day(date) % 2 = 0", "day(date) % 2 = 1")]
    assert sorted(map(tuple, drift.merge(*halves).collect())) == whole
    assert {r[2] for r in whole if r[1] == "price"} >= {-1, 0}
    same = drift.stability(halves[0], halves[0], ["store_id"]).collect()
    assert all(r.stability_index == pytest.approx(0) and not r.drifted for r in same)
    other = drift.histograms(df.withColumn("quantity_sold", F.col("quantity_sold") + 10), ["store_id"])
    told = {r.feature: r for r in drift.stability(halves[0], other, ["store_id"]).where("store_id = 'S1'").collect()}
    assert told["quantity"].drifted and told["sold"].drifted and not told["price"].drifted
    a, b = ({r.bin: r.n for r in h.where("store_id = 'S1' AND feature = 'quantity'").collect()} for h in (halves[0], other))
    bins = set(a) | set(b)
    p, q = (np.array([(h.get(k, 0) + 0.5) / (sum(h.values()) + 0.5 * len(bins)) for k in sorted(bins)]) for h in (a, b))
    assert told["quantity"].stability_index == pytest.approx(((q - p) * np.log(q / p)).sum())
    assert drift.stability(halves[0], other.limit(0), ["store_id"]).count() == 6


def smoothed(y, horizon):
    best = None
    for a, g in smoothing.grid():
        level, sse = sum(y[:14]) / 14, 0.0
        season = [(y[k] + y[k + 7]) / 2 - level for k in range(7)]
        for v in y[14:]:
            e = v - level - season[0]
            level, season, sse = level + a * e, [*season[1:], season[0] + g * e], sse + e * e
        if best is None or sse < best[0]:
            best = (sse, a, g, [level + season[h % 7] for h in range(horizon)])
    return best


def test_smoothing_against_numpy(spark):
    df, rows = frames(spark, 90)
    got = {r.sku_id: r.e for r in df.select("sku_id", smoothing.ets(F.transform("history", lambda x: x["q"]), 10).alias("e")).collect()}
    for r in rows:
        sse, a, g, ahead = smoothed([x[1] for x in r[6]], 10)
        assert (got[r[2]].alpha, got[r[2]].gamma) == (a, g) and got[r[2]].sse == pytest.approx(sse) and list(got[r[2]].forecast) == pytest.approx(ahead)
    short = df.select(smoothing.ets(F.transform(F.slice("history", 1, 13), lambda x: x["q"]), 3).alias("e")).first()
    assert short.e is None


def test_ensembles_weigh_by_earlier_folds(spark):
    rows = [(f, "S", "A", "fast", m, START, START, 1, v, 2.0, v) for f in ("f1", "f2") for m, v in (("x", 1.0), ("y", 4.0))]
    made = spark.createDataFrame(rows, "fold_id string, store_id string, sku_id string, segment string, model_id string, cutoff_date date, forecast_date date, horizon int, prediction double, actual double, raw double")
    metrics = spark.createDataFrame([("f1", "x", "all", 1.0), ("f1", "y", "all", 0.5), ("f2", "x", "all", 9.0), ("f2", "y", "all", None)], "fold_id string, model_id string, horizon_band string, rmsse double")
    got = {r.fold_id: r.prediction for r in smoothing.ensemble(made, metrics, ["f1", "f2"]).collect()}
    assert got == pytest.approx({"f1": 2.5, "f2": (1 * 1.0 + 4 * 4.0) / 5})
    assert {r.prediction for r in smoothing.ensemble(made, metrics, ["f1", "f2"], weighted=False).collect()} == {2.5}
