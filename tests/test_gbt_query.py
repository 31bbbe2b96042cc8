"""Boosted trees: against a plain booster, in one task and in jobs, and as the recursive forecast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandloom.config import rolling_protocol
from demandloom.operators import boosting, features, learned, manifest
from demandloom.operators.workspace import Workspace
from demandloom.plans import queries

SF = "/root/testdata/sf0.001"
NAMES = ["a", "b", "c", "d", "e"]
SMALL = boosting.Parameters(rounds=12, depth=4, step=0.3, seed=3)


def fixture(n=200):
    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(size=n), rng.integers(0, 5, n), rng.normal(size=n).round(1), rng.random(n), np.zeros(n)], axis=1)
    return x, 3 * (x[:, 0] > 0.3) + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.1


def table(spark, x, y):
    return spark.createDataFrame([(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "row long, target double, a double, b double, c double, d double, e double")


def plain(x, y, cuts, p):
    """Predictions of a booster that tries every cut of every node by adding up its rows."""
    told, rows = np.full(len(y), y.mean()), np.arange(len(y))
    for t in range(p.rounds):
        use, sample, g = boosting.chosen_columns(x.shape[1], t, p), boosting.chosen_rows(rows, t, p), told - y
        change = np.zeros(len(y))

        def grow(inside, depth, use=use, sample=sample, g=g, change=change):
            mine = inside & sample
            score = lambda m: g[m].sum() ** 2 / (m.sum() + p.ridge)
            best = (boosting.LEAST_GAIN, None, None)
            if depth < p.depth:
                for f in use:
                    for c in cuts[f]:
                        left = mine & (x[:, f] < c)
                        if left.sum() >= p.least_rows and mine.sum() - left.sum() >= p.least_rows:
                            gain = score(left) + score(mine & ~left) - score(mine)
                            if gain > best[0] + 1e-9:
                                best = (gain, f, c)
            if best[1] is None:
                change[inside] = -p.step * g[mine].sum() / (mine.sum() + p.ridge)
                return
            side = x[:, best[1]] < best[2]
            grow(inside & side, depth + 1)
            grow(inside & ~side, depth + 1)

        grow(np.ones(len(y), bool), 0)
        told = told + change
    return told


def test_booster_against_a_plain_one_in_a_task_and_in_jobs(spark):
    x, y = fixture()
    df, space = table(spark, x, y).repartition(3), Workspace(spark)
    one = boosting.fit(df, NAMES, SMALL, space)
    want = plain(x, y, one.cuts, SMALL)
    assert np.abs(one.predict(x) - want).max() < 1e-9
    assert ((y - want) ** 2).mean() < 0.2 * y.var()
    few = boosting.Parameters(rounds=3, depth=3, step=0.3, seed=3)
    jobs = boosting.fit(df, NAMES, few, space, rows_in_task=10)
    assert np.abs(jobs.predict(x) - plain(x, y, jobs.cuts, few)).max() < 1e-9
    assert {k for _, _, k, _, _ in jobs.nodes()} <= {*NAMES, None}
    space.drop()


def test_booster_on_odd_tables(spark):
    x, y = fixture(4)
    df, space = table(spark, x, y), Workspace(spark)
    for rows_in_task in (10, 1):
        assert boosting.fit(df, NAMES, boosting.Parameters(rounds=2, depth=2), space, rows_in_task).predict(x) == pytest.approx([y.mean()] * 4, abs=0.3)
        assert boosting.fit(df.where("row < 0"), NAMES, boosting.Parameters(rounds=2, depth=2), space, rows_in_task).predict(x).tolist() == [0.0] * 4


def test_recursion_equals_the_declarative_rules(spark):
    """Two steps over series with and without prices, and one that never sold."""
    kind = "store_id string, sku_id string, segment string, sku_code int, category_code int, subcategory_code int, target array<double>, price array<double>, events array<double>, snaps array<double>, actual array<double>, total double, days long, price_total double, price_days long, since int"
    up = [float(i) for i in range(5, 61)]
    rows = [
        ("s", "A", "fast", 0, 0, 0, up, [1.0] * 6 + [2.0], [0.0, 1.0], [1.0, 0.0], [1.0, 2.0], 1830.0, 60, 61.0, 60, 1),
        ("s", "B", "fast", 1, 0, 1, up[::-1], [3.0, 4.0], [0.0, 0.0], [0.0, 0.0], [1.0, 2.0], 1000.0, 57, 7.0, 2, 4),
        ("s", "C", "fast", 2, 1, 1, [0.0] * 56, [None] * 7, [1.0, 1.0], [0.0, 1.0], [0.0, 0.0], 0.0, 56, None, 0, None),
    ]
    fold = rolling_protocol(*queries.date_span(spark, SF)).development[0]
    s = spark.createDataFrame(rows, kind)
    batch = pa.Table.from_pandas(s.toPandas()).to_batches()[0]
    state = learned.Recursion(batch, fold)
    made = [10.0, 0.0, 0.0]
    for h in (1, 2):
        got = state.features(h)
        want = learned.step_features(s, fold, h).orderBy("sku_code").toPandas()
        for c in features.FEATURE_SETS["full"]:
            assert got[c] == pytest.approx(want[c].to_numpy(float), nan_ok=True), c
        s = learned.advance(s.withColumn("prediction", F.get(F.array(*map(F.lit, made)), F.col("sku_code"))))
        state.advance(np.array(made))


def test_trees_forecast_a_fold_of_the_tables(spark, tmp_path):
    p = rolling_protocol(*queries.date_span(spark, SF))
    demand = queries.panel.demand_daily(spark, SF).where("category = 'TYPE'")
    made = manifest.build(demand, "v", p.folds[-1].train_end, p.folds[0].train_end, queries._release())
    fold = p.development[0]
    out = learned.boosted_trees(demand, features.catalog(demand, made), fold, "calendar", rounds=20, depth=4, save_to=str(tmp_path / "m"))
    got = out.toPandas()
    assert len(got) == 28 * got.sku_id.nunique() and (got.prediction >= 0).all() and sorted(got.horizon.unique()) == list(range(1, 29))
    assert abs(got.prediction.mean() - got.actual.mean()) < 0.6 * got.actual.mean()
    assert spark.read.parquet(str(tmp_path / "m/nodes")).where("node = 0").count() == 20


def test_registered_query_covers_all_development_folds_with_defaults(spark, monkeypatch):
    calls = []

    def record(demand, catalog, fold, *args, **kw):
        calls.append((fold.fold_id, args, kw))
        return spark.createDataFrame([(fold.fold_id, 1.0)], "fold_id string, prediction double")

    monkeypatch.setattr(learned, "boosted_trees", record)
    got = queries.gbt_forecast(spark, SF)
    assert sorted(r[0] for r in got.select("fold_id").collect()) == ["development_1", "development_2", "development_3"]
    assert sorted(calls) == [(f"development_{k}", (), {}) for k in (1, 2, 3)]
