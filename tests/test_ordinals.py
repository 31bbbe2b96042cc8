"""Numbering and quantiles over many partitions, against sorted lists."""

from __future__ import annotations

import random

import pytest

from demandloom.operators import features, ordinals
from demandloom.operators.workspace import Workspace
from demandloom.plans import queries

SF = "/root/testdata/sf0.001"


def test_numbers_and_codes_against_sorted_lists(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(10**6):06d}", rng.choice([None, "b", "a", "c"])) for _ in range(700)]
    df, space = spark.createDataFrame(rows, "k string, c string").repartition(7), Workspace(spark)
    got = ordinals.coded(ordinals.numbered(df, ["k", "c"], "at", space), "c", "code", space).collect()
    assert sorted(r["at"] for r in got) == list(range(700))
    assert [r["k"] for r in sorted(got, key=lambda r: r["at"])] == sorted(k for k, _ in rows)
    assert {(r["c"], r["code"]) for r in got} == {(None, 0), ("a", 1), ("b", 2), ("c", 3)}
    assert ordinals.numbered(df.where("k < 'a'"), ["k"], "at", space).count() == 0


def test_numbers_do_not_follow_the_number_of_partitions(spark):
    df, space = spark.range(500).selectExpr("hash(id) AS k"), Workspace(spark)
    made = ordinals.numbered(df, ["k"], "at", space)
    first = sorted(map(tuple, made.collect()))
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        assert sorted(map(tuple, made.collect())) == first
    finally:
        spark.conf.set("spark.sql.files.minPartitionNum", before) if before else spark.conf.unset("spark.sql.files.minPartitionNum")


@pytest.mark.parametrize("kind", ["distinct", "tied", "heavy", "one"])
def test_quantiles_against_sorted_values(spark, kind, monkeypatch):
    rng = random.Random(5)
    make = {"distinct": lambda: rng.gauss(0, 1), "tied": lambda: float(rng.randrange(4)), "heavy": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300), "one": lambda: 2.5}[kind]
    values = [make() for _ in range(3000)]
    monkeypatch.setattr(ordinals, "ACCURACY", 20)  # a coarse sketch needs many brackets
    df, space = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3), Workspace(spark)
    for q in (0.0, 0.3, 0.5, 0.999, 1.0):
        assert ordinals.nearest_quantile(df, "v", q, space) == sorted(values)[int(q * 2999 + 0.5)]
    assert ordinals.nearest_quantile(df.where("v IS NULL"), "v", 0.5, space) is None


def test_series_catalog_sorts_nothing_in_one_task(spark):
    plan = queries.series_catalog(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    assert features.catalog.__doc__
