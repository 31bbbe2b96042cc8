"""Reports, checksums and whole runs on file systems that only Spark reads."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from demandloom import artifacts
from demandloom.operators import publish
from demandloom.sources import files, retail_csv


@pytest.fixture()
def remote(spark, tmp_path):
    """A folder by a path that open() doesn't know."""
    (tmp_path / "far").mkdir()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{tmp_path.name.lower().replace('_', '-')}.link./far", f"file://{tmp_path}/far")
    return f"viewfs://{tmp_path.name.lower().replace('_', '-')}/far"


def test_texts_and_checksums_on_any_file_system(spark, remote, tmp_path):
    for root in (remote, f"file://{tmp_path}/near", str(tmp_path / "plain")):
        path = f"{root}/a/report.json"
        assert not files.exists(path)
        artifacts.write_json({"é": [1, None]}, path)
        artifacts.write_json({"é": [2, None]}, path)
        assert artifacts.read_json(path) == {"é": [2, None]} and files.exists(path)
        want = (files.size(path), hashlib.sha256(files.read_text(path).encode()).hexdigest())
        files.write_text("", f"{root}/a/empty")
        told = files.checksums([path, f"{root}/a/empty"])
        assert told == {path: want, f"{root}/a/empty": (0, hashlib.sha256(b"").hexdigest())}
        assert files.checksums([path], in_task=0) == {path: want}
        assert artifacts.source_manifest({"x": path})["files"]["x"] == {"path": path, "bytes": want[0], "sha256": want[1]}
    assert (tmp_path / "far/a/report.json").read_bytes() == (tmp_path / "plain/a/report.json").read_bytes()


def test_sources_are_found_on_any_file_system(spark, remote):
    with pytest.raises(FileNotFoundError, match="sales_train_evaluation.csv or sales_train_validation.csv, calendar.csv, sell_prices.csv"):
        retail_csv.discover(remote)
    for name in ("sales_train_validation.csv", "calendar.csv", "sell_prices.csv"):
        files.write_text("a,d_2,d_1\n", f"{remote}/{name}")
    assert retail_csv.discover(remote + "/")["sales"] == f"{remote}/sales_train_validation.csv"
    files.write_text("a,d_2,d_10\n", f"{remote}/sales_train_evaluation.csv")
    assert retail_csv.header(spark, retail_csv.discover(remote)["sales"]) == ["a", "d_2", "d_10"]


def run(spark, value, fail=False):
    def make(at):
        artifacts.write_table(spark.range(3).withColumn("v", F.lit(value)), f"{at}/t")
        if fail:
            raise RuntimeError("killed")
        artifacts.write_json({"v": value}, f"{at}/result.json")
        return value

    return make


def test_a_run_is_published_whole_or_not_at_all(spark, remote):
    out = f"{remote}/run"
    with pytest.raises(ValueError, match="no complete run"):
        publish.readable(out)
    value = lambda: artifacts.read_json(f"{publish.readable(out)}/result.json")["v"]
    assert publish.publish(spark, out, run(spark, 1), ["t"], ["result.json"]) == 1 and value() == 1
    with pytest.raises(RuntimeError, match="killed"):
        publish.publish(spark, out, run(spark, 2, fail=True), ["t"], ["result.json"])
    assert value() == 1 and publish.verify(spark, out)
    with pytest.raises(Exception, match="missing|not.*exist|PATH_NOT_FOUND"):
        publish.publish(spark, out, run(spark, 3), ["t", "other"], ["result.json"])
    assert value() == 1
    assert publish.publish(spark, out, run(spark, 4), ["t"], ["result.json"]) == 4 and value() == 4
    # The driver dies between the two moves: the old run is found aside, and the next run takes over.
    files.move(out, publish.previous(out))
    assert value() == 4
    artifacts.write_json({"v": 9}, f"{out}/result.json")
    assert value() == 4
    assert publish.publish(spark, out, run(spark, 5), ["t"], ["result.json"]) == 5 and value() == 5
    assert not files.exists(publish.previous(out))
    artifacts.write_json({"v": 6}, f"{out}/result.json")
    with pytest.raises(ValueError, match="has changed"):
        publish.verify(spark, out)
    assert json.loads(files.read_text(f"{out}/{publish.MANIFEST}"))["tables"].keys() == {"t"}
