"""Order configuration: documents, versions, merging and what a search writes back."""

import json

import pytest

from roadflow.models import evaluate as E
from roadflow.session import scratch_path
from roadflow.sources import configs

DOC = {
    "default": {"NumVehicles_order": [1, 0, 1], "NumVehicles_train_length": 800, "note": "all"},
    "devices": {"a": {"NumVehicles_order": [2, 1, 0], "NumVehicles_seasonal_order": [1, 0, 1, 60]}, "b": {}, "c": {"note": "own"}},
}


def rows(df):
    return {r["DeviceId"]: r["settings"] for r in df.collect()}


def test_one_nested_document(spark, tmp_path):
    (tmp_path / "orders.json").write_text(json.dumps(DOC, indent=2))
    config = configs.read_documents(spark, str(tmp_path), lines=False)
    assert {k: json.loads(v) for k, v in rows(config)["a"].items()} == DOC["devices"]["a"]
    devices = spark.createDataFrame([("a",), ("b",), ("c",), ("new",)], "DeviceId string")
    merged = configs.effective(devices, config)
    assert rows(merged)["c"]["note"] == "own" and rows(merged)["new"]["note"] == "all"
    got = {r[0]: tuple(r)[1:] for r in configs.orders(merged, "NumVehicles").collect()}
    assert got["a"] == (2, 1, 0, 1, 0, 1, 60, 800)
    assert got["b"] == got["c"] == got["new"] == (1, 0, 1, 0, 0, 0, 0, 800)
    assert configs.orders(merged, "AvgSpeed").count() == 0


def test_versions_replace_each_other_and_keep_what_is_not_changed(spark):
    folder = scratch_path(spark, "config")
    assert configs.load(spark, folder).collect() == []
    first = spark.createDataFrame([(None, {"x": "1"}), ("a", {"x": "2", "y": "3"}), ("b", {"x": "4"})], configs.CONFIG)
    old = configs.save(first, folder)
    change = spark.createDataFrame([("a", {"y": "[5, 0, 1]"}), ("z", {"x": "6"}), (None, {"w": "7"})], configs.CONFIG)
    configs.save(configs.put(configs.load(spark, folder), change), folder)
    assert rows(configs.load(spark, folder)) == {
        None: {"x": "1", "w": "7"}, "a": {"x": "2", "y": "[5, 0, 1]"}, "b": {"x": "4"}, "z": {"x": "6"}}
    assert rows(configs.load(spark, folder, version=old)) == rows(first)


def test_a_device_twice_ends_the_job(spark):
    twice = spark.createDataFrame([("a", {"x": "1"}), ("a", {"x": "2"})], configs.CONFIG)
    with pytest.raises(Exception, match="more than once"):
        configs.save(twice, scratch_path(spark, "config"))
    defaults = spark.createDataFrame([(None, {"x": "1"}), (None, {"x": "2"})], configs.CONFIG)
    with pytest.raises(Exception, match="more than once"):
        configs.save(defaults, scratch_path(spark, "config"))


def test_empty_configuration(spark):
    none = spark.createDataFrame([], configs.CONFIG)
    devices = spark.createDataFrame([("a",)], "DeviceId string")
    assert rows(configs.effective(devices, none)) == {"a": {}}
    change = spark.createDataFrame([("a", {"x": "1"})], configs.CONFIG)
    assert rows(configs.put(none, change)) == {"a": {"x": "1"}}


def test_search_outcomes_become_manual_orders(spark):
    best = spark.createDataFrame(
        [("a", "NumVehicles", "cfg2", 2, 1, 0, 1, 0, 1, 60, 3.0, 0.75, True), ("b", "NumVehicles", "cfg1", 1, None, 1, 0, 0, 0, 0, 99.0, -0.5, False),
         ("a", "AvgSpeed", "cfg1", 5, 0, 0, 0, 0, 0, 0, 1.0, 0.9, True)],
        "DeviceId string, TargetCol string, window string, p int, d int, q int, sp int, sd int, sq int, s int, MAE double, R2 double, success boolean")
    found = configs.outcomes(best, "NumVehicles", {"cfg1": (500, 12), "cfg2": (800, 12)})
    assert rows(found) == {
        "a": {"NumVehicles_order": "[2, 1, 0]", "NumVehicles_seasonal_order": "[1, 0, 1, 60]", "NumVehicles_train_length": "800",
              "NumVehicles_val_length": "12", "_NumVehicles_source": "cfg2"},
        "b": {"NumVehicles_order": "[1, 0, 1]", "NumVehicles_seasonal_order": "[0, 0, 0, 0]",
              "_NumVehicles_source": "best_of_cfg1", "_NumVehicles_notes": "Best effort - MAE=99.00, R2=-0.5000"}}
    auto = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 0, 0), ("c", 4, 0, 1)], "DeviceId string, p int, d int, q int")
    picked = E.order_source(auto.select("DeviceId"), configs.orders(found, "NumVehicles"), None, auto).orderBy("DeviceId").collect()
    assert [(r["p"], r["d"], r["sq"], r["s"], r["ConfigSource"]) for r in picked] == [
        (2, 1, 1, 60, "manual"), (1, 0, 0, 0, "manual"), (4, 0, None, None, "auto")]
