"""Files as other programs meet them: byte order marks, audit tables, documents."""

import glob
import json

from pyspark.sql import functions as F

from roadflow.schemas import KEYS, TRAFFIC_METRICS
from roadflow.session import scratch_path
from roadflow.sources import configs, feeds, sinks


def local(path):
    return path.removeprefix("file:")


def test_marked_files_begin_with_the_mark_and_read_back(spark):
    path = scratch_path(spark, "marked")
    df = spark.createDataFrame([("a", "é"), ("b", None)], "Id string, v string")
    sinks.write_csv(df.repartition(2), path, mark=True)
    files = [open(f, "rb").read() for f in glob.glob(f"{local(path)}/*.csv")]
    assert files and all(f.startswith(b"\xef\xbb\xbfId,v\n") for f in files)
    assert {tuple(r) for r in feeds.read_csv(spark, path, df.schema).collect()} == {("a", "é"), ("b", None)}


def test_audits(spark):
    stamp = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day)").alias("BucketTime")
    keys = [stamp, "DeviceId", F.lit(1).alias("Lane")]
    traffic = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "day int, DeviceId string").select(
        *keys, *[F.lit(2.0).alias(c) for c in TRAFFIC_METRICS])
    vehicle = spark.createDataFrame([(0, "a"), (5, "z")], "day int, DeviceId string").select(*keys, F.lit(3).alias("CarCount"))
    path = scratch_path(spark, "audits")
    sinks.write_audits(traffic, vehicle, path)
    lone = spark.read.option("header", True).csv(f"{path}/unmatched")
    assert [c.lstrip("﻿") for c in lone.columns] == [*KEYS, *TRAFFIC_METRICS, "VehicleDataMissing"]
    assert sorted(r["DeviceId"] for r in lone.collect()) == ["a", "b"]
    daily = spark.read.option("header", True).csv(f"{path}/daily").collect()
    assert sorted((r[0], r["TrafficWithoutVehicle"], r["TrafficWithVehicle"], r["MatchedPercent"]) for r in daily) == [
        ("2024-01-01", "1", "1", "50.0"), ("2024-01-02", "1", "0", "0.0")]


def test_class_map_names_the_codes_it_met(spark):
    path = scratch_path(spark, "class-map")
    seen = spark.createDataFrame([(3.0,), (8.0,), (4.0,), (8.0,), (None,)], "VehicleClass double")
    sinks.write_json(sinks.class_map(seen), path)
    (doc,) = [json.loads(line) for f in glob.glob(f"{local(path)}/*.json") for line in open(f)]
    assert doc["OtherVehicleClassCodesObserved"] == [4, 8]
    assert doc["VehicleClassToCategory"] == {"2": "Motorcycle", "3": "Car", "6": "Truck", "7": "Bus"}
    none = sinks.class_map(seen.limit(0)).collect()
    assert len(none) == 1 and none[0]["OtherVehicleClassCodesObserved"] == []


def test_coefficients_are_nested_not_text(spark):
    rows = [("d", "NumVehicles", "const", 1.0, 0.5), ("d", "NumVehicles", "ar.L1", 0.25, None), ("d", "AvgSpeed", "const", 2.0, 0.1)]
    report = configs.coefficient_report(spark.createDataFrame(rows, "DeviceId string, TargetCol string, name string, coef double, pvalue double"))
    path = scratch_path(spark, "coefs")
    sinks.write_json(report, path)
    (doc,) = [json.loads(line) for f in glob.glob(f"{local(path)}/*.json") for line in open(f)]
    assert list(doc["targets"]) == ["AvgSpeed", "NumVehicles"]
    assert doc["targets"]["NumVehicles"]["const"] == {"coef": 1.0, "pvalue": 0.5}
    assert doc["targets"]["NumVehicles"]["ar.L1"]["coef"] == 0.25


def test_stored_metrics_are_served(spark):
    from roadflow.models import store
    from roadflow.operators.joins import metrics_lookup

    folder = scratch_path(spark, "results")
    rows = [(1, "a", "NumVehicles", 4.0, 0.5), (2, "a", "NumVehicles", 9.0, 0.1), (3, "b", "AvgSpeed", 1.0, 0.9)]
    schema = "row long, DeviceId string, TargetCol string, MAE double, R2 double"
    store.save(spark.createDataFrame(rows[2:], schema), folder, "metrics")
    store.save(spark.createDataFrame(rows, schema), folder, "metrics")
    devices = spark.createDataFrame([("a",), ("b",)], "DeviceId string")
    served = metrics_lookup(devices, store.read(spark, folder, "metrics"), "NumVehicles", {"MAE": 50.0, "R2": 0.1})
    assert sorted(map(tuple, served.collect())) == [("a", 4.0, 0.5), ("b", 50.0, 0.1)]
    assert store.versions(spark, folder, "metrics").count() == 2
