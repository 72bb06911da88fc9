"""Streams drained to the end agree with the batch jobs."""

import pytest
from pyspark.sql import functions as F

from roadflow.catalog import inputs as I
from roadflow.catalog import streams as Q
from roadflow.models import fit as M
from roadflow.models import forecast as P
from roadflow.operators import clean as K
from roadflow.operators import timeseries as T
from roadflow.plans.features import model_features
from roadflow.session import scratch_path
from roadflow.sources import sample_feeds as S
from roadflow.streaming import ticks as R


def test_resample_equals_batch_on_closed_windows(spark, small):
    from roadflow.catalog import QUERIES

    stream = QUERIES["stream_resample"](spark, small).filter("NumVehicles IS NOT NULL").cache()
    feed = K.clean_traffic(S.traffic_feed(spark, small, "1 minute"))
    batch = T.resample_mean(feed, ["NumVehicles", "AvgSpeed"], ["DeviceId", "Lane"]).filter("NumVehicles IS NOT NULL")
    key = ["DeviceId", "Lane", "BucketTime"]
    both = stream.join(batch.select(*key, F.col("NumVehicles").alias("n")), key)
    assert stream.count() == both.count() > 0
    assert both.filter(F.abs(F.col("NumVehicles") - F.col("n")) > 1e-9).count() == 0
    last = stream.agg(F.max("BucketTime")).first()[0]
    closed = batch.filter(F.col("BucketTime") <= F.lit(last)).count()
    assert stream.count() == closed


def test_repeated_ids_are_dropped(spark):
    path = scratch_path(spark, "repeated")
    rows = [("1", "2024-01-01 00:01:00", 4.0), ("1", "2024-01-01 00:01:00", 4.0), ("2", "2024-01-01 00:02:00", 8.0),
            ("3", "2024-01-01 09:00:00", 1.0)]
    spark.createDataFrame(rows, "Id string, ts string, x double").selectExpr(
        "Id", "'d' DeviceId", "1 Lane", "cast(ts AS timestamp_ntz) ts", "x"
    ).write.parquet(path)
    stream = R.tick_stream(spark, path, spark.read.parquet(path).schema)
    out = R.run_to_table(R.resample_stream(stream, ["x"]), "once").collect()
    assert [r["x"] for r in out] == [6.0]


@pytest.fixture(scope="module")
def extended(spark, small):
    stream = Q._forecast_stream(spark, small, order=(2, 0, 0))
    return R.run_to_table(stream, "extended").cache()


def test_extension_equals_batch_residuals(spark, small, extended):
    rows = M.training_rows(model_features(I.series(spark, small), "NumVehicles"))
    models, full = M.fit_models(rows, "NumVehicles", order=(2, 0, 0), window=(13, M.EVERYTHING), name="train")
    batch = P.fitted_values(full, models, "NumVehicles").filter("rn <= 12")
    both = extended.join(batch.select("DeviceId", "BucketTime", F.col("residual").alias("r")), ["DeviceId", "BucketTime"])
    assert both.count() == extended.count() == 24
    assert both.filter(F.abs(F.col("residual") - F.col("r")) > 1e-8).count() == 0


def test_history_slides_and_forecasts_are_clipped(extended):
    for r in extended.collect():
        assert len(r["history"]) == 24 and len(r["forecast"]) == 24
        assert r["history"][-1]["time"] == r["BucketTime"].strftime("%Y-%m-%d %H:%M")
        assert [h["time"] for h in r["history"]] == sorted(h["time"] for h in r["history"])
        assert min(r["forecast"]) >= 0.0


def test_ticks_count_per_device(extended):
    got = extended.groupBy("DeviceId").agg(F.max("tick"), F.count("*")).collect()
    assert all(r[1] == r[2] == 12 for r in got)


def _base(spark, path, stamps):
    """Ticks of a device whose next value is its last one: (stamp, value) rows as one more file."""
    rows = [("d", s, v, [0.0] * 25, [1.0] + [0.0] * 25, [0.0, 0.0], 1.0, [5.0] * 26, [0.0, 0.0]) for s, v in stamps]
    spark.createDataFrame(
        rows, "DeviceId string, t string, y double, xb array<double>, w array<double>, theta array<double>, "
        "sigma2 double, seed_y array<double>, seed_e array<double>",
    ).selectExpr("DeviceId", "cast(t AS timestamp_ntz) BucketTime", "* EXCEPT (DeviceId, t)").coalesce(1).write.mode("append").parquet(path)


def test_late_repeated_and_skipped_ticks(spark):
    path = scratch_path(spark, "odd-ticks")
    day = "2024-01-01 "
    _base(spark, path, [(day + "00:05:00", 7.0), (day + "00:10:00", 10.0)])
    _base(spark, path, [(day + "00:00:00", 50.0), (day + "00:10:00", 10.0), (day + "00:10:00", 99.0)])
    _base(spark, path, [(day + "00:25:00", 20.0)])
    stream = R.tick_stream(spark, path, spark.read.parquet(path).schema, 1)
    out = R.run_to_table(R.extend_and_forecast(stream), "odd").orderBy("tick").collect()
    assert [(r["tick"], r["BucketTime"].minute, r["residual"], r["forecast"][0]) for r in out] == [
        (1, 5, 2.0, 7.0), (2, 10, 3.0, 10.0), (3, 25, 10.0, 20.0)]
    assert [h["time"][-5:] for h in out[-1]["history"][-3:]] == ["00:05", "00:10", "00:25"]


DOCS = "DeviceId string, BucketTime timestamp_ntz, x double"


def _ticks(spark, path, *files):
    """A file of (device, value) ticks per part; the stamp is 2024 plus as many hours as the value."""
    for part in files:
        spark.createDataFrame(part, "DeviceId string, x double").selectExpr(
            "DeviceId", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(x AS int)) BucketTime", "x"
        ).coalesce(1).write.mode("append").parquet(path)


def _folders(path):
    import glob
    import os

    return {os.path.basename(p) for p in glob.glob(f"{path.removeprefix('file:')}/*")}


def test_silent_device_keeps_its_document(spark):
    path, out = scratch_path(spark, "docs-in"), scratch_path(spark, "docs")
    _ticks(spark, path, [("a", 1.0), ("b", 2.0)], [("a", 3.0)])
    stream = R.tick_stream(spark, path, DOCS, 1)
    assert R.read_documents(spark, out, stream.schema).collect() == []
    R.latest_documents(stream, out)
    docs = R.read_documents(spark, out, stream.schema).collect()
    assert {(r["DeviceId"], r["x"], r["batch"]) for r in docs} == {("a", 3.0, 1), ("b", 2.0, 0)}


def test_document_sets_do_not_pile_up_and_streams_go_on(spark):
    path, out, marks = (scratch_path(spark, n) for n in ("docs-in", "docs", "docs-marks"))
    _ticks(spark, path, *[[("a", float(k)), (f"d{k}", float(k))] for k in range(7)])
    stream = R.tick_stream(spark, path, DOCS, 1)
    R.latest_documents(stream, out, marks, keep=3)
    assert _folders(out) == {"manifest", "set=0", "set=1", "set=2"}
    assert sorted(r["version"] for r in R.manifest(spark, out).collect()) == [4, 5, 6]

    def read():
        return {(r["DeviceId"], r["x"]) for r in R.read_documents(spark, out, stream.schema).collect()}

    assert read() == {("a", 6.0)} | {(f"d{k}", float(k)) for k in range(7)}
    # From its checkpoint a stream reads new files only.
    _ticks(spark, path, [("a", 9.0)])
    R.latest_documents(stream, out, marks, keep=3)
    last = R.manifest(spark, out).orderBy("version").tail(1)[0]
    assert (last["version"], last["batch"], last["documents"]) == (7, 7, 8) and ("a", 9.0) in read()
    # A stream that starts anew meets the documents that are there; old ticks do not win over them.
    other = scratch_path(spark, "docs-in")
    _ticks(spark, other, [("a", 2.0), ("late", 1.0)])
    R.latest_documents(R.tick_stream(spark, other, DOCS, 1), out, keep=3)
    assert read() == {("a", 9.0), ("late", 1.0)} | {(f"d{k}", float(k)) for k in range(7)}


def test_a_set_without_its_manifest_line_is_not_read(spark):
    path, out = scratch_path(spark, "docs-in"), scratch_path(spark, "docs")
    _ticks(spark, path, [("a", 1.0)], [("a", 2.0)])
    stream = R.tick_stream(spark, path, DOCS, 1)
    R.latest_documents(stream, out)
    # What a writer that died in the third batch leaves behind.
    spark.createDataFrame([("broken",)], "DeviceId string").write.json(f"{out}/set=2")
    assert [(r["DeviceId"], r["x"]) for r in R.read_documents(spark, out, stream.schema).collect()] == [("a", 2.0)]
    with pytest.raises(ValueError, match="two document sets"):
        R.latest_documents(stream, out, keep=1)


def test_replay_has_few_batches_and_devices_in_order(spark):
    ticks = spark.range(600).selectExpr("'d' || (id DIV 12) DeviceId", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 12 - cast(id % 12 AS INT)) BucketTime",
                                        "cast(id % 12 + 1 AS INT) rn").repartition(16)
    path, coalesce = scratch_path(spark, "replay"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        files = R.write_replay(ticks, path, 12, 3)
    finally:
        spark.conf.set(coalesce, "true")
    written = spark.read.parquet(path)
    assert written.count() == 600 and len(written.inputFiles()) <= 3 * files
    # Each device has its four ticks of a part in one file.
    assert written.groupBy("DeviceId", F.input_file_name()).count().filter("count <> 4").count() == 0
    seen = []
    R.tick_stream(spark, path, written.schema, files).writeStream.foreachBatch(lambda b, i: seen.append(b.count())).option(
        "checkpointLocation", scratch_path(spark, "replay-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(seen) == 600
