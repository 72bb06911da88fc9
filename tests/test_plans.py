"""Physical plans: where data moves and what reaches the scan."""

import datetime as dt
import re

from pyspark.sql import functions as F

from roadflow.catalog import QUERIES
from roadflow.operators import aggregates as A
from roadflow.operators import clean as K
from roadflow.operators import joins as J
from roadflow.operators import timeseries as T
from roadflow.plans import etl
from roadflow.schemas import KEYS, PROFILE_COLS, TRAFFIC_DEFAULTS
from roadflow.session import stage
from roadflow.sources import sample_feeds as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def observed(spark, small):
    t = etl.traffic_keys(S.traffic_feed(spark, small))
    return stage(etl.observed_table(t, etl.vehicle_keys(S.vehicle_feed(spark, small))), "observed")


def test_dense_rows_are_never_shuffled(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        obs = observed(spark, small)
        text = plan(etl.finish(etl.fill_grid(obs, etl.EtlOptions()), etl.weather_table(
            S.weather_feed(spark, small), T.time_grid(obs), etl.EtlOptions()), True))
        explode = [i for i, line in enumerate(text.splitlines()) if "Generate explode(sequence(_from" in line][0]
        lines = text.splitlines()
        depth = lambda s: len(re.match(r"^[\s:+\-|*()\d]*", s).group())
        path, level = [], depth(lines[explode])
        for line in reversed(lines[:explode]):
            if depth(line) < level:
                path.append(line)
                level = depth(line)
        assert not [x for x in path if "Exchange" in x], path
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def opened(df) -> tuple[list[str], list[str]]:
    """Operators above the explode into cells, and the columns that it copies to every cell."""
    lines = plan(df).splitlines()
    at = next((i for i, line in enumerate(lines) if "Generate explode(sequence(_from" in line), None)
    assert at is not None, "cells are not opened from segments"
    copied = re.search(r"\), \[(.*?)\], false", lines[at]).group(1)
    return lines[:at], [c.strip() for c in copied.split(",")]


def test_interp_windows_moves_no_cells(spark, small):
    """Windows, sorts, joins and exchanges see observed rows only."""
    above, _ = opened(QUERIES["interp_windows"](spark, small))
    assert above and not [line for line in above if re.search(r"Exchange|Window|Sort|Join|Aggregate", line)], above


def test_interp_limit_copies_a_field_a_group_to_each_cell(spark, small):
    _, copied = opened(QUERIES["interp_limit"](spark, small))
    assert len(copied) == 2 + 5, copied  # keys; one struct for each set of columns that are null together


def test_profiles_meet_segments_not_cells(spark):
    """The lookup of profiles lies below the explode into cells, and every cell has the profile of its own hour."""
    t0 = dt.datetime(1970, 1, 1) + dt.timedelta(minutes=105 * 270488)  # on both grids
    rows = [(t0 + dt.timedelta(minutes=m), "d", lane, *[float(m + i) for i in range(len(PROFILE_COLS))])
            for lane, stamps in ((1, (0, 630, 1890)), (2, (315, 1260))) for m in stamps]
    seen = stage(spark.createDataFrame(rows, "BucketTime timestamp_ntz, DeviceId string, Lane int, "
                                       + ", ".join(f"{c} double" for c in PROFILE_COLS)), "seen")
    for step in ("7 minutes", "105 minutes"):
        o = etl.EtlOptions(step=step, gap_limit=2)
        filled = etl.fill_grid(seen, o)
        text = filled._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(text) if "Generate explode(sequence(_from" in line)
        assert not [line for line in text[:at] if "Join" in line]
        line = T.densify(seen, PROFILE_COLS, step, 2, together=etl.NULL_TOGETHER)
        usual = J.attach_profiles(line, A.hourly_profile(seen), A.global_hourly_profile(seen))
        want = usual.select(*KEYS, *[
            F.coalesce(F.col(c), F.col("_own")[c], F.col("_all")[c], F.lit(TRAFFIC_DEFAULTS[c])).alias(c) for c in PROFILE_COLS])
        got = filled.select(want.columns)
        assert got.count() == line.count() > 30
        assert got.exceptAll(want).count() == 0


def test_dedup_and_counts_combine_before_the_shuffle(spark, small):
    text = plan(etl.traffic_keys(S.traffic_feed(spark, small)))
    assert text.count("partial_min") >= 1 and text.count("partial_avg") >= 1


def test_filter_and_columns_reach_the_scan(spark, small):
    path = etl.stage(S.traffic_feed(spark, small), "feed")
    clean = K.clean_traffic(path).select("DeviceId", "AvgSpeed")
    text = plan(clean)
    assert "IntervalType" in re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "FlowRate" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_conservation(spark, small):
    obs = observed(spark, small)
    out = etl.fill_grid(obs, etl.EtlOptions()).groupBy("fill_source").count().collect()
    devices, lanes = obs.select("DeviceId").distinct().count(), obs.select("Lane").distinct().count()
    steps = T.time_grid(obs).count()
    assert sum(r["count"] for r in out) == devices * lanes * steps
    assert dict(out)["observed"] == obs.count()


def test_whole_job_properties(spark, small):
    o = etl.EtlOptions(step="1 hour")
    feeds = tuple(f(spark, small, "1 hour") for f in (S.traffic_feed, S.vehicle_feed, S.weather_feed))
    a = stage(etl.build(*feeds, o).processed, "a")
    b = etl.build(*[f.orderBy(F.rand(3)) for f in feeds], o).processed
    again = etl.build(feeds[0].unionByName(feeds[0]), feeds[1].unionByName(feeds[1]), feeds[2], o).processed
    pick = lambda df: df.select(*KEYS, "NumVehicles", "CarCount", "BusCount", F.round("AvgSpeed", 6).alias("s"))
    for other in (b, again):
        assert pick(a).exceptAll(pick(other)).count() == 0
    assert a.filter(" OR ".join(f"{c} IS NULL" for c in PROFILE_COLS)).count() == 0
    total = F.col("CarCount") + F.col("TruckCount") + F.col("BusCount") + F.col("MotorcycleCount") + F.col("OtherVehicleCount")
    assert a.filter(total != F.col("NumVehicles")).count() == 0


def test_align_keeps_off_grid_minutes(spark, small):
    feed = S.traffic_feed(spark, small, "1 minute")
    absent = [F.lit(None).cast("double").alias(c) for c in PROFILE_COLS[6:]]

    def kept(o):
        seen = etl.traffic_keys(feed, o).fillna(0.0).select("*", *absent)
        return etl.fill_grid(seen, o).filter("fill_source = 'observed'").count()

    assert kept(etl.EtlOptions(align="5 minutes")) > kept(etl.EtlOptions())


def test_join_counts_come_with_the_observed_table(spark, small):
    from roadflow.operators.validate import key_overlap

    run = etl.build(S.traffic_feed(spark, small), S.vehicle_feed(spark, small), S.weather_feed(spark, small))
    keys = key_overlap(run.traffic, run.vehicle).first()
    assert run.join_counts["rows"] == keys["traffic_keys"] == run.observed.count()
    assert run.join_counts["both"] == keys["matched_keys"] > 0
    assert run.join_counts["left_only"] == keys["traffic_keys"] - keys["matched_keys"]


def test_every_observed_node_is_answered(spark):
    from datetime import datetime

    from roadflow.plans import documents as Doc

    at = lambda h: datetime(2024, 1, 1, h)
    measures = ["NumVehicles", "AvgSpeed", "Occupancy", "AvgDensity", "AvgHeadway", "FlowRate", "MeanConfidence"]
    latest = spark.createDataFrame([("A", at(8), *[1.0] * 7), ("B", at(8), *[2.0] * 7)], ["DeviceId", "BucketTime", *measures])
    asked = spark.createDataFrame(
        [("a", at(9), 30.5, 0.875), ("b", None, None, None), ("x", None, 7.0, None)], "DeviceId string, ObservationTime timestamp, AvgSpeed double, Confidence double")
    seen = Doc.resolve_observations(asked, latest, measures, "1 hour")
    known = {r["DeviceId"]: (r["Known"], r["BucketTime"], r["MeanConfidence"]) for r in seen.collect()}
    assert known == {"A": (True, at(9), 0.875), "B": (True, at(9), 2.0), "X": (False, None, 0.0)}
    ahead = spark.createDataFrame([("A", 1, at(10), 3.456), ("A", 2, at(11), 4.0)], "DeviceId string, step int, BucketTime timestamp, predicted double")
    actual = spark.createDataFrame([("A", at(11), *[5.0] * 7)], latest.schema)
    scores = spark.createDataFrame([("A", 1.234, 2.0, 3.0, 0.98765)], "DeviceId string, MAE double, RMSE double, MAPE double, R2 double")
    rows = Doc.node_forecast(ahead, actual, seen, "AvgSpeed", scores).orderBy("DeviceId", "step").collect()
    assert [(r["DeviceId"], r["Status"], r["step"]) for r in rows] == [("A", "ok", 1), ("A", "ok", 2), ("B", "no model", None), ("X", "unknown device", None)]
    assert (rows[0]["AvgSpeed"], rows[0]["Confidence"], rows[1]["Confidence"], rows[1]["NumVehicles"]) == (3.46, 0.88, 5.0, 5.0)
    assert rows[0]["Metrics"].asDict() == {"Mae": 1.23, "Rmse": 2.0, "Mape": 3.0, "R2": 0.988}
    assert rows[2]["AvgSpeed"] is None and rows[2]["Metrics"]["Mae"] == 0.0
    plain = Doc.node_forecast(ahead, actual, seen, "AvgSpeed").collect()
    assert len(plain) == 4 and {r["Metrics"]["R2"] for r in plain} == {0.0}
