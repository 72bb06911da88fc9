"""Queries of the join, key-set and union operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import timeseries as T
from ..operators import validate as V
from ..operators.sampling import first_devices
from ..schemas import KEYS, PROFILE_COLS, SERIES, TRAFFIC_DEFAULTS, TRAFFIC_METRICS, WEATHER_COLS
from ..sources import sample_feeds as S
from . import inputs as I
from .registry import query, rounded
from .sqltext import each, sql

H = I.HOUR_S
K3 = "BucketTime, DeviceId, Lane"


@query(
    "traffic_left_vehicle",
    sql(f"""SELECT {K3}, round(NumVehicles, 8) AS NumVehicles, round(MedianSpeed, 8) AS MedianSpeed, CarCount,
        CASE WHEN VehicleRows IS NULL THEN 'left_only' ELSE 'both' END AS match
        FROM traffic_agg LEFT JOIN vehicle_feat USING ({K3})""", "traffic_agg", "vehicle_feat"),
)
def traffic_left_vehicle(spark, d):
    joined = J.with_match(I.traffic_agg(spark, d, I.FIVE), I.vehicle_feat(spark, d, I.FIVE), relation="one_to_one")
    return rounded(joined.select(*KEYS, "NumVehicles", "MedianSpeed", "CarCount", "match"))


@query(
    "unmatched_traffic",
    sql(f"SELECT {K3}, " + each(TRAFFIC_METRICS, "round({c}, 8) AS {c}") + ", TRUE AS VehicleDataMissing "
        f"FROM traffic_obs ANTI JOIN vehicle_feat USING ({K3})", "traffic_obs", "vehicle_feat"),
)
def unmatched_traffic(spark, d):
    return rounded(J.unmatched(I.traffic_obs(spark, d, I.FIVE), I.vehicle_feat(spark, d, I.FIVE)))


@query(
    "matched_keys",
    sql(f"""SELECT *, round(matched_keys / traffic_keys * 100, 2) AS matched_percent FROM (SELECT
        (SELECT count(*) FROM traffic_agg) AS traffic_keys, (SELECT count(*) FROM vehicle_stats) AS vehicle_keys,
        (SELECT count(*) FROM (SELECT {K3} FROM traffic_agg INTERSECT SELECT {K3} FROM vehicle_stats)) AS matched_keys)""",
        "traffic_agg", "vehicle_stats"),
)
def matched_keys(spark, d):
    keys = I.vehicle_clean(spark, d, I.FIVE).select(*KEYS).distinct()
    return V.key_overlap(I.traffic_agg(spark, d, I.FIVE), keys)


@query(
    "matched_traffic",
    sql(f"SELECT {K3}, TrafficRowsInKey FROM traffic_agg SEMI JOIN vehicle_stats USING ({K3})",
        "traffic_agg", "vehicle_stats"),
)
def matched_traffic(spark, d):
    left = I.traffic_agg(spark, d, I.FIVE).select(*KEYS, "TrafficRowsInKey")
    return J.matched(left, I.vehicle_clean(spark, d, I.FIVE).select(*KEYS).distinct())


@query("dense_grid", sql("SELECT DeviceId, Lane, BucketTime FROM grid", "grid"))
def dense_grid(spark, d):
    return T.dense_grid(I.traffic_agg(spark, d, I.FIVE).select(*KEYS))


@query(
    "dense_grid_observed_pairs",
    sql("SELECT DeviceId, Lane, BucketTime FROM (SELECT DISTINCT DeviceId, Lane FROM observed) p, stamps",
        "stamps", grain=H),
)
def dense_grid_observed_pairs(spark, d):
    return T.dense_grid(I.traffic_agg(spark, d).select(*KEYS), I.HOUR, observed_pairs_only=True)


@query(
    "profile_lookup",
    sql("SELECT g.DeviceId, g.Lane, g.BucketTime, " + each(PROFILE_COLS, "round(p.{c}, 9) AS {c}")
        + " FROM grid g LEFT JOIN prof p ON p.DeviceId=g.DeviceId AND p.Lane=g.Lane AND p.Hour=hour(g.BucketTime)",
        "grid", "prof", grain=H),
)
def profile_lookup(spark, d):
    obs = I.observed(spark, d)
    grid = T.dense_grid(obs, I.HOUR).withColumn("Hour", F.hour("BucketTime"))
    return rounded(grid.join(A.hourly_profile(obs), SERIES + ["Hour"], "left").drop("Hour"), places=9)


@query(
    "profile_fallback",
    sql("SELECT g.DeviceId, g.Lane, g.BucketTime, "
        + ", ".join(f"round(coalesce(p.{c}, q.{c}, {TRAFFIC_DEFAULTS[c]}), 9) AS {c}" for c in PROFILE_COLS)
        + " FROM grid g LEFT JOIN prof p ON p.DeviceId=g.DeviceId AND p.Lane=g.Lane AND p.Hour=hour(g.BucketTime)"
        " LEFT JOIN gprof q ON q.Hour=hour(g.BucketTime)", "grid", "prof", "gprof", grain=H),
)
def profile_fallback(spark, d):
    obs = I.observed(spark, d)
    grid = T.dense_grid(obs, I.HOUR)
    return rounded(J.profile_lookup(
        grid, A.hourly_profile(obs), A.global_hourly_profile(obs), TRAFFIC_DEFAULTS
    ), places=9)


@query(
    "grid_left_observed",
    sql("SELECT DeviceId, Lane, BucketTime, " + each(PROFILE_COLS, "round({c}, 8) AS {c}") + " FROM cells",
        "cells", grain=H),
)
def grid_left_observed(spark, d):
    obs = I.observed(spark, d)
    return rounded(J.grid_left_observed(T.dense_grid(obs, I.HOUR), obs).select(*SERIES, "BucketTime", *PROFILE_COLS))


@query(
    "join_weather",
    sql(f"SELECT {K3}, round(NumVehicles, 8) AS NumVehicles, " + each(WEATHER_COLS, "round({c}, 8) AS {c}")
        + " FROM traffic_obs LEFT JOIN weather USING (BucketTime)", "traffic_obs", "weather", grain=H),
)
def join_weather(spark, d):
    from ..plans.etl import EtlOptions, weather_table

    t = I.traffic_obs(spark, d)
    w = weather_table(S.weather_feed(spark, d, I.HOUR), T.time_grid(t, I.HOUR), EtlOptions(step=I.HOUR))
    return rounded(J.join_weather(t.select(*KEYS, "NumVehicles"), w))


_REQ = {
    "req": "SELECT event_id, 'N' || CAST(user_id // 10 AS VARCHAR) AS DeviceId, ts AS \"at\" FROM events",
}


def _requests(spark, d):
    node = F.concat(F.lit("N"), F.floor(F.col("user_id") / 10).cast("string"))
    return S.events(spark, d).select("event_id", node.alias("DeviceId"), F.col("ts").alias("at"))


@query(
    "asof_nearest",
    sql("""SELECT event_id, DeviceId, q."at", s.BucketTime, round(s.NumVehicles, 8) AS NumVehicles FROM (
        SELECT r.event_id, DeviceId, r."at", arg_min(s.BucketTime, (abs(epoch_us(r."at") - epoch_us(s.BucketTime)),
        -epoch_us(s.BucketTime))) AS BucketTime FROM req r JOIN dev_freq s USING (DeviceId) GROUP BY ALL) q
        JOIN dev_freq s USING (DeviceId, BucketTime)""", "dev_freq", grain=H, extra=_REQ),
)
def asof_nearest(spark, d):
    dev = T.asfreq(A.device_series(I.traffic_obs(spark, d), ["NumVehicles"]), I.HOUR)
    return rounded(J.asof_nearest(_requests(spark, d), dev, I.HOUR))


_ASOF = {
    "obs": """SELECT 'N' || CAST(user_id // 10 AS VARCHAR) AS DeviceId, ts AS seen, max(struct_pack(v := "value", e := event_id)) AS r
    FROM events GROUP BY ALL""",
    "asked": """SELECT event_id AS request, 'N' || CAST(user_id // 10 AS VARCHAR) AS DeviceId,
    ts + to_seconds(event_id * 7919 % 172801 - 86400) AS "at" FROM events""",
    "sides": """SELECT a.*, b.seen AS s0, b.r AS r0, n.seen AS s1, n.r AS r1 FROM asked a
    ASOF LEFT JOIN obs b ON a.DeviceId = b.DeviceId AND a."at" >= b.seen
    ASOF LEFT JOIN obs n ON a.DeviceId = n.DeviceId AND a."at" <= n.seen""",
    "chosen": """SELECT *, s1 IS NULL OR coalesce(epoch_us("at") - epoch_us(s0) < epoch_us(s1) - epoch_us("at"), FALSE) AS early FROM sides""",
}


@query(
    "asof_irregular",
    sql("""SELECT request, DeviceId, "at", CASE WHEN early THEN s0 ELSE s1 END AS seen,
        CASE WHEN early THEN r0.v ELSE r1.v END AS reading, CASE WHEN early THEN r0.e ELSE r1.e END AS event,
        s0 AS last_seen, s1 AS next_seen FROM chosen""", extra=_ASOF),
)
def asof_irregular(spark, d):
    """The reading nearest to each request, and the stamps on both sides, where readings come at any time."""
    shift = F.make_dt_interval(secs=F.col("event_id") * 7919 % 172801 - 86400)
    asked = _requests(spark, d).select(F.col("event_id").alias("request"), "DeviceId", (F.col("at") + shift).alias("at"))
    node = F.concat(F.lit("N"), F.floor(F.col("user_id") / 10).cast("string"))
    readings = S.events(spark, d).select(
        node.alias("DeviceId"), F.col("ts").alias("seen"), F.col("value").alias("reading"), F.col("event_id").alias("event"))
    stamps = readings.select("DeviceId", "seen")
    out = J.asof(asked, readings, time="seen")
    for name, direction in (("last_seen", "before"), ("next_seen", "after")):
        out = J.asof(out, stamps.withColumnRenamed("seen", name), time=name, direction=direction)
    return out


@query(
    "future_exog_fallback",
    sql("""SELECT o.DeviceId, CAST(k AS INTEGER) AS step, o.BucketTime + to_hours(k) AS FutureTime,
        round(CASE WHEN s.DeviceId IS NOT NULL THEN s.AvgSpeed ELSE l.AvgSpeed END, 8) AS AvgSpeed,
        round(CASE WHEN s.DeviceId IS NOT NULL THEN s.Occupancy ELSE l.Occupancy END, 8) AS Occupancy
        FROM (SELECT DeviceId, BucketTime FROM (SELECT DeviceId, BucketTime, row_number() OVER
              (PARTITION BY DeviceId ORDER BY BucketTime DESC) AS rn FROM series) WHERE rn <= 12) o
        CROSS JOIN (SELECT unnest(range(1, 25)) AS k) n
        JOIN (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY DeviceId ORDER BY BucketTime DESC) = 1) l
          ON l.DeviceId = o.DeviceId
        LEFT JOIN series s ON s.DeviceId = o.DeviceId AND s.BucketTime = o.BucketTime + to_hours(k)""",
        "series", grain=H),
)
def future_exog_fallback(spark, d):
    """Regressors of the 24 stamps after each of the last 12 ticks; beyond the data the last row."""
    s = I.series(spark, d)
    origins = T.tail_n(s.select("DeviceId", "BucketTime"), 12, ["DeviceId"])
    ahead = T.future_index(origins, 24, I.HOUR).drop("BucketTime")
    cols = ["AvgSpeed", "Occupancy"]
    return rounded(J.future_with_fallback(ahead, s, T.last_row(s, ["DeviceId"]), cols))


@query(
    "reindex_fill",
    sql("""SELECT DeviceId, BucketTime, round(coalesce(last_value(y IGNORE NULLS) OVER b, first_value(y IGNORE NULLS) OVER a), 8)
        AS filled, round(coalesce(y, 0), 8) AS zeroed FROM (SELECT i.DeviceId, i.BucketTime, d.NumVehicles AS y
        FROM dev_index i LEFT JOIN dev d USING (DeviceId, BucketTime))
        WINDOW b AS (PARTITION BY DeviceId ORDER BY BucketTime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        a AS (PARTITION BY DeviceId ORDER BY BucketTime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
        "dev_index", "dev", grain=H),
)
def reindex_fill(spark, d):
    dev = A.device_series(I.traffic_obs(spark, d), ["NumVehicles"])
    index = T.asfreq(dev, I.HOUR).select("DeviceId", "BucketTime")
    open_cells = J.reindex(index, dev, ["DeviceId"]).select(
        "DeviceId", "BucketTime", F.col("NumVehicles").alias("filled"),
        F.coalesce("NumVehicles", F.lit(0.0)).alias("zeroed"),
    )
    return rounded(T.bfill_ffill(open_cells, ["filled"], ["DeviceId"], default=None, ffill_first=True))


@query(
    "score_join",
    sql("""SELECT a.DeviceId, a.BucketTime, round(a.NumVehicles, 8) AS actual, round(f.NumVehicles, 8) AS forecast,
        round(abs(a.NumVehicles - f.NumVehicles), 8) AS error FROM dev a JOIN dev f
        ON f.DeviceId = a.DeviceId AND f.BucketTime + INTERVAL 1 HOUR = a.BucketTime""", "dev", grain=H),
)
def score_join(spark, d):
    """Actuals against a one-step persistence forecast on the stamps both have."""
    from ..functions.calendar import add_steps

    dev = A.device_series(I.traffic_obs(spark, d), ["NumVehicles"])
    actual = dev.select("DeviceId", "BucketTime", F.col("NumVehicles").alias("actual"))
    forecast = dev.select("DeviceId", add_steps("BucketTime", 1, I.HOUR).alias("BucketTime"),
                          F.col("NumVehicles").alias("forecast"))
    return rounded(actual.join(forecast, ["DeviceId", "BucketTime"])
                   .withColumn("error", F.abs(F.col("actual") - F.col("forecast"))))


def _metric_rows(spark, d):
    """A metrics table from the events: several rows per device and target, none for odd devices."""
    node = F.concat(F.lit("N"), (F.floor(F.col("user_id") / 10) * 2).cast("string"))
    target = F.when(F.col("event_id") % 2 == 0, "AvgSpeed").otherwise("NumVehicles")
    return S.events(spark, d).select(
        F.col("event_id").alias("row"), node.alias("DeviceId"), target.alias("TargetCol"),
        F.col("value").alias("MAE"), (F.col("value") * 1.5).alias("RMSE"), F.col("kk").cast("double").alias("MAPE"),
        (1 - F.col("kk") / 50).alias("R2"),
    )


METRICS_SQL = {
    "metrics": """SELECT event_id AS "row", 'N' || CAST(2 * (user_id // 10) AS VARCHAR) AS DeviceId,
    CASE WHEN event_id % 2 = 0 THEN 'AvgSpeed' ELSE 'NumVehicles' END AS TargetCol, "value" AS MAE,
    "value" * 1.5 AS RMSE, CAST(kk AS DOUBLE) AS MAPE, 1 - CAST(kk AS DOUBLE) / 50 AS R2
    FROM ev""",
}


@query(
    "metrics_lookup",
    sql("""SELECT v.DeviceId, round(coalesce(m.MAE, 50), 8) AS MAE, round(coalesce(m.RMSE, 70), 8) AS RMSE,
        round(coalesce(m.MAPE, 20), 8) AS MAPE, round(coalesce(m.R2, 0.1), 8) AS R2 FROM
        (SELECT DISTINCT 'N' || CAST(user_id // 10 AS VARCHAR) AS DeviceId FROM ev) v LEFT JOIN
        (SELECT * FROM metrics WHERE TargetCol='NumVehicles' QUALIFY row_number() OVER
        (PARTITION BY DeviceId ORDER BY "row") = 1) m USING (DeviceId)""", "ev", extra=METRICS_SQL),
)
def metrics_lookup(spark, d):
    devices = _requests(spark, d).select("DeviceId").distinct()
    defaults = {"MAE": 50.0, "RMSE": 70.0, "MAPE": 20.0, "R2": 0.1}
    return rounded(J.metrics_lookup(devices, _metric_rows(spark, d), "NumVehicles", defaults))


@query(
    "devices_for_target",
    sql("""SELECT 'AvgSpeed' AS target, DeviceId FROM metrics WHERE TargetCol='AvgSpeed' GROUP BY ALL
        UNION ALL SELECT 'Occupancy', 'N' || CAST(user_id // 10 AS VARCHAR) FROM ev GROUP BY ALL""",
        "ev", extra=METRICS_SQL),
)
def devices_for_target(spark, d):
    """One target with metrics and one without any (all devices)."""
    devices, metrics = _requests(spark, d), _metric_rows(spark, d)
    parts = [
        J.devices_for_target(devices, metrics, t).select(F.lit(t).alias("target"), "DeviceId")
        for t in ("AvgSpeed", "Occupancy")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "devices_by_list",
    sql("SELECT DeviceId, count(*) AS n FROM traffic_clean WHERE DeviceId IN ('N1', 'N3', 'N12') GROUP BY ALL",
        "traffic_clean"),
)
def devices_by_list(spark, d):
    rows = J.devices_by_list(I.traffic_clean(spark, d, I.FIVE), ["N1", "N3", "N12"])
    return rows.groupBy("DeviceId").agg(F.count(F.lit(1)).alias("n"))


@query(
    "subset_devices",
    sql("""SELECT DeviceId, BucketTime, round(NumVehicles, 8) AS NumVehicles FROM dev WHERE DeviceId IN
        (SELECT DISTINCT DeviceId FROM dev ORDER BY 1 LIMIT 2) QUALIFY row_number() OVER
        (PARTITION BY DeviceId ORDER BY BucketTime DESC) <= 300""", "dev", grain=H),
)
def subset_devices(spark, d):
    """Test mode of the training job: first two devices, last 300 rows each."""
    dev = A.device_series(I.traffic_obs(spark, d), ["NumVehicles"])
    return rounded(T.tail_n(first_devices(dev, 2), 300, ["DeviceId"]))


@query(
    "union_history",
    sql("""SELECT DeviceId, BucketTime, round(NumVehicles, 8) AS NumVehicles FROM (SELECT * FROM (
        SELECT DeviceId, BucketTime, NumVehicles FROM dev UNION ALL
        SELECT DeviceId, max(BucketTime) + INTERVAL 1 HOUR, arg_max(NumVehicles, BucketTime) FROM dev GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY DeviceId ORDER BY BucketTime DESC) <= 24)""", "dev", grain=H),
)
def union_history(spark, d):
    """History plus one new row per device, last 24 kept."""
    from ..functions.calendar import add_steps

    dev = A.device_series(I.traffic_obs(spark, d), ["NumVehicles"])
    new = T.last_row(dev, ["DeviceId"]).withColumn("BucketTime", add_steps("BucketTime", 1, I.HOUR))
    return rounded(T.tail_n(dev.unionByName(new), 24, ["DeviceId"]))


@query(
    "index_union",
    sql("""SELECT BucketTime, 'union' AS kind FROM (SELECT BucketTime FROM traffic_raw UNION SELECT BucketTime
        FROM weather_raw) UNION ALL SELECT BucketTime, 'both' FROM (SELECT BucketTime FROM traffic_raw INTERSECT
        SELECT BucketTime FROM weather_raw)""", "traffic_raw", "weather_raw"),
)
def index_union(spark, d):
    a = S.traffic_feed(spark, d).select("BucketTime")
    b = S.weather_feed(spark, d).select("BucketTime")
    return a.union(b).distinct().withColumn("kind", F.lit("union")).unionByName(
        a.intersect(b).withColumn("kind", F.lit("both"))
    )
