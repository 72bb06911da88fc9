"""Queries of the aggregation operators."""

from __future__ import annotations


from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import timeseries as T
from ..schemas import COUNT_COLS, KEYS, PROFILE_COLS, RATIO_COLS, TRAFFIC_METRICS, WEATHER_COLS
from . import inputs as I
from .registry import query, rounded
from .sqltext import each, sql, wavg

H = I.HOUR_S
K3 = "BucketTime, DeviceId, Lane"


@query(
    "weighted_avg",
    sql(f"""SELECT DeviceId, round(speed, 8) AS speed, round(occ, 8) AS occ FROM (SELECT DeviceId,
        {wavg('AvgSpeed').replace('AS AvgSpeed', 'AS speed')}, {wavg('Occupancy').replace('AS Occupancy', 'AS occ')}
        FROM traffic_clean GROUP BY ALL)""", "traffic_clean"),
)
def weighted_avg(spark, d):
    clean = I.traffic_clean(spark, d, I.FIVE)
    return rounded(clean.groupBy("DeviceId").agg(
        A.weighted_average("AvgSpeed", "NumVehicles").alias("speed"),
        A.weighted_average("Occupancy", "NumVehicles").alias("occ"),
    ))


@query(
    "traffic_by_key",
    sql(f"SELECT {K3}, TrafficRowsInKey, " + each(TRAFFIC_METRICS, "round({c}, 8) AS {c}") + " FROM traffic_agg",
        "traffic_agg", grain=H),
)
def traffic_by_key(spark, d):
    return rounded(I.traffic_agg(spark, d))


@query(
    "median_impute",
    sql(f"SELECT {K3}, " + each(TRAFFIC_METRICS, "round({c}, 8) AS {c}") + " FROM traffic_obs",
        "traffic_obs", grain=H),
)
def median_impute(spark, d):
    return rounded(I.traffic_obs(spark, d))


STATS = ["AvgTravelTime", "MedianSpeed", "SpeedStd", "MeanConfidence"]


@query(
    "vehicle_stats",
    sql(f"SELECT {K3}, VehicleRows, " + each(STATS, "round({c}, 8) AS {c}") + " FROM vehicle_stats",
        "vehicle_stats", grain=H),
)
def vehicle_stats(spark, d):
    return rounded(A.vehicle_by_key(I.vehicle_clean(spark, d)).select(*KEYS, "VehicleRows", *STATS))


@query(
    "vehicle_stats_hot_keys",
    sql("SELECT DeviceId, count(*) AS VehicleRows, round(median(Speed), 8) AS MedianSpeed, "
        "round(stddev_pop(Speed), 8) AS SpeedStd FROM vehicle_clean GROUP BY ALL", "vehicle_clean"),
)
def vehicle_stats_hot_keys(spark, d):
    """Devices above 650 rows take the split path for the median."""
    clean = I.vehicle_clean(spark, d, I.FIVE)
    hot = A.hot_groups(clean, ["DeviceId"], 650)
    return rounded(
        A.vehicle_by_key(clean, ["DeviceId"], hot).select("DeviceId", "VehicleRows", "MedianSpeed", "SpeedStd")
    )


@query(
    "vehicle_class_counts",
    sql(f"SELECT {K3}, {', '.join(COUNT_COLS)} FROM vehicle_stats", "vehicle_stats", grain=H),
)
def vehicle_class_counts(spark, d):
    return A.vehicle_class_counts(I.vehicle_clean(spark, d))


@query(
    "vehicle_ratios",
    sql(f"SELECT {K3}, " + each(RATIO_COLS, "round({c}, 8) AS {c}") + " FROM vehicle_feat",
        "vehicle_feat", grain=H),
)
def vehicle_ratios(spark, d):
    counts = A.vehicle_class_counts(I.vehicle_clean(spark, d))
    return rounded(A.vehicle_ratios(counts).select(*KEYS, *RATIO_COLS))


@query(
    "vehicle_features",
    sql(f"SELECT {K3}, VehicleRows, {', '.join(COUNT_COLS)}, "
        + each(STATS + RATIO_COLS, "round({c}, 8) AS {c}") + " FROM vehicle_feat", "vehicle_feat"),
)
def vehicle_features(spark, d):
    return rounded(I.vehicle_feat(spark, d, I.FIVE))


@query(
    "hourly_profile",
    sql("SELECT DeviceId, Lane, Hour, " + each(PROFILE_COLS, "round({c}, 9) AS {c}") + " FROM prof",
        "prof", grain=H),
)
def hourly_profile(spark, d):
    return rounded(A.hourly_profile(I.observed(spark, d)), places=9)


@query(
    "global_hourly_profile",
    sql("SELECT Hour, " + each(PROFILE_COLS, "round({c}, 8) AS {c}") + " FROM gprof", "gprof", grain=H),
)
def global_hourly_profile(spark, d):
    return rounded(A.global_hourly_profile(I.observed(spark, d)))


@query(
    "weather_by_time",
    sql("SELECT BucketTime, " + each(WEATHER_COLS, "round({c}, 8) AS {c}") + " FROM weather_mean", "weather_mean"),
)
def weather_by_time(spark, d):
    return rounded(I.weather_mean(spark, d, I.FIVE))


@query(
    "resample_5min",
    sql("SELECT i.DeviceId, i.Lane, i.BucketTime, round(NumVehicles, 8) AS NumVehicles, round(Speed, 8) AS AvgSpeed "
        "FROM i LEFT JOIN b USING (DeviceId, Lane, BucketTime)", "traffic_clean", grain=60, extra={
            "b": "SELECT DeviceId, Lane, time_bucket(INTERVAL '300 seconds', BucketTime) AS BucketTime, "
                 "avg(NumVehicles) AS NumVehicles, avg(AvgSpeed) AS Speed FROM traffic_clean GROUP BY ALL",
            "i": "SELECT DeviceId, Lane, unnest(generate_series(min(BucketTime), max(BucketTime), "
                 "INTERVAL '300 seconds')) AS BucketTime FROM b GROUP BY DeviceId, Lane"}),
)
def resample_5min(spark, d):
    minute = I.traffic_clean(spark, d, "1 minute")
    return rounded(T.resample_mean(minute, ["NumVehicles", "AvgSpeed"], ["DeviceId", "Lane"])
                   .select("DeviceId", "Lane", "BucketTime", "NumVehicles", "AvgSpeed"))


@query(
    "resample_lineitem_daily",
    """WITH b AS (SELECT l_suppkey, l_shipdate, avg(l_quantity) AS q, avg(l_extendedprice) AS p
    FROM lineitem GROUP BY ALL), i AS (SELECT l_suppkey, unnest(generate_series(min(l_shipdate), max(l_shipdate),
    INTERVAL 1 DAY)) AS l_shipdate FROM b GROUP BY l_suppkey)
    SELECT l_suppkey, l_shipdate, round(q, 8) AS l_quantity, round(p, 6) AS l_extendedprice
    FROM i LEFT JOIN b USING (l_suppkey, l_shipdate)""",
)
def resample_lineitem_daily(spark, d):
    """Daily resample of the largest table: one series per supplier."""
    from ..sources.sample_feeds import table

    rows = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    out = T.resample_mean(rows, ["l_quantity", "l_extendedprice"], ["l_suppkey"], "1 day", "l_shipdate")
    return rounded(rounded(out, ["l_quantity"]), ["l_extendedprice"], 6)


@query(
    "device_series",
    sql("SELECT DeviceId, BucketTime, " + each(TRAFFIC_METRICS, "round({c}, 8) AS {c}") + " FROM dev", "dev", grain=H),
)
def device_series(spark, d):
    return rounded(A.device_series(I.traffic_obs(spark, d), TRAFFIC_METRICS))


@query(
    "daily_join_diag",
    sql("""SELECT CAST(BucketTime AS DATE) AS Date, count(*) FILTER (WHERE v.VehicleRows IS NULL) AS TrafficWithoutVehicle,
        count(*) FILTER (WHERE v.VehicleRows IS NOT NULL) AS TrafficWithVehicle, CAST(0 AS BIGINT) AS VehicleWithoutTraffic,
        count(*) AS TrafficRows, round(count(*) FILTER (WHERE v.VehicleRows IS NOT NULL) / count(*) * 100, 8) AS MatchedPercent
        FROM traffic_agg t LEFT JOIN vehicle_stats v USING (BucketTime, DeviceId, Lane) GROUP BY ALL""",
        "traffic_agg", "vehicle_stats"),
)
def daily_join_diag(spark, d):
    joined = J.with_match(
        I.traffic_agg(spark, d, I.FIVE).select(*KEYS), I.vehicle_feat(spark, d, I.FIVE).select(*KEYS)
    )
    return rounded(A.daily_join_diagnostics(joined))


@query(
    "daily_join_diag_full",
    sql("""SELECT CAST(BucketTime AS DATE) AS Date, count(*) FILTER (WHERE v.VehicleRows IS NULL) AS TrafficWithoutVehicle,
        count(*) FILTER (WHERE v.VehicleRows IS NOT NULL AND t.TrafficRowsInKey IS NOT NULL) AS TrafficWithVehicle,
        count(*) FILTER (WHERE t.TrafficRowsInKey IS NULL) AS VehicleWithoutTraffic,
        count(t.TrafficRowsInKey) AS TrafficRows, round(CASE WHEN count(t.TrafficRowsInKey) > 0 THEN
        count(*) FILTER (WHERE v.VehicleRows IS NOT NULL AND t.TrafficRowsInKey IS NOT NULL)
        / count(t.TrafficRowsInKey) * 100 ELSE 0 END, 8) AS MatchedPercent
        FROM traffic_agg t FULL JOIN vehicle_stats v USING (BucketTime, DeviceId, Lane) GROUP BY ALL""",
        "traffic_agg", "vehicle_stats"),
)
def daily_join_diag_full(spark, d):
    """The report's right_only column, filled by a full outer join."""
    joined = J.with_match(
        I.traffic_agg(spark, d, I.FIVE).select(*KEYS), I.vehicle_feat(spark, d, I.FIVE).select(*KEYS),
        how="full",
    )
    return rounded(A.daily_join_diagnostics(joined))


