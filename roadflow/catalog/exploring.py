"""Queries of the descriptive reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as P
from ..plans import explore as X
from ..sources import sample_feeds as S
from .registry import query, rounded
from .sqltext import sql


@query(
    "feed_summary",
    sql("""SELECT count(*) AS n_rows, min(OccurDate) AS first_seen, max(OccurDate) AS last_seen, round(avg(Speed), 8)
        AS mean_speed, round(avg(Confidence), 8) AS mean_confidence, count(DISTINCT Plate) AS plates,
        round(median(Speed), 8) AS median_speed FROM vehicle_raw""", "vehicle_raw"),
)
def feed_summary(spark, d):
    return rounded(X.vehicle_summary(S.vehicle_feed(spark, d)))


@query(
    "traffic_summary",
    sql("""SELECT count(*) AS n_rows, min(OccurDate) AS first_seen, max(OccurDate) AS last_seen, round(avg(AvgSpeed), 8)
        AS mean_speed, round(avg(NumVehicles), 8) AS mean_vehicles, round(avg(FlowRate), 8) AS mean_flow
        FROM traffic_raw""", "traffic_raw"),
)
def traffic_summary(spark, d):
    return rounded(X.traffic_summary(S.traffic_feed(spark, d)))


def _pivot(value: str) -> str:
    return ", ".join(f"{value} FILTER (WHERE IntervalType = {k}) AS interval_{k}" for k in (1, 5, 15))


@query(
    "hourly_volume_by_interval",
    sql(f"SELECT date_trunc('hour', BucketTime) AS hour, {_pivot('sum(NumVehicles)')} FROM traffic_raw GROUP BY ALL",
        "traffic_raw"),
)
def hourly_volume_by_interval(spark, d):
    return X.hourly_volume_by_interval(S.traffic_feed(spark, d))


@query(
    "speed_by_hour",
    sql("SELECT hour, " + ", ".join(f"round(interval_{k}, 8) AS interval_{k}" for k in (1, 5, 15))
        + f" FROM (SELECT CAST(hour(BucketTime) AS INTEGER) AS hour, {_pivot('avg(AvgSpeed)')} FROM traffic_raw GROUP BY ALL)",
        "traffic_raw"),
)
def speed_by_hour(spark, d):
    return rounded(X.speed_by_hour(S.traffic_feed(spark, d)))


@query(
    "hourly_count_dense",
    sql("""SELECT h AS hour, count(Id) AS n FROM (SELECT unnest(generate_series(date_trunc('hour', min(BucketTime)),
        date_trunc('hour', max(BucketTime)), INTERVAL 1 HOUR)) AS h FROM vehicle_raw) LEFT JOIN vehicle_raw
        ON date_trunc('hour', BucketTime) = h GROUP BY ALL""", "vehicle_raw"),
)
def hourly_count_dense(spark, d):
    return X.hourly_count_dense(S.vehicle_feed(spark, d))


_CORR = ["NumVehicles", "AvgSpeed", "Occupancy", "AvgDensity", "AvgHeadway", "Confidence", "FlowRate"]


@query(
    "corr_matrix",
    sql(" UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, "
        + ("CAST(1 AS DOUBLE)" if a == b else f"round(corr({a}, {b}), 8)") + " AS r FROM "
        + ("(SELECT 1)" if a == b else "traffic_raw")
        for a in _CORR for b in _CORR), "traffic_raw"),
)
def corr_matrix(spark, d):
    return rounded(X.corr_matrix(S.traffic_feed(spark, d), _CORR))


@query(
    "speed_histogram",
    sql("""SELECT CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) / 60 * i, 8) AS "left", round(lo + (hi - lo) / 60 * (i + 1), 8)
        AS "right", coalesce(n, 0) AS n FROM (SELECT min(Speed) AS lo, max(Speed) AS hi FROM vehicle_raw),
        (SELECT unnest(range(60)) AS i) LEFT JOIN (SELECT least(floor((Speed - lo) / (hi - lo) * 60), 59) AS b, count(*) AS n
        FROM vehicle_raw, (SELECT min(Speed) AS lo, max(Speed) AS hi FROM vehicle_raw) GROUP BY ALL) ON b = i""",
        "vehicle_raw"),
)
def speed_histogram(spark, d):
    return rounded(X.histogram(S.vehicle_feed(spark, d), "Speed", 60), ["left", "right"])


@query(
    "class_counts",
    sql("SELECT VehicleClass, count(*) AS n FROM vehicle_raw GROUP BY ALL", "vehicle_raw"),
)
def class_counts(spark, d):
    return X.counts_by(S.vehicle_feed(spark, d), "VehicleClass")


@query(
    "speed_boxplot",
    sql("""SELECT VehicleClass, q.n, least(min(Speed) FILTER (WHERE Speed >= q1 - 1.5 * (q3 - q1)), q1) AS whisker_low,
        round(q1, 8) AS q1, round(med, 8) AS median, round(q3, 8) AS q3,
        greatest(max(Speed) FILTER (WHERE Speed <= q3 + 1.5 * (q3 - q1)), q3) AS whisker_high
        FROM vehicle_raw r JOIN (SELECT VehicleClass, count(*) AS n, quantile_cont(Speed, 0.25) AS q1,
        quantile_cont(Speed, 0.5) AS med, quantile_cont(Speed, 0.75) AS q3 FROM vehicle_raw GROUP BY ALL) q
        USING (VehicleClass) GROUP BY VehicleClass, q.n, q1, med, q3""", "vehicle_raw"),
)
def speed_boxplot(spark, d):
    return rounded(X.boxplot(S.vehicle_feed(spark, d), "VehicleClass", "Speed"), ["q1", "median", "q3"])


@query(
    "top_nodes",
    sql("""SELECT substr(trim(NodeId), 1, 8) AS node, total FROM (SELECT NodeId, sum(NumVehicles) AS total FROM traffic_raw
        GROUP BY ALL ORDER BY total DESC, NodeId LIMIT 10)""", "traffic_raw"),
)
def top_nodes(spark, d):
    from ..functions.columns import short_id

    top = P.top_values(S.traffic_feed(spark, d), "NodeId", 10, "NumVehicles")
    return top.select(short_id(F.trim("NodeId")).alias("node"), "total")


@query(
    "top_values",
    sql("""SELECT coalesce(VehicleColor, 'unknown') AS VehicleColor, count(*) AS total FROM vehicle_raw GROUP BY ALL
        ORDER BY total DESC, 1 LIMIT 12""", "vehicle_raw"),
)
def top_values(spark, d):
    return P.top_values(S.vehicle_feed(spark, d), "VehicleColor", 12, label="unknown")


@query(
    "sample_n",
    sql("""SELECT Id, round(AvgSpeed, 8) AS AvgSpeed, round(Occupancy, 8) AS Occupancy, IntervalType FROM traffic_raw
        WHERE AvgSpeed IS NOT NULL AND Occupancy IS NOT NULL ORDER BY md5('42|' || Id), Id LIMIT 2500""", "traffic_raw"),
)
def sample_n(spark, d):
    """A repeatable sample of 2,500 speed / occupancy points; exact in size."""
    points = S.traffic_feed(spark, d).select("Id", "AvgSpeed", "Occupancy", "IntervalType").dropna()
    return rounded(P.sample_n(points, 2500, by=["Id"]))


@query(
    "sort_final",
    sql("SELECT BucketTime, DeviceId, Lane, round(NumVehicles, 8) AS NumVehicles FROM traffic_obs "
        "ORDER BY BucketTime, DeviceId, Lane", "traffic_obs"),
)
def sort_final(spark, d):
    from . import inputs as I

    rows = I.traffic_obs(spark, d, I.FIVE).select("BucketTime", "DeviceId", "Lane", "NumVehicles")
    return rounded(rows).orderBy("BucketTime", "DeviceId", "Lane")
