"""Queries of the whole ETL job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.validate import quality_checks as checks
from ..plans import etl
from ..schemas import COUNT_COLS, FINAL_COLS, PROFILE_COLS, RATIO_COLS, WEATHER_COLS
from ..sources import sample_feeds as S
from . import inputs as I
from .registry import query, rounded
from .sqltext import calendar, sql

_ROLL = ", ".join(
    f"avg({c}) OVER r{n} AS {c}_roll_mean_{span}, coalesce(stddev_samp({c}) OVER r{n}, 0) AS {c}_roll_std_{span}"
    for c in ("NumVehicles", "AvgSpeed") for span, n in (("15m", 3), ("30m", 6))
)
_RATIO = ", ".join(
    f"CASE WHEN NumVehicles > 0 THEN {c} / NumVehicles ELSE 0 END AS {r}" for c, r in zip(COUNT_COLS, RATIO_COLS)
)
_FINAL = {
    "fin": f"SELECT *, {calendar('BucketTime')}, {_RATIO}, {_ROLL} FROM counted LEFT JOIN weather USING (BucketTime) "
    + " WINDOW " + ", ".join(
        f"r{n} AS (PARTITION BY DeviceId, Lane ORDER BY BucketTime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for n in (3, 6)
    )
}
_INTS = ["Hour", "DayOfWeek", "IsHoliday", "IsWeekend", "Day", "Month"]
_KEYS = ["BucketTime", "DeviceId", "Lane"]
_STD = [c for c in FINAL_COLS if "_roll_std_" in c]
_NUM = [c for c in FINAL_COLS if c not in _INTS + _KEYS + _STD]
_SELECT = ", ".join(
    _KEYS + _INTS + [f"round({c}, 8) AS {c}" for c in _NUM] + [f"round({c}, 6) AS {c}" for c in _STD]
)
_BUILT = ("counted", "weather")


def shown(table):
    """A processed table with its doubles rounded; columns may be missing."""
    have = [c for c in FINAL_COLS if c in table.columns]
    out = rounded(table, [c for c in _NUM if c in have])
    return rounded(out, [c for c in _STD if c in have], 6).select(*have)


def final_sql(without: str = "") -> str:
    """SQL of the hourly processed table."""
    text = f"SELECT {_SELECT} FROM fin"
    if without:
        text = f"SELECT * EXCLUDE ({without}) FROM ({text})"
    return sql(text, *_BUILT, grain=I.HOUR_S, extra=_FINAL)


def _final(spark, d, step):
    return shown(I.etl_run(spark, d, step).processed)


@query("final_projection", final_sql())
def final_projection(spark, d):
    """All 41 columns on the hourly grid."""
    return _final(spark, d, I.HOUR)


@query("processed_table", sql(f"SELECT {_SELECT} FROM fin", *_BUILT, extra=_FINAL))
def processed_table(spark, d):
    """All 41 columns on the five-minute grid, the job's normal resolution."""
    return _final(spark, d, I.FIVE)


@query(
    "quality_checks",
    sql("SELECT bool_and(" + " AND ".join(f"{r} BETWEEN 0 AND 1" for r in RATIO_COLS) + ") AS class_ratio_bounds_ok, "
        f"bool_and(NumVehicles <= 0 OR {' + '.join(COUNT_COLS)} > 0) AS vehicle_count_positive_all_rows, "
        f"count(*) FILTER (WHERE {' + '.join(COUNT_COLS)} = 0 AND SpeedStd = 0 AND "
        "abs(MedianSpeed - AvgSpeed) <= 1e-8 + 1e-5 * abs(AvgSpeed)) AS legacy_signature_rows FROM fin",
        *_BUILT, grain=I.HOUR_S, extra=_FINAL),
)
def quality_checks(spark, d):
    return checks(I.etl_run(spark, d, I.HOUR).final)


REPORT_SQL = sql("""SELECT (SELECT count(*) FROM t2) AS traffic_rows_raw,
        (SELECT count(*) FROM t2) - (SELECT count(*) FROM traffic_raw) AS traffic_exact_duplicates_removed,
        CAST(0 AS BIGINT) AS traffic_duplicate_ids_removed, (SELECT count(*) FROM traffic_raw) AS traffic_rows_after_raw_dedup,
        (SELECT count(*) FROM traffic_clean) AS traffic_rows_of_interval, CAST(0 AS BIGINT) AS traffic_rows_missing_key,
        (SELECT CAST(coalesce(sum(TrafficRowsInKey) FILTER (WHERE TrafficRowsInKey > 1), 0) AS BIGINT) FROM traffic_agg)
          AS traffic_duplicate_key_rows, (SELECT count(*) FROM traffic_agg) AS traffic_unique_keys,
        (SELECT count(*) FROM vehicle_raw) AS vehicle_rows_raw, CAST(0 AS BIGINT) AS vehicle_exact_duplicates_removed,
        CAST(0 AS BIGINT) AS vehicle_duplicate_ids_removed, (SELECT count(*) FROM vehicle_raw) AS vehicle_rows_after_raw_dedup,
        (SELECT count(*) FROM traffic_agg) AS traffic_keys, (SELECT count(*) FROM vehicle_stats) AS vehicle_keys,
        (SELECT count(*) FROM m) AS matched_keys,
        round((SELECT count(*) FROM m) / (SELECT count(*) FROM traffic_agg) * 100, 2) AS matched_percent,
        count(*) AS final_rows, count(*) FILTER (WHERE fill_source='observed') AS rows_observed,
        count(*) FILTER (WHERE fill_source='interpolated') AS rows_interpolated,
        count(*) FILTER (WHERE fill_source='profile') AS rows_profile,
        bool_and(""" + " AND ".join(f"{r} BETWEEN 0 AND 1" for r in RATIO_COLS) + """) AS class_ratio_bounds_ok,
        bool_and(NumVehicles <= 0 OR """ + " + ".join(COUNT_COLS) + """ > 0) AS vehicle_count_positive_all_rows,
        count(*) FILTER (WHERE """ + " + ".join(COUNT_COLS) + """ = 0 AND SpeedStd = 0 AND
        abs(MedianSpeed - AvgSpeed) <= 1e-8 + 1e-5 * abs(AvgSpeed)) AS legacy_signature_rows FROM fin""",
        *_BUILT, "traffic_agg", "vehicle_stats", grain=I.HOUR_S, extra={
            **_FINAL, "t2": "SELECT * FROM traffic_raw UNION ALL SELECT * FROM traffic_raw WHERE Lane = 2",
            "m": "SELECT BucketTime, DeviceId, Lane FROM traffic_agg INTERSECT SELECT BucketTime, DeviceId, Lane FROM vehicle_stats"})


@query("etl_report", REPORT_SQL)
def etl_report(spark, d):
    """Counters of a run over a feed that carries exact copies."""
    traffic = S.with_copies(S.traffic_feed(spark, d, I.HOUR))
    vehicle = S.vehicle_feed(spark, d, I.HOUR)
    o = etl.EtlOptions(step=I.HOUR)
    return etl.etl_report(traffic, vehicle, etl.build(traffic, vehicle, S.weather_feed(spark, d, I.HOUR), o), o)


@query(
    "missing_after_fill",
    sql("SELECT count(*) AS final_rows, " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in PROFILE_COLS + WEATHER_COLS)
        + " AS missing FROM counted LEFT JOIN weather USING (BucketTime)".replace("counted", "fin0"),
        *_BUILT, grain=I.HOUR_S, extra={"fin0": f"SELECT *, {_RATIO} FROM counted"}),
)
def missing_after_fill(spark, d):
    cols = PROFILE_COLS + WEATHER_COLS
    final = I.etl_run(spark, d, I.HOUR).final
    nulls = [F.count_if(F.col(c).isNull()) for c in cols]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    return final.agg(F.count(F.lit(1)).alias("final_rows"), total.alias("missing"))
