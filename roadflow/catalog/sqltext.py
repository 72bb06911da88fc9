"""SQL text of the feeds and of the intermediate tables, as chained CTEs.

``sql(body, *names, grain=...)`` puts the wanted CTEs and what they build on in front of
a query. The formulas are written independently of the Spark jobs they check.
"""

from __future__ import annotations

from ..schemas import COUNT_COLS, PROFILE_COLS, TRAFFIC_DEFAULTS, WEATHER_COLS, WEATHER_DEFAULTS

TRAFFIC = ["NumVehicles", "AvgSpeed", "Occupancy", "AvgDensity", "AvgHeadway", "FlowRate"]
RATIOS = ["CarRatio", "TruckRatio", "BusRatio", "MotorcycleRatio"]


def each(cols, form: str, sep: str = ", ") -> str:
    return sep.join(form.replace("{c}", c) for c in cols)


def interp(c: str, limit: int | None) -> str:
    dp, dn = f"(pos - pi_{c})", f"(ni_{c} - pos)"
    line = f"px_{c} + (nx_{c} - px_{c}) * {dp} / (ni_{c} - pi_{c})"
    near = lambda d: "TRUE" if limit is None else f"{d} <= {limit}"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN {c} "
        f"WHEN pi_{c} IS NULL THEN CASE WHEN {near(dn)} THEN nx_{c} END "
        f"WHEN ni_{c} IS NULL THEN CASE WHEN {near(dp)} THEN px_{c} END "
        f"WHEN {near(dp)} OR {near(dn)} THEN {line} END"
    )


def neighbours(c: str) -> str:
    at = f"CASE WHEN {c} IS NOT NULL THEN pos END"
    return (
        f"last_value({c} IGNORE NULLS) OVER b AS px_{c}, last_value({at} IGNORE NULLS) OVER b AS pi_{c}, "
        f"first_value({c} IGNORE NULLS) OVER a AS nx_{c}, first_value({at} IGNORE NULLS) OVER a AS ni_{c}"
    )


def frames(part: str, order: str = "BucketTime") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return (
        f"WINDOW b AS ({p}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"a AS ({p}ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )


def wavg(c: str, w: str = "NumVehicles") -> str:
    ok = f"FILTER (WHERE {c} IS NOT NULL AND {w} > 0)"
    return f"coalesce(sum({c} * {w}) {ok} / nullif(sum({w}) {ok}, 0), avg({c})) AS {c}"


HOLIDAY = (
    "CAST(((month(T)=1 AND day(T)=1) OR (month(T)=4 AND day(T)=30) OR (month(T)=5 AND day(T)=1) "
    "OR (month(T)=9 AND day(T)=2)) OR (year(T)=2026 AND ((month(T)=2 AND day(T) BETWEEN 14 AND 22) "
    "OR (month(T)=4 AND day(T) BETWEEN 25 AND 27) OR (month(T)=5 AND day(T) IN (2,3)) "
    "OR (month(T)=8 AND day(T) BETWEEN 29 AND 31) OR (month(T)=9 AND day(T)=1))) AS INTEGER)"
)


def calendar(t: str) -> str:
    return (
        f"CAST(hour({t}) AS INTEGER) AS Hour, CAST(isodow({t})-1 AS INTEGER) AS DayOfWeek, "
        f"{HOLIDAY.replace('T)', t + ')')} AS IsHoliday, "
        f"CAST(isodow({t}) >= 6 AS INTEGER) AS IsWeekend, CAST(day({t}) AS INTEGER) AS Day, "
        f"CAST(month({t}) AS INTEGER) AS Month"
    )


def holiday(t: str) -> str:
    return HOLIDAY.replace("T)", t + ")")


def dummies(t: str) -> str:
    hours = ", ".join(f"CAST(hour({t})={h} AS INTEGER) AS Hour_{h}" for h in range(1, 24))
    days = ", ".join(f"CAST(isodow({t})-1={d} AS INTEGER) AS DoW_{d}" for d in range(1, 7))
    return f"{hours}, {days}"


_NODE = "' n' || CAST(user_id // 10 AS VARCHAR) || ' '"
_T = "time_bucket(INTERVAL '{G} seconds', ts)"

# name -> (CTEs it builds on, text); {G} is the step in seconds
CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], "SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS kk FROM events"),
    "traffic_raw": (
        ["ev"],
        f"""SELECT CAST(event_id AS VARCHAR) AS Id, {_T} AS BucketTime, '' AS DeviceId, {_NODE} AS NodeId,
        CAST(event_id % 2 + 1 AS INTEGER) AS Lane,
        CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 15 ELSE 5 END AS INTEGER) AS IntervalType,
        CAST(kk % 20 - 1 AS DOUBLE) AS NumVehicles,
        CASE WHEN kk % 10 <> 3 THEN "value" END AS AvgSpeed,
        CASE WHEN kk <> 50 THEN CAST(kk AS DOUBLE) END AS Occupancy,
        "value" / 5 AS AvgDensity, CAST(kk AS DOUBLE) / 10 AS AvgHeadway, "value" * 12 AS FlowRate,
        ts AS OccurDate, CAST(kk AS DOUBLE) AS Confidence FROM ev""",
    ),
    "vehicle_raw": (
        ["ev"],
        f"""SELECT CAST(event_id AS VARCHAR) AS Id, 'P' || CAST(user_id AS VARCHAR) AS Plate,
        {_T} AS BucketTime, '' AS DeviceId, {_NODE} AS NodeId,
        CAST(CASE WHEN event_type='error' THEN kk % 2 + 1 ELSE event_id % 2 + 1 END AS INTEGER) AS Lane,
        CAST(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 6
             WHEN 'signup' THEN 7 ELSE 4 END AS DOUBLE) AS VehicleClass,
        "value" AS Speed, CASE WHEN kk >= 5 THEN kk * CAST(10 AS DOUBLE) END AS TravelTimeSec,
        CAST(kk + event_id % 7 AS DOUBLE) AS Confidence, ts AS OccurDate,
        CASE WHEN kk % 15 <> 7 THEN 'c' || CAST(kk % 15 AS VARCHAR) END AS VehicleColor FROM ev""",
    ),
    "weather_raw": (
        ["ev"],
        f"""SELECT {_T} AS BucketTime, CAST(kk AS DOUBLE) / 10 AS Rain, 20 + CAST(kk AS DOUBLE) / 10 AS Temperature,
        50 + CAST(kk AS DOUBLE) / 2 AS Humidity, CAST(9000 - kk * 10 AS DOUBLE) AS Visibility,
        CAST(kk AS DOUBLE) / 20 AS WindSpeed FROM ev WHERE event_type='error'""",
    ),
    "traffic_clean": (
        ["traffic_raw"],
        "SELECT Id, BucketTime, upper(trim(NodeId)) AS DeviceId, Lane, IntervalType, "
        + each(TRAFFIC, "CASE WHEN {c} >= 0 THEN {c} END AS {c}")
        + " FROM traffic_raw WHERE IntervalType = 5",
    ),
    "vehicle_clean": (
        ["vehicle_raw"],
        """SELECT Id, Plate, BucketTime, upper(trim(NodeId)) AS DeviceId, Lane, VehicleClass,
        CASE WHEN Speed BETWEEN 0 AND 250 THEN Speed END AS Speed,
        CASE WHEN TravelTimeSec BETWEEN 0 AND 86400 THEN TravelTimeSec END AS TravelTimeSec,
        CASE WHEN Confidence BETWEEN 0 AND 100 THEN Confidence END AS Confidence,
        CASE VehicleClass WHEN 2 THEN 'Motorcycle' WHEN 3 THEN 'Car' WHEN 6 THEN 'Truck' WHEN 7 THEN 'Bus'
             ELSE 'OtherVehicle' END AS VehicleCategory FROM vehicle_raw""",
    ),
    "traffic_agg": (
        ["traffic_clean"],
        "SELECT BucketTime, DeviceId, Lane, avg(NumVehicles) AS NumVehicles, "
        + ", ".join(wavg(c) for c in ["AvgSpeed", "Occupancy", "AvgDensity", "AvgHeadway"])
        + ", avg(FlowRate) AS FlowRate, count(*) AS TrafficRowsInKey FROM traffic_clean GROUP BY ALL",
    ),
    "medians": (
        ["traffic_agg"],
        "SELECT " + each(TRAFFIC, "coalesce(median({c}), 0) AS m_{c}") + " FROM traffic_agg",
    ),
    "traffic_obs": (
        ["traffic_agg", "medians"],
        "SELECT BucketTime, DeviceId, Lane, "
        + each(TRAFFIC, "coalesce({c}, m_{c}) AS {c}")
        + " FROM traffic_agg, medians",
    ),
    "vehicle_stats": (
        ["vehicle_clean"],
        """SELECT BucketTime, DeviceId, Lane, avg(TravelTimeSec) AS AvgTravelTime, median(Speed) AS MedianSpeed,
        stddev_pop(Speed) AS SpeedStd, avg(Confidence) AS MeanConfidence, count(*) AS VehicleRows,
        count(*) FILTER (WHERE VehicleCategory='Car') AS CarCount,
        count(*) FILTER (WHERE VehicleCategory='Truck') AS TruckCount,
        count(*) FILTER (WHERE VehicleCategory='Bus') AS BusCount,
        count(*) FILTER (WHERE VehicleCategory='Motorcycle') AS MotorcycleCount,
        count(*) FILTER (WHERE VehicleCategory='OtherVehicle') AS OtherVehicleCount
        FROM vehicle_clean GROUP BY ALL""",
    ),
    "vehicle_feat": (
        ["vehicle_stats"],
        "SELECT *, "
        + ", ".join(
            f"{c} / nullif({' + '.join(COUNT_COLS)}, 0) AS {r}" for c, r in zip(COUNT_COLS, RATIOS)
        )
        + " FROM vehicle_stats",
    ),
    "observed": (
        ["traffic_obs", "vehicle_feat"],
        "SELECT t.BucketTime, t.DeviceId, t.Lane, "
        + ", ".join((f"t.{c}" if c in TRAFFIC else f"CAST(v.{c} AS DOUBLE) AS {c}") for c in PROFILE_COLS)
        + " FROM traffic_obs t LEFT JOIN vehicle_feat v USING (BucketTime, DeviceId, Lane)",
    ),
    "span": (
        ["observed"],
        "SELECT time_bucket(INTERVAL '{G} seconds', min(BucketTime)) AS t0, "
        "time_bucket(INTERVAL '{G} seconds', max(BucketTime)) AS t1 FROM observed",
    ),
    "stamps": (
        ["span"],
        "SELECT unnest(generate_series(t0, t1, INTERVAL '{G} seconds')) AS BucketTime FROM span",
    ),
    "grid": (
        ["observed", "stamps"],
        """SELECT d.DeviceId, l.Lane, s.BucketTime FROM (SELECT DISTINCT DeviceId FROM observed) d,
        (SELECT DISTINCT Lane FROM observed) l, stamps s""",
    ),
    "cells": (
        ["grid", "observed"],
        "SELECT *, CAST(epoch(BucketTime) AS BIGINT) // {G} AS pos FROM grid "
        "LEFT JOIN observed USING (DeviceId, Lane, BucketTime)",
    ),
    "cells_n": (
        ["cells"],
        "SELECT *, " + ", ".join(neighbours(c) for c in PROFILE_COLS) + " FROM cells "
        + frames("DeviceId, Lane"),
    ),
    "line": (
        ["cells_n"],
        "SELECT DeviceId, Lane, BucketTime, NumVehicles IS NOT NULL AS seen, "
        + ", ".join(f"{interp(c, 12)} AS {c}" for c in PROFILE_COLS)
        + " FROM cells_n",
    ),
    "prof": (
        ["observed"],
        "SELECT DeviceId, Lane, CAST(hour(BucketTime) AS INTEGER) AS Hour, "
        + each(PROFILE_COLS, "avg({c}) AS {c}")
        + " FROM observed GROUP BY ALL",
    ),
    "gprof": (
        ["observed"],
        "SELECT CAST(hour(BucketTime) AS INTEGER) AS Hour, "
        + each(PROFILE_COLS, "avg({c}) AS {c}")
        + " FROM observed GROUP BY ALL",
    ),
    "filled": (
        ["line", "prof", "gprof"],
        "SELECT i.DeviceId, i.Lane, i.BucketTime, CASE WHEN seen THEN 'observed' "
        "WHEN i.NumVehicles IS NOT NULL THEN 'interpolated' ELSE 'profile' END AS fill_source, "
        + ", ".join(
            f"coalesce(i.{c}, p.{c}, g.{c}, {TRAFFIC_DEFAULTS[c]}) AS {c}" for c in PROFILE_COLS
        )
        + " FROM line i LEFT JOIN prof p ON p.DeviceId=i.DeviceId AND p.Lane=i.Lane "
        "AND p.Hour=hour(i.BucketTime) LEFT JOIN gprof g ON g.Hour=hour(i.BucketTime)",
    ),
    "weather_mean": (
        ["weather_raw"],
        "SELECT BucketTime, " + each(WEATHER_COLS, "avg({c}) AS {c}") + " FROM weather_raw GROUP BY ALL",
    ),
    "weather_n": (
        ["stamps", "weather_mean"],
        "SELECT *, " + ", ".join(neighbours(c) for c in WEATHER_COLS)
        + " FROM (SELECT *, CAST(epoch(BucketTime) AS BIGINT) // {G} AS pos FROM stamps "
        "LEFT JOIN weather_mean USING (BucketTime)) " + frames(""),
    ),
    "weather": (
        ["weather_n"],
        "SELECT BucketTime, "
        + ", ".join(
            f"coalesce({interp(c, None)}, {WEATHER_DEFAULTS[c]}) AS {c}" for c in WEATHER_COLS
        )
        + " FROM weather_n",
    ),
    # class counts by largest remainder, over the filled table
    "lrm": (
        ["filled"],
        """SELECT *, [r1*n/s, r2*n/s, r3*n/s, r4*n/s, r5*n/s] AS unused FROM (SELECT *,
        round_even(floor(NumVehicles * CAST(1e9 AS DOUBLE) + 0.5) / CAST(1e9 AS DOUBLE), 0) AS n, CarRatio AS r1, TruckRatio AS r2, BusRatio AS r3, MotorcycleRatio AS r4,
        greatest(0.0, least(1.0, 1.0 - (CarRatio + TruckRatio + BusRatio + MotorcycleRatio))) AS r5,
        CarRatio + TruckRatio + BusRatio + MotorcycleRatio
          + greatest(0.0, least(1.0, 1.0 - (CarRatio + TruckRatio + BusRatio + MotorcycleRatio))) AS s FROM filled)""",
    ),
    "lrm_parts": (
        ["lrm"],
        "SELECT *, " + ", ".join(
            f"floor(r{i}/s*n) AS f{i}, floor((r{i}/s*n - floor(r{i}/s*n)) * CAST(1e9 AS DOUBLE) + 0.5) AS x{i}" for i in range(1, 6)
        ) + " FROM lrm",
    ),
    "counted": (
        ["lrm_parts"],
        "SELECT DeviceId, Lane, BucketTime, fill_source, n AS NumVehicles, "
        + each([c for c in PROFILE_COLS if c not in COUNT_COLS + RATIOS + ["NumVehicles"]], "{c}")
        + ", "
        + ", ".join(
            f"f{i} + CASE WHEN "
            + " + ".join(
                f"CAST(x{j} {'>=' if j < i else '>'} x{i} AS INTEGER)" for j in range(1, 6) if j != i
            )
            + f" < n - (f1+f2+f3+f4+f5) THEN 1 ELSE 0 END AS {c}"
            for i, c in enumerate(COUNT_COLS, 1)
        )
        + " FROM lrm_parts",
    ),
    # hourly (or any step) device series of the interval feed with weather of the same step
    "dev": (
        ["traffic_obs"],
        "SELECT DeviceId, BucketTime, " + each(TRAFFIC, "avg({c}) AS {c}")
        + " FROM traffic_obs GROUP BY ALL",
    ),
    "dev_span": (
        ["dev"],
        "SELECT DeviceId, min(BucketTime) AS t0, max(BucketTime) AS t1 FROM dev GROUP BY ALL",
    ),
    "dev_index": (
        ["dev_span"],
        "SELECT DeviceId, unnest(generate_series(t0, t1, INTERVAL '{G} seconds')) AS BucketTime FROM dev_span",
    ),
    "dev_freq": (
        ["dev_index", "dev", "weather_mean"],
        "SELECT * FROM dev_index LEFT JOIN dev USING (DeviceId, BucketTime) LEFT JOIN weather_mean USING (BucketTime)",
    ),
    "series": (
        ["dev_freq"],
        "SELECT DeviceId, BucketTime, "
        + each(
            TRAFFIC + WEATHER_COLS,
            "coalesce(first_value({c} IGNORE NULLS) OVER a, last_value({c} IGNORE NULLS) OVER b, 0) AS {c}",
        )
        + " FROM dev_freq " + frames("DeviceId"),
    ),
}


def sql(body: str, *names: str, grain: int = 300, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the CTEs it needs."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][0]:
            need(dep)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in wanted]
    parts += [f"{n} AS ({text})" for n, text in (extra or {}).items()]
    text = (f"WITH {', '.join(parts)} " if parts else "") + body
    return text.replace("{G}", str(grain))
