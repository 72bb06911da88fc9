"""Queries of the projection, cleaning, de-duplication and validation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as Cal
from ..functions import columns as C
from ..operators import clean as K
from ..operators import dedup as D
from ..operators import validate as V
from ..schemas import COUNT_COLS, KEYS, RATIO_COLS, TRAFFIC_DEFAULTS, TRAFFIC_METRICS, VALID_RANGES
from ..sources import sample_feeds as S
from . import inputs as I
from .registry import query, rounded
from .sqltext import each, sql

H = I.HOUR_S


@query(
    "normalize_key",
    sql(
        """SELECT event_id, CASE WHEN k NOT IN ('', 'NAN', 'NONE') THEN k END AS node FROM (
        SELECT event_id, upper(trim(CASE kk % 6 WHEN 0 THEN ' n1 ' WHEN 1 THEN 'nan' WHEN 2 THEN '  '
        WHEN 3 THEN 'None' WHEN 4 THEN NULL ELSE event_type END)) AS k FROM ev)""",
        "ev",
    ),
)
def normalize_key(spark, d):
    k = F.col("kk") % 6
    raw = (
        F.when(k == 0, " n1 ").when(k == 1, "nan").when(k == 2, "  ").when(k == 3, "None")
        .when(k == 4, F.lit(None)).otherwise(F.col("event_type"))
    )
    return S.events(spark, d).select("event_id", C.normalize_key(raw).alias("node"))


@query(
    "normalize_lane",
    sql(
        """SELECT 'numeric' AS feed, CAST(kk % 3 AS VARCHAR) AS Lane, count(*) AS n FROM ev GROUP BY ALL
        UNION ALL SELECT 'mixed', CASE WHEN event_type='error' THEN 'BUS' WHEN event_type <> 'view'
        THEN CAST(kk % 3 AS VARCHAR) END, count(*) FROM ev GROUP BY ALL""",
        "ev",
    ),
)
def normalize_lane(spark, d):
    ev = S.events(spark, d)
    lane = (F.col("kk") % 3).cast("string")
    mixed = F.when(F.col("event_type") == "error", " bus").when(F.col("event_type") != "view", lane)
    one = K.normalize_lane(ev.select(F.lit("numeric").alias("feed"), F.concat(lane, F.lit(".0")).alias("Lane")))
    two = K.normalize_lane(ev.select(F.lit("mixed").alias("feed"), mixed.alias("Lane")))
    return one.unionByName(two).groupBy("feed", "Lane").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_bucket_time",
    sql(
        """SELECT event_id, date_trunc('minute', CASE kk % 4 WHEN 0 THEN date_trunc('second', ts)
        WHEN 1 THEN date_trunc('second', ts) + INTERVAL 7 HOUR WHEN 2 THEN NULL
        ELSE date_trunc('second', ts) + INTERVAL 2 HOUR END) AS BucketTime FROM ev""",
        "ev",
    ),
)
def parse_bucket_time(spark, d):
    k = F.col("kk") % 4
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(k == 0, text).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, "not a time")
        .otherwise(F.concat(iso, F.lit("+0500")))
    )
    return S.events(spark, d).select("event_id", Cal.parse_bucket_time(raw).alias("BucketTime"))


@query(
    "coerce_numeric",
    sql(
        """SELECT event_id, CASE kk % 4 WHEN 0 THEN kk + CAST(0.5 AS DOUBLE) WHEN 3 THEN "value" END AS number
        FROM ev""",
        "ev",
    ),
)
def coerce_numeric(spark, d):
    k = F.col("kk") % 4
    raw = (
        F.when(k == 0, F.concat(F.col("kk").cast("string"), F.lit(".5"))).when(k == 1, "12,5 km/h")
        .when(k == 2, "").otherwise(F.col("value").cast("string"))
    )
    return K.coerce_numeric(S.events(spark, d).select("event_id", raw.alias("number")), ["number"])


@query(
    "clean_traffic",
    sql(f"SELECT Id, BucketTime, DeviceId, Lane, {each(TRAFFIC_METRICS, '{c}')} FROM traffic_clean",
        "traffic_clean"),
)
def clean_traffic(spark, d):
    return I.traffic_clean(spark, d, I.FIVE).select("Id", *KEYS, *TRAFFIC_METRICS)


@query(
    "clean_vehicle",
    sql("SELECT Id, BucketTime, DeviceId, Lane, Speed, TravelTimeSec, Confidence, VehicleCategory "
        "FROM vehicle_clean", "vehicle_clean"),
)
def clean_vehicle(spark, d):
    return I.vehicle_clean(spark, d, I.FIVE).select(
        "Id", *KEYS, "Speed", "TravelTimeSec", "Confidence", "VehicleCategory"
    )


@query(
    "filter_interval",
    sql("""SELECT count(*) FILTER (WHERE IntervalType = 5) AS kept,
        count(*) FILTER (WHERE IntervalType <> 5) AS removed FROM traffic_raw""", "traffic_raw"),
)
def filter_interval(spark, d):
    feed = S.traffic_feed(spark, d)
    kept = K.filter_interval(feed).agg(F.count(F.lit(1))).scalar()
    return feed.agg(F.count(F.lit(1)).alias("n")).select(
        kept.alias("kept"), (F.col("n") - kept).alias("removed")
    )


@query(
    "drop_null_keys",
    sql("""SELECT BucketTime, node AS DeviceId, Lane, count(*) AS n FROM (SELECT BucketTime, Lane,
        CASE WHEN Occupancy = 7 THEN NULL ELSE upper(trim(NodeId)) END AS node FROM traffic_raw)
        WHERE node IS NOT NULL GROUP BY ALL""", "traffic_raw", grain=H),
)
def drop_null_keys(spark, d):
    gaps = S.traffic_feed(spark, d, I.HOUR).withColumn(
        "NodeId", F.when(F.col("Occupancy") == 7, F.lit("none")).otherwise(F.col("NodeId"))
    )
    kept = K.drop_null_keys(K.normalize_keys(gaps))
    return kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query(
    "negatives_to_null",
    sql("SELECT Id, " + each(TRAFFIC_METRICS, "CASE WHEN {c} >= 0 THEN {c} END AS {c}") + " FROM traffic_raw",
        "traffic_raw"),
)
def negatives_to_null(spark, d):
    return K.negatives_to_null(S.traffic_feed(spark, d)).select("Id", *TRAFFIC_METRICS)


@query(
    "range_to_null",
    sql("SELECT Id, " + ", ".join(
        f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}" for c, (lo, hi) in VALID_RANGES.items()
    ) + " FROM vehicle_raw", "vehicle_raw"),
)
def range_to_null(spark, d):
    return K.range_to_null(S.vehicle_feed(spark, d)).select("Id", *VALID_RANGES)


@query(
    "range_violations",
    sql("SELECT " + ", ".join(
        f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS {c}" for c, (lo, hi) in VALID_RANGES.items()
    ) + " FROM vehicle_raw", "vehicle_raw"),
)
def range_violations(spark, d):
    return K.range_violations(S.vehicle_feed(spark, d))


@query(
    "vehicle_category",
    sql("""SELECT code, CASE CAST(round_even(code, 0) AS INTEGER) WHEN 2 THEN 'Motorcycle' WHEN 3 THEN 'Car'
        WHEN 6 THEN 'Truck' WHEN 7 THEN 'Bus' ELSE 'OtherVehicle' END AS VehicleCategory, count(*) AS n
        FROM (SELECT CASE WHEN kk <> 9 THEN CAST(kk % 18 AS DOUBLE) / 2 END AS code FROM ev) GROUP BY ALL""",
        "ev"),
)
def vehicle_category(spark, d):
    code = F.when(F.col("kk") != 9, F.col("kk") % 18 / 2)
    coded = K.with_category(S.events(spark, d).select(code.alias("VehicleClass")))
    return coded.groupBy(F.col("VehicleClass").alias("code"), "VehicleCategory").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "fill_constants",
    sql("SELECT BucketTime, DeviceId, Lane, " + ", ".join(
        f"round(coalesce({c}, {TRAFFIC_DEFAULTS[c]}), 8) AS {c}"
        for c in ["CarRatio", "AvgTravelTime", "MedianSpeed", "SpeedStd", "MeanConfidence", "CarCount"]
    ) + " FROM observed", "observed", grain=H),
)
def fill_constants(spark, d):
    cols = ["CarRatio", "AvgTravelTime", "MedianSpeed", "SpeedStd", "MeanConfidence", "CarCount"]
    open_cells = I.observed(spark, d).select(*KEYS, *[F.col(c).cast("double").alias(c) for c in cols])
    return rounded(K.fill_constants(open_cells))


@query(
    "class_ratios",
    sql("SELECT BucketTime, DeviceId, Lane, " + ", ".join(
        f"round(CASE WHEN total > 0 THEN {c} / total ELSE 0 END, 8) AS {r}" for c, r in zip(COUNT_COLS, RATIO_COLS)
    ) + " FROM (SELECT *, VehicleRows - 1 AS total FROM vehicle_stats)", "vehicle_stats", grain=H),
)
def class_ratios(spark, d):
    from ..functions.apportion import class_ratios as ratios

    counts = I.vehicle_feat(spark, d).withColumn("NumVehicles", F.col("VehicleRows") - 1)
    return rounded(ratios(counts).select(*KEYS, *RATIO_COLS))


@query(
    "time_slice",
    sql("""SELECT DeviceId, BucketTime, NumVehicles FROM dev WHERE BucketTime BETWEEN
        TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""".replace(
        "NumVehicles FROM", "round(NumVehicles, 8) AS NumVehicles FROM"), "dev", grain=H),
)
def time_slice(spark, d):
    from ..operators.aggregates import device_series

    dev = device_series(I.traffic_obs(spark, d), ["NumVehicles"])
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return rounded(
        dev.filter(F.col("BucketTime").between(at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00")))
    )


@query(
    "align_features",
    sql("""SELECT Id, coalesce(AvgSpeed, 0) AS AvgSpeed, coalesce(Occupancy, 0) AS Occupancy,
        CAST(0 AS DOUBLE) AS Hour_5, CAST(Lane AS DOUBLE) AS Lane FROM traffic_raw""", "traffic_raw"),
)
def align_features(spark, d):
    return K.align_features(
        S.traffic_feed(spark, d), ["AvgSpeed", "Occupancy", "Hour_5", "Lane"], keep=["Id"]
    )


@query("drop_pattern", sql("SELECT Id, BucketTime, AvgSpeed FROM traffic_raw", "traffic_raw"))
def drop_pattern(spark, d):
    """Calendar dummies dropped by name pattern."""
    feed = S.traffic_feed(spark, d).select("Id", "BucketTime", "AvgSpeed")
    return K.drop_matching(feed.withColumns(Cal.calendar_dummies("BucketTime")), "Hour_", "DoW_")


@query(
    "scalar_functions",
    sql("""SELECT event_id, upper(trim(' ' || event_type || ' ')) AS upper_key, substr(event_type, 1, 3) AS prefix,
        CAST(round_even(kk / 2.0, 0) AS BIGINT) AS half_even, CAST(floor("value") AS BIGINT) AS floor_v,
        abs("value" - 50) AS abs_v, sqrt("value") AS sqrt_v, least(greatest("value", 10.0), 90.0) AS clipped,
        CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS dd,
        CAST(hour(ts) AS INTEGER) AS h, CAST(isodow(ts) - 1 AS INTEGER) AS wd, CAST(ts AS DATE) AS date,
        strftime(ts, '%Y-%m-%d %H:%M') AS minute_text, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso_text,
        time_bucket(INTERVAL '300 seconds', ts) AS floor5, ts + INTERVAL 15 MINUTE AS plus15,
        abs("value" - kk) <= 1e-8 + 1e-5 * abs(CAST(kk AS DOUBLE)) AS is_close,
        list_contains(['click', 'view'], event_type) AS member, kk AS from_json,
        len(string_split('a,b,' || event_type, ',')) AS n_parts FROM ev""", "ev"),
)
def scalar_functions(spark, d):
    v = F.col("value")
    return S.events(spark, d).select(
        "event_id",
        C.normalize_key(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("upper_key"),
        F.substring("event_type", 1, 3).alias("prefix"),
        C.half_even(F.col("kk") / 2).alias("half_even"),
        F.floor(v).alias("floor_v"),
        F.abs(v - 50).alias("abs_v"),
        F.sqrt(v).alias("sqrt_v"),
        C.clip(v, 10.0, 90.0).alias("clipped"),
        F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("dd"),
        F.hour("ts").alias("h"), F.weekday("ts").alias("wd"), F.to_date("ts").alias("date"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute_text"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso_text"),
        Cal.floor_to("ts", "5 minutes").alias("floor5"),
        (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("plus15"),
        C.is_close(v, F.col("kk").cast("double")).alias("is_close"),
        F.col("event_type").isin("click", "view").alias("member"),
        F.from_json("props", "k INT")["k"].alias("from_json"),
        F.size(F.split(F.concat(F.lit("a,b,"), "event_type"), ",")).cast("long").alias("n_parts"),
    )


# --- duplicates and validation -------------------------------------------------

_COPIES = {
    "t2": "SELECT * FROM traffic_raw UNION ALL SELECT * FROM traffic_raw WHERE Lane = 2",
    "u": "SELECT DISTINCT * FROM t2",
}


@query("dedup_exact", sql("SELECT * FROM u", "traffic_raw", extra=_COPIES))
def dedup_exact(spark, d):
    return D.dedup_exact(S.with_copies(S.traffic_feed(spark, d)))


def _shared_ids(spark, d):
    """Readings whose id is shared by a user's events of the day; signups have none."""
    day = F.date_format("OccurDate", "yyyyMMdd")
    return S.vehicle_feed(spark, d).select(
        F.when(F.col("VehicleClass") != 7, F.concat("Plate", F.lit("-"), day)).alias("Id"),
        "OccurDate", "Plate", "VehicleClass", "Speed", "Confidence",
    )


_SHARED = {
    "s": "SELECT CASE WHEN VehicleClass <> 7 THEN Plate || '-' || strftime(OccurDate, '%Y%m%d') END AS Id, "
    "OccurDate, Plate, VehicleClass, Speed, Confidence FROM vehicle_raw"
}


@query(
    "dedup_id",
    sql("""SELECT Id, OccurDate, Plate, VehicleClass, Speed, Confidence FROM (SELECT *, row_number() OVER
        (PARTITION BY Id ORDER BY OccurDate, Plate, VehicleClass, Speed, Confidence) AS rn FROM s)
        WHERE Id IS NULL OR rn = 1""", "vehicle_raw", extra=_SHARED),
)
def dedup_id(spark, d):
    return D.dedup_id(_shared_ids(spark, d), "Id", ["OccurDate"])


@query(
    "dedup_counts",
    sql("""SELECT (SELECT count(*) FROM t2) AS rows_raw,
        (SELECT count(*) FROM t2) - (SELECT count(*) FROM u) AS exact_duplicates_removed,
        (SELECT count(*) - count(DISTINCT Id) FROM u WHERE Id IS NOT NULL) AS duplicate_ids_removed,
        (SELECT count(DISTINCT Id) + count(*) FILTER (WHERE Id IS NULL) FROM u) AS rows_after_raw_dedup""",
        "vehicle_raw", extra={
            **_SHARED, "t2": "SELECT * FROM s UNION ALL SELECT * FROM s WHERE VehicleClass = 3",
            "u": "SELECT DISTINCT * FROM t2"}),
)
def dedup_counts(spark, d):
    feed = _shared_ids(spark, d)
    return D.dedup_counts(feed.unionByName(feed.filter(F.col("VehicleClass") == 3)), "Id")


@query(
    "dup_key_stats",
    sql("""SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_key_rows,
        count(*) AS unique_keys FROM (SELECT count(*) AS n FROM traffic_clean
        GROUP BY BucketTime, DeviceId, Lane)""", "traffic_clean", grain=H),
)
def dup_key_stats(spark, d):
    return D.dup_key_stats(I.traffic_clean(spark, d), KEYS)


@query(
    "distinct_dims",
    sql("SELECT DISTINCT DeviceId, Lane, CAST(BucketTime AS DATE) AS Date FROM traffic_clean", "traffic_clean"),
)
def distinct_dims(spark, d):
    clean = I.traffic_clean(spark, d, I.FIVE).withColumn("Date", F.to_date("BucketTime"))
    return D.distinct_values(clean, "DeviceId", "Lane", "Date")


@query(
    "assert_unique",
    sql("SELECT BucketTime, DeviceId, Lane, TrafficRowsInKey, " + each(TRAFFIC_METRICS, "round({c}, 8) AS {c}")
        + " FROM traffic_agg", "traffic_agg", grain=I.HOUR_S),
)
def assert_unique(spark, d):
    """Aggregated keys pass the check and come back unchanged."""
    return rounded(D.assert_unique(I.traffic_agg(spark, d), KEYS, "traffic"))


@query(
    "null_profile",
    sql("SELECT *, " + " + ".join(TRAFFIC_METRICS) + " AS total_missing FROM (SELECT "
        + each(TRAFFIC_METRICS, "count(*) FILTER (WHERE {c} IS NULL) AS {c}") + " FROM traffic_clean)",
        "traffic_clean"),
)
def null_profile(spark, d):
    return V.null_profile(I.traffic_clean(spark, d, I.FIVE), TRAFFIC_METRICS)


@query(
    "class_code_counts",
    sql("""SELECT code, count(*) AS n FROM (SELECT CASE WHEN TravelTimeSec IS NOT NULL
        THEN CAST(round_even(VehicleClass, 0) AS INTEGER) END AS code FROM vehicle_raw) GROUP BY ALL""",
        "vehicle_raw"),
)
def class_code_counts(spark, d):
    feed = S.vehicle_feed(spark, d).withColumn(
        "VehicleClass", F.when(F.col("TravelTimeSec").isNotNull(), F.col("VehicleClass"))
    )
    return V.class_code_counts(feed)


