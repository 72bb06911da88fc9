"""Queries of the sources and sinks: every one writes, then reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as K
from ..plans import etl
from ..schemas import FINAL_COLS, KEYS, STRICT_COLS, TRAFFIC_METRICS, WEATHER_COLS
from ..session import scratch_path
from ..sources import configs, feeds, sinks
from ..sources import sample_feeds as S
from . import etl as E
from . import inputs as I
from .registry import query, rounded
from .sqltext import each, sql


def _through_csv(spark, df, kind):
    """The feed written as CSV and scanned again with the feed's schema."""
    path = scratch_path(spark, kind)
    sinks.write_csv(df, path)
    return feeds.read_feed(spark, kind, path)


@query(
    "scan_traffic",
    sql("SELECT Id, BucketTime, trim(NodeId) AS NodeId, Lane, IntervalType, " + each(TRAFFIC_METRICS, "{c}")
        + " FROM traffic_raw", "traffic_raw"),
)
def scan_traffic(spark, d):
    """A file without the OccurDate and Confidence columns: they read as null."""
    feed = S.traffic_feed(spark, d).drop("OccurDate", "Confidence")
    back = _through_csv(spark, feed, "traffic")
    return K.coerce_numeric(back, TRAFFIC_METRICS).select(
        "Id", K.bucket_time(back, None).alias("BucketTime"), F.trim("NodeId").alias("NodeId"),
        F.col("Lane").cast("int").alias("Lane"), F.col("IntervalType").cast("int").alias("IntervalType"),
        *TRAFFIC_METRICS,
    )


@query(
    "scan_vehicle",
    sql("SELECT Id, Plate, BucketTime, Lane, VehicleClass, Speed, TravelTimeSec, VehicleColor FROM vehicle_raw",
        "vehicle_raw"),
)
def scan_vehicle(spark, d):
    back = _through_csv(spark, S.vehicle_feed(spark, d), "vehicle")
    typed = K.coerce_numeric(back, ["VehicleClass", "Speed", "TravelTimeSec"])
    return typed.select(
        "Id", "Plate", K.bucket_time(back, None).alias("BucketTime"), F.col("Lane").cast("int").alias("Lane"),
        "VehicleClass", "Speed", "TravelTimeSec", "VehicleColor",
    )


@query("scan_weather", sql("SELECT BucketTime, " + each(WEATHER_COLS, "{c}") + " FROM weather_raw", "weather_raw"))
def scan_weather(spark, d):
    return K.clean_weather(_through_csv(spark, S.weather_feed(spark, d), "weather"))


@query("newest_file", sql("SELECT BucketTime, " + each(WEATHER_COLS, "{c}") + " FROM weather_raw", "weather_raw"))
def newest_file(spark, d):
    """Two deliveries of the weather feed; only the rows of the later one are read."""
    folder = scratch_path(spark, "drops")
    weather = S.weather_feed(spark, d)
    sinks.write_csv(weather.withColumn("Rain", F.lit(-1.0)), f"{folder}/first")
    sinks.write_csv(weather, f"{folder}/second")
    return K.clean_weather(feeds.read_feed(spark, "weather", feeds.newest_drop(spark, folder)))


@query(
    "load_processed",
    sql("SELECT DeviceId, Lane, count(*) AS n, min(BucketTime) AS first_seen, max(BucketTime) AS last_seen "
        "FROM counted GROUP BY ALL", "counted", grain=I.HOUR_S),
)
def load_processed(spark, d):
    path = scratch_path(spark, "processed")
    sinks.write_processed(I.etl_run(spark, d, I.HOUR).processed, path)
    return feeds.read_processed(spark, path).groupBy("DeviceId", "Lane").agg(
        F.count(F.lit(1)).alias("n"), F.min("BucketTime").alias("first_seen"),
        F.max("BucketTime").alias("last_seen"),
    )


def _csv_back(spark, d, write, columns):
    """The hourly table written as CSV, read back by name and typed as it was."""
    path = scratch_path(spark, "csv")
    final = I.etl_run(spark, d, I.HOUR).processed
    write(final, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == columns
    kinds = {f.name: f.dataType for f in final.schema.fields}
    return E.shown(back.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]))


@query("sink_csv", E.final_sql())
def sink_csv(spark, d):
    return _csv_back(spark, d, sinks.write_processed_csv, FINAL_COLS)


@query("sink_csv_strict", E.final_sql("OtherVehicleCount"))
def sink_csv_strict(spark, d):
    return _csv_back(spark, d, sinks.write_strict_csv, STRICT_COLS)


@query("sink_parquet", E.final_sql())
def sink_parquet(spark, d):
    path = scratch_path(spark, "parquet")
    sinks.write_processed(I.etl_run(spark, d, I.HOUR).processed, path)
    return E.shown(feeds.read_processed(spark, path))


@query("sink_report", E.REPORT_SQL)
def sink_report(spark, d):
    path = scratch_path(spark, "report")
    report = E.etl_report(spark, d)
    sinks.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


@query(
    "sink_class_map",
    sql("""SELECT 'low' AS mapping_confidence, string_agg(code, ',' ORDER BY code) AS codes, 'NodeId' AS effective_device_id_source, 5 AS traffic_interval_type_kept FROM (SELECT DISTINCT CAST(VehicleClass AS INTEGER) AS code
        FROM vehicle_clean WHERE VehicleClass NOT IN (2, 3, 6, 7))""", "vehicle_clean"),
)
def sink_class_map(spark, d):
    """The class-map document, written and read back, its codes found in the whole detection feed."""
    path = scratch_path(spark, "class-map")
    document = sinks.class_map(I.vehicle_clean(spark, d, I.FIVE))
    sinks.write_json(document, path)
    back = spark.read.schema(document.schema).json(path)
    return back.select("mapping_confidence", F.array_join("OtherVehicleClassCodesObserved", ",").alias("codes"),
                       "effective_device_id_source", "traffic_interval_type_kept")


def _audits(spark, d):
    path = scratch_path(spark, "audits")
    sinks.write_audits(I.traffic_obs(spark, d, I.FIVE), I.vehicle_feat(spark, d, I.FIVE), path)
    return path


@query(
    "audit_unmatched",
    sql("SELECT BucketTime, DeviceId, Lane, " + each(TRAFFIC_METRICS, "round({c}, 8) AS {c}") + ", TRUE AS VehicleDataMissing "
        "FROM traffic_obs ANTI JOIN vehicle_feat USING (BucketTime, DeviceId, Lane)", "traffic_obs", "vehicle_feat"),
)
def audit_unmatched(spark, d):
    """Traffic rows without detections, written as the audit file and read by its header."""
    schema = I.traffic_obs(spark, d, I.FIVE).select(*KEYS, *TRAFFIC_METRICS, F.lit(True).alias("VehicleDataMissing")).schema
    return rounded(feeds.read_csv(spark, f"{_audits(spark, d)}/unmatched", schema))


def _dirty(feed):
    """The feed as it may arrive: each reading also as a copy of its id without time and lane, and such
    rows without any id."""
    text = feed.select(*[F.col(c).cast("string").alias(c) for c in feed.columns])
    junk = text.withColumns({"BucketTime": F.lit(None).cast("string"), "Lane": F.lit(None).cast("string")})
    bad = text.withColumns({"BucketTime": F.lit("no time"), "Id": F.lit(None).cast("string")})
    return junk.unionByName(text).unionByName(bad)


@query("processed_from_csv", E.final_sql())
def processed_from_csv(spark, d):
    """The hourly table from text files with junk copies, bad stamps and two column orders."""
    def through_text(kind, feed):
        path = scratch_path(spark, kind)
        odd, even = (_dirty(feed).where(F.crc32(F.col("NodeId").cast("binary")) % 2 == k) for k in (0, 1))
        sinks.write_csv(odd, f"{path}/odd")
        sinks.write_csv(even.select(*reversed(even.columns)), f"{path}/even")
        return feeds.read_feed(spark, kind, [f"{path}/odd", f"{path}/even"])

    traffic = through_text("traffic", S.traffic_feed(spark, d, I.HOUR))
    vehicle = through_text("vehicle", S.vehicle_feed(spark, d, I.HOUR))
    weather = _through_csv(spark, S.weather_feed(spark, d, I.HOUR), "weather")
    final = etl.build(traffic, vehicle, weather, etl.EtlOptions(step=I.HOUR)).processed
    return E.shown(final.withColumn("Lane", F.col("Lane").cast("int")))


# --- configuration ---------------------------------------------------------------

_CFG_SQL = {
    "dv": "SELECT DISTINCT 'N' || CAST(user_id // 10 AS VARCHAR) AS DeviceId FROM ev",
    "cfg": """SELECT 'N' || CAST(user_id // 10 AS VARCHAR) AS DeviceId, CAST(max(kk) % 3 AS INTEGER) AS p,
    CASE WHEN max(user_id // 10) % 4 = 0 THEN NULL ELSE CAST(500 + min(kk) AS INTEGER) END AS train_length
    FROM ev GROUP BY ALL""",
}


def _node():
    return F.concat(F.lit("N"), F.floor(F.col("user_id") / 10).cast("string"))


def _config(spark, d):
    ev = S.events(spark, d)
    return ev.groupBy(_node().alias("DeviceId")).agg(
        (F.max("kk") % 3).cast("int").alias("p"),
        F.when(F.max(F.floor(F.col("user_id") / 10)) % 4 != 0, 500 + F.min("kk")).cast("int").alias("train_length"),
    )


@query(
    "config_merge",
    sql("SELECT DeviceId, coalesce(p, 1) AS p, coalesce(train_length, 1000) AS train_length FROM dv LEFT JOIN cfg "
        "USING (DeviceId)", "ev", extra=_CFG_SQL),
)
def config_merge(spark, d):
    devices = S.events(spark, d).select(_node().alias("DeviceId")).distinct()
    return configs.merge_config(devices, _config(spark, d), {"p": 1, "train_length": 1000})


@query(
    "config_document",
    sql("""SELECT DeviceId, CAST(CASE p WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE p END AS INTEGER) AS p, CAST(p = 2 AS INTEGER) AS d,
        CASE p WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS q, CAST(p = 1 AS INTEGER) AS sp, 0 AS sd, 0 AS sq,
        CASE WHEN p = 1 THEN 60 ELSE 0 END AS s, coalesce(train_length, 1000) AS train_length FROM cfg""", "ev", extra=_CFG_SQL),
)
def config_document(spark, d):
    """Orders written as documents, changed by a second version, read back and merged with the defaults."""
    folder = scratch_path(spark, "orders")
    rows = _config(spark, d)
    given = {"NumVehicles_order": F.when(F.col("p") > 0, F.format_string("[%d, 0, 0]", "p")),
             "NumVehicles_seasonal_order": F.when(F.col("p") == 1, F.lit("[1, 0, 0, 60]")),
             "NumVehicles_train_length": F.col("train_length").cast("string")}
    settings = F.create_map(*[x for name, value in given.items() for x in (F.lit(name), value)])
    own = rows.select("DeviceId", F.map_filter(settings, lambda k, v: v.isNotNull()).alias("settings"))
    fixed = {"NumVehicles_order": "[1, 0, 1]", "NumVehicles_train_length": "1000"}
    default = spark.createDataFrame([(None, fixed)], configs.CONFIG)
    configs.save(own.unionByName(default), folder)
    found = rows.filter("p = 2").select("DeviceId", F.create_map(F.lit("NumVehicles_order"), F.lit("[3, 1, 2]")).alias("settings"))
    configs.save(configs.put(configs.load(spark, folder), found), folder)
    return configs.orders(configs.effective(rows.select("DeviceId"), configs.load(spark, folder)), "NumVehicles")


@query(
    "config_upsert",
    sql("""SELECT DeviceId, p, train_length FROM cfg WHERE p <> 2 UNION ALL
        SELECT DeviceId, 9, 800 FROM cfg WHERE p = 2""", "ev", extra=_CFG_SQL),
)
def config_upsert(spark, d):
    config = _config(spark, d)
    changes = config.filter("p = 2").select("DeviceId", F.lit(9).alias("p"), F.lit(800).alias("train_length"))
    return configs.upsert_config(config, changes)


