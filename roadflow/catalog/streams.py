"""Queries of the streaming jobs: files in, tables out, drained to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as K
from ..models import fit as M
from ..plans.features import model_features
from ..schemas import TARGET_REGRESSORS
from ..session import scratch_path, stage
from ..sources import sample_feeds as S
from ..streaming import ticks as R
from . import inputs as I
from .registry import query, rounded
from .sqltext import sql

TICKS = 12
_NAMES = TARGET_REGRESSORS["NumVehicles"]
# The last rows of every device as ticks, and the rows that each tick's history holds.
_PLACED = {"placed": f"""SELECT DeviceId, BucketTime, NumVehicles AS y, {', '.join(_NAMES)},
    {', '.join(f'coalesce(lag({c}) OVER w, {c}) AS {c}_lag1' for c in _NAMES)},
    row_number() OVER (PARTITION BY DeviceId ORDER BY BucketTime DESC) AS rn FROM series
    WINDOW w AS (PARTITION BY DeviceId ORDER BY BucketTime)"""}
_TICKS_SQL = sql("SELECT DeviceId, BucketTime, " + ", ".join(f"round({c}, 8) AS {c}" for c in ["y", *[f"{c}_lag1" for c in _NAMES], *_NAMES])
                 + f" FROM placed WHERE rn <= {TICKS}", "series", grain=I.HOUR_S, extra=_PLACED)
_HISTORY_SQL = sql(f"""SELECT a.DeviceId, a.BucketTime, strftime(b.BucketTime, '%Y-%m-%d %H:%M') AS "time", round(b.y, 8) AS actual
    FROM placed a JOIN placed b ON b.DeviceId = a.DeviceId AND b.rn >= a.rn AND b.rn < a.rn + {R.KEEP} WHERE a.rn <= {TICKS}""",
                   "series", grain=I.HOUR_S, extra=_PLACED)


def _prepared(spark, d, order=(2, 0, 1)):
    """Models of everything but the last 12 rows, those rows as tick files in time order, their schema and files of a batch."""
    series = stage(I.series(spark, d), "series")
    rows = stage(M.training_rows(model_features(series, "NumVehicles")), "design")
    models, full = M.fit_models(rows, "NumVehicles", order=order, window=(TICKS + 1, M.EVERYTHING), name="train")
    seed = M.tails_before(full, TICKS).withColumnsRenamed({"y_tail": "seed_y", "e_tail": "seed_e"})
    models = stage(models.join(seed, "DeviceId"), "stream-models")
    raw = series.select("DeviceId", "BucketTime", *TARGET_REGRESSORS["NumVehicles"])
    names = [f"{c}_lag1" for c in TARGET_REGRESSORS["NumVehicles"]]
    last = rows.filter(F.col("rn") <= TICKS).select("DeviceId", "BucketTime", "y", *names, "rn")
    ticks = stage(last.join(raw, ["DeviceId", "BucketTime"]), "last-rows")
    path = scratch_path(spark, "ticks")
    files = R.write_replay(ticks, path, TICKS, 3)
    return models, path, ticks.drop("rn").schema, files


def _forecast_stream(spark, d, order=(2, 0, 1)):
    models, path, schema, files = _prepared(spark, d, order)
    base = R.with_future_base(R.tick_stream(spark, path, schema, files), models, "NumVehicles", I.HOUR)
    return R.extend_and_forecast(base, I.HOUR)


@query("stream_ticks", _TICKS_SQL)
def stream_ticks(spark, d):
    _, path, schema, files = _prepared(spark, d)
    return rounded(R.run_to_table(R.tick_stream(spark, path, schema, files), "replayed"))


@query("stream_extend")
def stream_extend(spark, d):
    out = R.run_to_table(_forecast_stream(spark, d), "extended")
    return out.select("DeviceId", "BucketTime", "tick", "residual", F.size("history").alias("history_rows"))


@query("stream_forecast")
def stream_forecast(spark, d):
    out = R.run_to_table(_forecast_stream(spark, d), "forecast")
    return out.select("DeviceId", "BucketTime", F.posexplode("forecast").alias("step", "predicted"))


@query("stream_history", _HISTORY_SQL)
def stream_history(spark, d):
    """The sliding history of every tick: what the state holds equals the rows up to the tick."""
    out = R.run_to_table(_forecast_stream(spark, d), "history")
    return rounded(out.select("DeviceId", "BucketTime", F.explode("history").alias("_h")).select("DeviceId", "BucketTime", "_h.*"))


@query("stream_horizons")
def stream_horizons(spark, d):
    return R.horizon_snapshot(R.run_to_table(_forecast_stream(spark, d), "horizons"))


@query("stream_latest_doc")
def stream_latest_doc(spark, d):
    path = scratch_path(spark, "latest")
    stream = _forecast_stream(spark, d)
    R.latest_documents(stream, path)
    return R.read_documents(spark, path, stream.schema)


@query("stream_append", _TICKS_SQL)
def stream_append(spark, d):
    _, path, schema, files = _prepared(spark, d)
    return rounded(R.append_history(R.tick_stream(spark, path, schema, 2 * files)))


@query(
    "stream_resample",
    sql("""SELECT DeviceId, Lane, BucketTime, round(NumVehicles, 8) AS NumVehicles, round(AvgSpeed, 8) AS AvgSpeed FROM (
        SELECT DeviceId, Lane, time_bucket(INTERVAL 5 MINUTE, BucketTime) AS BucketTime, avg(NumVehicles) AS NumVehicles,
        avg(AvgSpeed) AS AvgSpeed FROM traffic_clean GROUP BY ALL)
        WHERE BucketTime + INTERVAL 5 MINUTE <= (SELECT max(BucketTime) - INTERVAL 1 HOUR FROM traffic_clean)""",
        "traffic_clean", grain=60),
)
def stream_resample(spark, d):
    """Five-minute means of the interval feed as a stream; equals the batch on closed windows."""
    feed = K.clean_traffic(S.traffic_feed(spark, d, "1 minute"))
    path = scratch_path(spark, "feed")
    feed.select("Id", "DeviceId", "Lane", F.col("BucketTime").alias("ts"), "NumVehicles", "AvgSpeed").write.parquet(path)
    stream = R.tick_stream(spark, path, spark.read.parquet(path).schema)
    return rounded(R.run_to_table(R.resample_stream(stream, ["NumVehicles", "AvgSpeed"]), "resampled"))


