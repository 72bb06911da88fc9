"""Structured Streaming jobs: tick replay, resampling, stateful forecasts, documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.calendar import is_holiday, step_seconds
from ..models import solve as S
from ..models.fit import WEIGHTS
from ..plans.features import regressor_names
from ..session import scratch_path

AHEAD = 24
KEEP = 24


def write_replay(ticks: DataFrame, path: str, rows: int, parts: int) -> int:
    """The last ``rows`` ticks of every device (``rn`` counts from the end) as files, a part of them at a time, oldest first.

    Files are read in the order of their writing. All ticks that a device has in a part lie in one file, so batches
    hold them in time order wherever they are cut. Returns the files of a part: with as many in a batch, the
    number of batches does not grow with the devices.
    """
    each = -(-rows // parts)
    for part in range(parts):
        high = rows - each * part
        now = ticks.filter(F.col("rn").between(max(high - each + 1, 1), high)).drop("rn")
        now.repartition("DeviceId").write.mode("append").parquet(path)
    return max(1, -(-len(ticks.sparkSession.read.schema(ticks.drop("rn").schema).parquet(path).inputFiles()) // parts))


def tick_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Tick rows from a folder of Parquet files, oldest file first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a Parquet table and read it; offsets and state are checkpointed."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def resample_stream(
    ticks: DataFrame, cols: list[str], step: str = "5 minutes", late: str = "1 hour"
) -> DataFrame:
    """Means per device, lane and step of a tick stream with an ``Id`` and an event time ``ts``.

    Repeated ids within the watermark are dropped. Windows are emitted once closed.
    """
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    once = timed.dropDuplicatesWithinWatermark(["Id"])
    return once.groupBy("DeviceId", "Lane", F.window("ts", step)).agg(
        *[F.avg(c).alias(c) for c in cols]
    ).select(
        "DeviceId", "Lane", F.col("window.start").cast("timestamp_ntz").alias("BucketTime"), *cols
    )


def with_future_base(ticks: DataFrame, models: DataFrame, target: str, step: str, ahead: int = AHEAD) -> DataFrame:
    """Each tick with its device's weights and the regression part of the next steps.

    ``xb`` holds const + beta . x for the tick itself and for every later step: the tick's
    regressors persist, the calendar moves on. Only this short array goes to the state.
    """
    names = regressor_names(target)
    lagged = [c for c in names if c.endswith("_lag1")]
    size = step_seconds(step)
    b = lambda name: F.col("beta")[names.index(name)]
    # Own values carry the tick's regressors; the next step sees the tick's raw values.
    now = F.col("const") + sum((b(c) * F.col(c) for c in lagged), F.lit(0.0))
    nxt = F.col("const") + sum((b(c) * F.col(c.removesuffix("_lag1")) for c in lagged), F.lit(0.0))
    hours = F.concat(F.array(F.lit(0.0)), F.slice("beta", names.index("Hour_1") + 1, 23))
    days = F.concat(F.array(F.lit(0.0)), F.slice("beta", names.index("DoW_1") + 1, 6))

    def moving(t):
        return (
            F.get(F.col("_hours"), F.hour(t)) + F.get(F.col("_days"), F.weekday(t))
            + b("IsHoliday") * is_holiday(t)
        )

    stamps = F.sequence(
        F.col("BucketTime"), F.col("BucketTime") + F.expr(f"INTERVAL '{size * ahead}' SECOND"),
        F.expr(f"INTERVAL '{size}' SECOND"),
    )
    joined = ticks.join(models.select("DeviceId", *WEIGHTS, "seed_y", "seed_e"), "DeviceId")
    based = joined.withColumns({"_hours": hours, "_days": days, "_now": now, "_next": nxt})
    xb = F.transform(
        stamps, lambda t, i: F.when(i == 0, F.col("_now")).otherwise(F.col("_next")) + moving(t)
    )
    return based.select("DeviceId", "BucketTime", "y", xb.alias("xb"), "w", "theta", "sigma2", "seed_y", "seed_e")


STATE = (
    "y array<double>, e array<double>, ahead array<double>, times array<string>, values array<double>, "
    "ticks bigint, last bigint"
)
OUTPUT = (
    "DeviceId string, BucketTime timestamp_ntz, tick bigint, residual double, forecast array<double>, "
    "history array<struct<time:string,actual:double>>"
)
#: Event time, in seconds behind the newest ticks, after which a silent device's state is dropped.
IDLE = 7 * 24 * 3600
LATE = "1 day"


def extend_and_forecast(base: DataFrame, step: str = "5 minutes", idle: int = IDLE, late: str = LATE) -> DataFrame:
    """Stateful model extension: each tick updates a device's lags and shocks, no refit.

    State per device is bounded: the lag buffer, a season of shocks, the last forecasts and the last 24
    points, seeded from the rows before the first tick. Every tick answers with the one-step residual,
    the next 24 steps and the sliding history.

    A tick that is not newer than the last one is late or repeated and changes nothing; of two ticks
    of one stamp in a batch the first counts. A skipped step enters the lags as it was forecast, without a
    shock, so later lags keep their distance. A device that stays ``idle`` seconds behind the watermark is
    forgotten and starts from its seed again.
    """
    size = step_seconds(step)
    gap = pd.Timedelta(seconds=size)
    label = lambda t: t.strftime("%Y-%m-%d %H:%M")

    def extend(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("BucketTime", kind="stable").drop_duplicates("BucketTime")
        if state.exists:
            y, e, ahead, times, values, ticks, last = state.get
            y, e, ahead, times, values = list(y), list(e), list(ahead), list(times), list(values)
        else:
            first = rows.iloc[0]
            y, e, ahead, ticks = first["seed_y"].tolist(), first["seed_e"].tolist(), [], 0
            times = [label(first["BucketTime"] - k * gap) for k in range(KEEP, 0, -1)]
            values, last = y[KEEP - 1 :: -1], int(first["BucketTime"].timestamp()) - size
        out = []
        for r in rows.to_dict("records"):
            now = int(r["BucketTime"].timestamp())
            if now <= last:
                continue
            skipped = min((now - last) // size - 1, len(y))
            for k in range(skipped):
                y = [ahead[min(k, len(ahead) - 1)] if ahead else y[0], *y[:-1]]
                e = [0.0, *e[:-1]]
            model = {k: r[k] for k in ("w", "theta", "sigma2")}
            xb = np.asarray(r["xb"])
            one = float(S.recurse(model, xb[:1], np.asarray(y), np.asarray(e))[0])
            e = [float(r["y"]) - one, *e[:-1]]
            y = [float(r["y"]), *y[:-1]]
            ticks, last = ticks + 1, now
            ahead = np.maximum(S.recurse(model, xb[1:], np.asarray(y), np.asarray(e)), 0.0).tolist()
            times = [*times, label(r["BucketTime"])][-KEEP:]
            values = [*values, float(r["y"])][-KEEP:]
            out.append(
                (key[0], r["BucketTime"], ticks, e[0], ahead,
                 [{"time": t, "actual": v} for t, v in zip(times, values)])
            )
        state.update((y, e, ahead, times, values, ticks, last))
        state.setTimeoutTimestamp(max(last * 1000, state.getCurrentWatermarkMs()) + idle * 1000)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])

    timed = base.withColumn("_event", F.col("BucketTime").cast("timestamp")).withWatermark("_event", late)
    return timed.groupBy("DeviceId").applyInPandasWithState(
        extend, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def horizon_snapshot(forecasts: DataFrame) -> DataFrame:
    at = lambda k: F.col("forecast")[k]
    return forecasts.select(
        "DeviceId", "BucketTime", at(0).alias("5m"), at(2).alias("15m"), at(5).alias("30m"), at(11).alias("60m")
    )


MANIFEST = "version long, slot int, run string, batch long, documents long"
#: Document sets that are kept; a reader has as many batches' time before its set is written over.
KEEP_SETS = 4


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, slot, run, batch, documents) of the complete document sets below ``path``, at most ``KEEP_SETS``."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def latest_documents(stream: DataFrame, path: str, checkpoint: str | None = None, keep: int = KEEP_SETS) -> None:
    """A JSON document set per batch: the newest tick of every device seen so far.

    Each batch merges its ticks with the current set, so a device that is silent keeps its document. Sets
    take turns in ``keep`` folders and a manifest line is written when a set is complete: what is stored and read
    stays the same however long the stream runs, and a writer that dies leaves the sets before it alone. A batch
    that comes again after its set was completed writes nothing.

    With ``checkpoint`` the stream goes on where it stopped. A stream with a checkpoint of its own starts from the
    set that is there. One stream at a time writes below ``path``.
    """
    if keep < 2:
        raise ValueError("two document sets at least: the current one is never written over")
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "latest-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        last = manifest(own, path).orderBy(F.desc("version")).first()
        if last and last["run"] == checkpoint and last["batch"] >= batch_id:
            return
        version = last["version"] + 1 if last else 0
        docs = batch.withColumn("batch", F.lit(version).cast("long"))
        if last:
            docs = docs.unionByName(own.read.schema(docs.schema).json(f"{path}/set={last['slot']}"))
        rest = F.struct(*[c for c in docs.columns if c != "DeviceId"])
        newest = docs.groupBy("DeviceId").agg(F.max_by(rest, F.struct("BucketTime", "batch")).alias("_l"))
        slot = version % keep
        newest.select("DeviceId", "_l.*").write.mode("overwrite").json(f"{path}/set={slot}")
        devices = own.read.schema("DeviceId string").json(f"{path}/set={slot}").count()
        line = own.createDataFrame([(version, slot, checkpoint, batch_id, devices)], MANIFEST)
        line.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/of={slot}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current document set below ``path``, empty before the first; ``schema`` is the stream's.

    ``batch`` numbers the set that a document was written with.
    """
    fields = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    last = manifest(spark, path).orderBy(F.desc("version")).first()
    if last is None:
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).json(f"{path}/set={last['slot']}")


def append_history(ticks: DataFrame, name: str = "history") -> DataFrame:
    """Append raw ticks to the history table, one file set per trigger."""
    return run_to_table(ticks, name)
