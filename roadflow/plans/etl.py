"""The ETL job: three feeds to one dense, gap-free, 41-column table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.apportion import largest_remainder
from ..functions.calendar import calendar, floor_to, step_seconds
from ..functions.columns import one_row
from ..operators import aggregates as A
from ..operators import clean as K
from ..operators import joins as J
from ..operators import timeseries as T
from ..operators.dedup import dedup_counts, dedup_rows, dup_key_stats
from ..operators.validate import key_overlap, quality_checks
from ..schemas import (
    COUNT_COLS, FINAL_COLS, KEYS, PROFILE_COLS, RATIO_COLS, SERIES, TRAFFIC_DEFAULTS, TRAFFIC_METRICS,
    WEATHER_COLS, WEATHER_DEFAULTS,
)
from ..session import shuffle_partitions, stage

# A weather row per step is broadcast up to this many rows (about 55 MB of doubles).
BROADCAST_STEPS = 1_000_000
# Dense rows per partition of the grid.
CELLS_PER_PARTITION = 500_000


# Measures that are null in the same rows of the observed table: imputed traffic measures
# never are, counts and shares follow the vehicle match, median and spread the speeds.
NULL_TOGETHER = [TRAFFIC_METRICS, COUNT_COLS + RATIO_COLS, ["MedianSpeed", "SpeedStd"]]


@dataclass(frozen=True)
class EtlOptions:
    step: str = "5 minutes"
    interval_type: int | None = 5
    align: str | None = None  # floor stamps to this before use; None keeps minutes
    observed_pairs_only: bool = False
    gap_limit: int = 12
    max_gap: int | None = None
    hot_rows: int | None = A.HOT_ROWS


def traffic_keys(feed: DataFrame, o: EtlOptions = EtlOptions()) -> DataFrame:
    """One row per key of the interval feed, nulls still open."""
    cols = ["Id", "BucketTime", "DeviceId", "NodeId", "Lane", "IntervalType", *TRAFFIC_METRICS]
    raw = feed.select(*cols)
    rows = dedup_rows(raw, "Id", last=K.lacks_key(raw, align=o.align))
    return A.traffic_by_key(K.clean_traffic(rows, o.interval_type, o.align))


def vehicle_keys(feed: DataFrame, o: EtlOptions = EtlOptions()) -> DataFrame:
    cols = ["Id", "Plate", "BucketTime", "DeviceId", "NodeId", "Lane", "VehicleClass", "Speed",
            "TravelTimeSec", "Confidence"]
    # Hot keys are looked for in the raw feed's key columns: duplicates only overstate them.
    keys = K.normalize_keys(feed.select("BucketTime", "DeviceId", "NodeId", "Lane"), align=o.align)
    hot = None if o.hot_rows is None else A.hot_groups(keys, KEYS, o.hot_rows)
    raw = feed.select(*cols)
    rows = dedup_rows(raw, "Id", last=K.lacks_key(raw, align=o.align))
    return A.vehicle_features(K.clean_vehicle(rows, o.align), hot=hot)


def observed_table(traffic: DataFrame, vehicle: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Traffic keys with imputed measures and the vehicle features of matched keys; a repeated key ends the job.

    ``counts`` learns the joined, matched and unmatched rows when the table is computed.
    """
    filled = A.median_impute(traffic.select(*KEYS, *TRAFFIC_METRICS))
    return J.with_match(filled, vehicle, KEYS, "left", "one_to_one", counts).select(
        *KEYS, *[F.col(c).cast("double").alias(c) for c in PROFILE_COLS]
    )


def weather_table(feed: DataFrame, grid: DataFrame, o: EtlOptions) -> DataFrame:
    """Station means on every step, interpolated without limit, constants where empty.

    The window has no partition key: it runs over one row per step, a clock-bounded size.
    """
    means = A.weather_by_time(K.clean_weather(feed, o.align))
    dense = grid.join(means, "BucketTime", "left")
    line = T.interpolate(dense, WEATHER_COLS, [], o.step, None)
    return K.fill_constants(line, WEATHER_DEFAULTS)


def fill_grid(observed: DataFrame, o: EtlOptions, partitions: int | None = None) -> DataFrame:
    """Dense grid with observed, interpolated or profile values and their ``fill_source``.

    Profiles meet segments that are cut at full hours, a tenth of the cells at five minutes, before these explode.
    """
    runs = T.by_hour(T.segments(observed, PROFILE_COLS, o.step, o.observed_pairs_only, partitions, NULL_TOGETHER), o.step)
    both = J.attach_profiles(runs, A.hourly_profile(observed), A.global_hourly_profile(observed), hour=F.col("Hour"))
    usual = {c: F.coalesce(F.col("_own")[c], F.col("_all")[c], F.lit(TRAFFIC_DEFAULTS[c])) for c in PROFILE_COLS}
    known = both.withColumns({f"_usual_{c}": v for c, v in usual.items()}).drop("_own", "_all", "Hour")
    line = T.cells(
        known, PROFILE_COLS, o.step, o.gap_limit, o.max_gap, NULL_TOGETHER, {c: F.col(f"_usual_{c}") for c in PROFILE_COLS}
    )
    source = F.when(F.coalesce("_known", F.lit(False)), "observed").when(F.col("_filled"), "interpolated").otherwise("profile")
    return line.select(*SERIES, "BucketTime", source.alias("fill_source"), *PROFILE_COLS)


def finish(filled: DataFrame, weather: DataFrame, broadcast_weather: bool = False) -> DataFrame:
    """Integer class counts, calendar, weather and rolling columns.

    Calendar columns come with the weather of a step, worked out once; a stamp without weather has its own.
    """
    counted = largest_remainder(filled)
    counted = counted.withColumns({c: F.col(c).cast("double") for c in ["NumVehicles", *COUNT_COLS]})
    rolled = T.rolling(counted, ["NumVehicles", "AvgSpeed"], SERIES)
    days = calendar("BucketTime")
    steps = weather.withColumns({f"_{c}": v for c, v in days.items()})
    joined = J.join_weather(rolled, steps, broadcast_weather, [f"_{c}" for c in days])
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), v) for c, v in days.items()}).select(*FINAL_COLS, "fill_source")


@dataclass(frozen=True)
class EtlResult:
    final: DataFrame  # the 41 columns and fill_source
    traffic: DataFrame
    vehicle: DataFrame
    observed: DataFrame
    join_counts: dict  # rows, both, left_only of the join of traffic and vehicle keys

    @property
    def processed(self) -> DataFrame:
        return self.final.select(*FINAL_COLS)


def build(
    traffic: DataFrame, vehicle: DataFrame, weather: DataFrame, o: EtlOptions = EtlOptions()
) -> EtlResult:
    """Run the reductions of the raw feeds once, then declare the dense table.

    The per-key tables are staged: each is read by several branches (median, profiles,
    grid bounds, fill) and is far smaller than its feed. Three scalars - devices, lanes and
    the span - size the grid's partitions and decide whether weather may be broadcast.
    """
    spark = traffic.sparkSession
    t = stage(traffic_keys(traffic, o), "traffic-keys")
    v = vehicle_keys(vehicle, o)
    counts = Observation("traffic-vehicle")
    observed = stage(observed_table(t, v, counts), "observed")
    size = observed.agg(
        floor_to(F.min("BucketTime"), o.step).alias("t0"),
        floor_to(F.max("BucketTime"), o.step).alias("t1"),
        F.approx_count_distinct("DeviceId").alias("devices"),
        F.approx_count_distinct("Lane").alias("lanes"),
    ).first()
    steps = 0
    if size["t0"] is not None:
        steps = int((size["t1"] - size["t0"]).total_seconds()) // step_seconds(o.step) + 1
    cells = size["devices"] * size["lanes"] * steps
    partitions = max(shuffle_partitions(spark), cells // CELLS_PER_PARTITION)
    filled = fill_grid(observed, o, partitions)
    table = weather_table(weather, T.time_grid(observed, o.step), o)
    return EtlResult(finish(filled, table, steps <= BROADCAST_STEPS), t, v, observed, counts.get)


def etl_report(
    traffic: DataFrame, vehicle: DataFrame, result: EtlResult, o: EtlOptions = EtlOptions()
) -> DataFrame:
    """Counters of the whole run as one row (every part is a one-row aggregate)."""
    cols_t = ["Id", "BucketTime", "DeviceId", "NodeId", "Lane", "IntervalType", *TRAFFIC_METRICS]
    raw_t = traffic.select(*cols_t)
    kept = K.normalize_keys(
        K.filter_interval(K.coerce_numeric(dedup_rows(raw_t, last=K.lacks_key(raw_t, align=o.align)), ["IntervalType"]), o.interval_type),
        align=o.align,
    )
    prefix = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    parts = [
        prefix(dedup_counts(raw_t), "traffic"),
        kept.agg(
            F.count(F.lit(1)).alias("traffic_rows_of_interval"),
            F.count_if(
                F.col("BucketTime").isNull() | F.col("DeviceId").isNull() | F.col("Lane").isNull()
            ).alias("traffic_rows_missing_key"),
        ),
        prefix(dup_key_stats(K.drop_null_keys(kept), KEYS), "traffic"),
        prefix(dedup_counts(vehicle), "vehicle"),
        key_overlap(result.traffic, result.vehicle),
        result.final.agg(
            F.count(F.lit(1)).alias("final_rows"),
            *[
                F.count_if(F.col("fill_source") == s).alias(f"rows_{s}")
                for s in ("observed", "interpolated", "profile")
            ],
        ),
        quality_checks(result.final),
    ]
    facts = {f"_{i}": one_row(part) for i, part in enumerate(parts[1:])}
    return parts[0].withColumns(facts).select(*parts[0].columns, *[f"{name}.*" for name in facts])
