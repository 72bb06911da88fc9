"""Joins between feeds, grids, profiles, series and requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import add_steps, epoch, step_seconds
from ..schemas import KEYS, PROFILE_COLS, SERIES, WEATHER_COLS


# Sides whose keys may occur once only, by the name of the relation.
ONCE = {"one_to_one": ("left", "right"), "one_to_many": ("left",), "many_to_one": ("right",), "many_to_many": ()}


def checked_unique(df: DataFrame, keys: list[str] = KEYS, name: str = "table") -> DataFrame:
    """The same rows; the job fails when two of them share a key without nulls (those with nulls meet nothing).

    Rows are numbered inside their key, which needs the hashing and the order that a sort-merge join on the keys
    needs, so the check costs no scan and no shuffle of its own in front of one.
    """
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*keys))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    told = F.concat(F.lit(f"{name}: {', '.join(keys)} occurs more than once: "), F.to_json(F.struct(*keys)))
    bad = F.when((F.col("_once") > 1) & whole, F.raise_error(told).cast("boolean"))
    return df.withColumn("_once", n).filter(bad.isNull()).drop("_once")


def with_match(
    left: DataFrame, right: DataFrame, keys: list[str] = KEYS, how: str = "left", relation: str = "many_to_many",
    counts: Observation | None = None,
) -> DataFrame:
    """Equi-join with a ``match`` column: both / left_only (/ right_only for ``full``).

    ``relation`` names the sides whose keys must be unique; a repeated key ends the job. ``counts`` receives
    ``rows``, ``both``, ``left_only`` and ``right_only`` of the joined rows when they are first computed.
    """
    for side in ONCE[relation]:
        if side == "left":
            left = checked_unique(left, keys, "left side of the join")
        else:
            right = checked_unique(right, keys, "right side of the join")
    l, r = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    label = (
        F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    )
    out = l.join(r, keys, how).withColumn("match", label).drop("_l", "_r")
    if counts is None:
        return out
    kinds = [F.count_if(F.col("match") == kind).alias(kind) for kind in ("both", "left_only", "right_only")]
    return out.observe(counts, F.count(F.lit(1)).alias("rows"), *kinds)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return left.join(right, keys, "left_anti").withColumn("VehicleDataMissing", F.lit(True))


def matched(left: DataFrame, right: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return left.join(right, keys, "left_semi")


def _by_hour(df: DataFrame, by: list[str], cols: list[str], name: str) -> DataFrame:
    """Profile rows folded to an array of 24 structs per group, null for an hour without rows."""
    hours = F.map_from_entries(F.collect_list(F.struct("Hour", F.struct(*cols))))  # <= 24 entries
    day = F.sequence(F.lit(0), F.lit(23))
    return df.groupBy(*by).agg(hours.alias("_h")).select(
        *by, F.transform(day, lambda h: F.element_at("_h", h)).alias(name)
    )


def attach_profiles(
    grid: DataFrame, profile: DataFrame, overall: DataFrame, cols: list[str] = PROFILE_COLS, hour: Column | None = None
) -> DataFrame:
    """Device-lane-hour and hour-of-day profiles as structs ``_own`` and ``_all``.

    ``hour`` is the hour of day of a row, by default that of its ``BucketTime``.

    The device-lane profile is folded to one row of 24 hours, so the lookup joins on exactly
    the (DeviceId, Lane) a dense grid is hashed by and never moves it; whether the profile
    is broadcast is left to its measured size. The hour-of-day profile is one scalar.
    """
    own = _by_hour(profile, SERIES, cols, "_ph")
    everyone = _by_hour(overall, [], cols, "_gh").scalar()
    hour = F.hour("BucketTime") if hour is None else hour
    return grid.join(own, SERIES, "left").withColumns(
        {"_own": F.get("_ph", hour), "_all": F.get(everyone, hour)}
    ).drop("_ph")


def profile_lookup(
    grid: DataFrame, profile: DataFrame, overall: DataFrame, defaults: dict,
    cols: list[str] = PROFILE_COLS,
) -> DataFrame:
    """Expected value of every grid cell: own profile, hour profile, constant."""
    both = attach_profiles(grid, profile, overall, cols)
    return both.select(
        *grid.columns,
        *[
            F.coalesce(F.col("_own")[c], F.col("_all")[c], F.lit(defaults[c])).alias(c)
            for c in cols
        ],
    )


def grid_left_observed(grid: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed values on the dense grid, by equi-join (``densify`` does both without one)."""
    return grid.join(observed, SERIES + ["BucketTime"], "left")


def join_weather(df: DataFrame, weather: DataFrame, broadcast: bool = False, also: list[str] = ()) -> DataFrame:
    """Weather of every row's stamp, with further columns of ``weather`` named in ``also``."""
    side = F.broadcast(weather) if broadcast else weather
    return df.join(side, "BucketTime", "left").select(*df.columns, *WEATHER_COLS, *also)


def asof_nearest(
    requests: DataFrame, series: DataFrame, step: str, at: str = "at",
    keys: list[str] = ("DeviceId",), time: str = "BucketTime",
) -> DataFrame:
    """Row of a regular series nearest to each request; a tie takes the later row.

    The nearest stamp follows from the series' first and last stamp by arithmetic, so the
    lookup is an equi-join - no window and no range join over a device's requests.
    """
    keys = list(keys)
    size = step_seconds(step)
    rails = series.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    offset = (micros(at) - micros("_t0")) / F.lit(size * 1_000_000)
    steps = F.floor(offset + F.lit(0.5))
    last = ((epoch("_t1") - epoch("_t0")) / size).cast("long")
    nearest = add_steps("_t0", F.least(F.greatest(steps, F.lit(0)), last), step)
    return (
        requests.join(rails, keys)
        .withColumn(time, nearest)
        .drop("_t0", "_t1")
        .join(series, keys + [time], "left")
    )


def asof(
    requests: DataFrame, series: DataFrame, at: str = "at", keys: list[str] = ("DeviceId",), time: str = "BucketTime",
    direction: str = "nearest", within: str | None = None, bucket: str = "1 hour",
) -> DataFrame:
    """Every request with the row of an irregular series before it, after it or nearest to it.

    ``before`` and ``after`` include the request's own stamp; of two equally near rows ``nearest`` takes the later
    one. Rows farther away than ``within`` do not count. Of several rows of one stamp the largest counts,
    compared column by column. Requests without such a row, or with a null stamp or key, keep nulls.

    Requests and rows meet by key and ``bucket`` of the clock, so a device with a third of all rows is many
    groups. What lies beyond a bucket's ends is carried over from a table of the buckets' first and last
    rows, whose windows are bounded by the clock (span / bucket). Windows see each stamp once.
    """
    if direction not in ("before", "after", "nearest"):
        raise ValueError(f"direction {direction!r}")
    keys = list(keys)
    cols = [c for c in series.columns if c not in (*keys, time)]
    clash = {time, *cols} & set(requests.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    known = lambda df, *names: df.dropna(subset=list(names))
    place = lambda df: df.withColumn("_b", F.floor(F.col("_t") / (step_seconds(bucket) * 1_000_000)))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

    newest = F.max(F.struct(*cols)) if cols else F.lit(None).cast("struct<>")
    points = known(series, *keys, time).groupBy(*keys, time).agg(newest.alias("_v"))
    points = points.select(*keys, micros(time).alias("_t"), F.struct(micros(time).alias("_t"), time, "_v").alias("_s"))
    asked = known(requests.select(*keys, at), *keys, at).distinct().select(
        *keys, micros(at).alias("_t"), F.lit(None).cast(points.schema["_s"].dataType).alias("_s"), F.col(at).alias("_at"))
    both = place(points.withColumn("_at", F.lit(None).cast(asked.schema["_at"].dataType)).unionByName(asked))

    inside = W.partitionBy(*keys, "_b")
    near = both.withColumns({
        "_in0": F.last("_s", True).over(inside.orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)),
        "_in1": F.last("_s", True).over(inside.orderBy(F.desc("_t")).rangeBetween(W.unboundedPreceding, W.currentRow)),
    }).filter(F.col("_at").isNotNull())
    ends = both.groupBy(*keys, "_b").agg(F.min_by("_s", F.col("_s._t")).alias("_first"), F.max_by("_s", F.col("_s._t")).alias("_last"))
    along = W.partitionBy(*keys)
    carried = ends.select(
        *keys, "_b",
        F.last("_last", True).over(along.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_out0"),
        F.last("_first", True).over(along.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)).alias("_out1"))

    before, after = F.coalesce("_in0", "_out0"), F.coalesce("_in1", "_out1")
    gap0, gap1 = F.col("_t") - before["_t"], after["_t"] - F.col("_t")
    pick = {"before": before, "after": after,
            "nearest": F.when(gap1.isNull() | (gap0 < gap1), before).otherwise(after)}[direction]
    found = near.join(carried, [*keys, "_b"]).select(*keys, F.col("_at").alias(at), "_t", pick.alias("_s"))
    if within is not None:
        found = found.filter(F.abs(F.col("_s._t") - F.col("_t")) <= step_seconds(within) * 1_000_000)
    return requests.join(found.select(*keys, at, "_s"), [*keys, at], "left").select(
        *requests.columns, F.col(f"_s.{time}").alias(time), *[F.col("_s._v")[c].alias(c) for c in cols])


def future_with_fallback(
    future: DataFrame, actual: DataFrame, fallback: DataFrame, cols: list[str],
    keys: list[str] = ("DeviceId",), time: str = "BucketTime",
) -> DataFrame:
    """Values at future stamps where they exist, else the fallback row of the series."""
    keys = list(keys)
    known = actual.select(*keys, F.col(time).alias("FutureTime"), *cols)
    rest = fallback.select(*keys, *[F.col(c).alias(f"_fb_{c}") for c in cols])
    known = known.withColumn("_hit", F.lit(1))
    out = future.join(known, keys + ["FutureTime"], "left").join(rest, keys, "left")
    # The whole row is taken from one side: a present stamp with a null stays null.
    return out.withColumns(
        {c: F.when(F.col("_hit") == 1, F.col(c)).otherwise(F.col(f"_fb_{c}")) for c in cols}
    ).drop("_hit", *[f"_fb_{c}" for c in cols])


def reindex(
    index: DataFrame, series: DataFrame, keys: list[str], time: str = "BucketTime",
) -> DataFrame:
    """Series values on the stamps of ``index``; stamps unknown to the series are null."""
    return index.select(*keys, time).join(series, keys + [time], "left")


def metrics_lookup(df: DataFrame, metrics: DataFrame, target: str, defaults: dict) -> DataFrame:
    """First metrics row per device and target, defaults where there is none."""
    cols = list(defaults)
    one = (
        metrics.filter(F.col("TargetCol") == target)
        .groupBy("DeviceId")
        .agg(F.min(F.struct("row", *cols)).alias("_m"))
        .select("DeviceId", *[F.col(f"_m.{c}").alias(c) for c in cols])
    )
    return df.join(one, "DeviceId", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    )


def devices_for_target(devices: DataFrame, metrics: DataFrame, target: str) -> DataFrame:
    """Devices with metrics for the target; every device when there are none at all."""
    chosen = metrics.filter(F.col("TargetCol") == target).select("DeviceId").distinct()
    none = chosen.agg(F.count(F.lit(1)) == 0).scalar()
    return chosen.unionByName(devices.select("DeviceId").distinct().filter(none))


def devices_by_list(df: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    if isinstance(ids, list):
        return df.filter(F.col("DeviceId").isin(ids))
    return df.join(ids.select("DeviceId").distinct(), "DeviceId", "left_semi")
