"""Regular time grids, gap filling, lags, rolling windows and series slicing.

Windows here run per series on a regular grid or on rows that are unique per stamp, so
a partition is bounded by the clock (span / step), never by how often a key was reported.
"Next value" windows order descending: a frame that ends at the partition's end would be
recomputed for every row, a descending one is a running value like its ascending twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import add_steps, calendar_dummies, epoch, floor_to, from_epoch, is_holiday, step_seconds
from ..functions.columns import one_row
from ..schemas import ROLLING, SERIES
from ..session import shuffle_partitions


def bounds(df: DataFrame, step: str, time: str = "BucketTime") -> DataFrame:
    """First and last stamp floored to the step, as one row."""
    return df.agg(
        floor_to(F.min(time), step).alias("t0"), floor_to(F.max(time), step).alias("t1")
    )


def steps_between(start, end, step: str) -> Column:
    """Array of stamps from start to end, both included; null bounds give null."""
    return F.sequence(start, end, F.expr(f"INTERVAL '{step_seconds(step)}' SECOND"))


def dense_grid(
    df: DataFrame, step: str = "5 minutes", observed_pairs_only: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Every device x lane x stamp between the first and last stamp of ``df``.

    The pairs are spread by (DeviceId, Lane) into a fixed number of partitions *before* the
    stamps are exploded: the dense rows are born where their series' windows need them and
    are never shuffled.
    """
    span = one_row(bounds(df, step))
    n = partitions or shuffle_partitions(df.sparkSession)
    return (
        series_pairs(df, observed_pairs_only).repartition(n, *SERIES)
        .select(*SERIES, F.explode(steps_between(span["t0"], span["t1"], step)).alias("BucketTime"))
    )


def series_pairs(df: DataFrame, observed_only: bool = False) -> DataFrame:
    """Series of the grid: the pairs seen, or every device with every lane that occurs.

    A road has a handful of lanes; their distinct values travel as one array.
    """
    if observed_only:
        return df.select(*SERIES).distinct()
    lanes = df.agg(F.collect_set("Lane")).scalar()
    return df.select("DeviceId").distinct().withColumn("Lane", F.explode(lanes))


def time_grid(df: DataFrame, step: str = "5 minutes") -> DataFrame:
    """Every stamp between the first and last stamp of ``df``."""
    return bounds(df, step).select(F.explode(steps_between("t0", "t1", step)).alias("BucketTime"))


def asfreq(
    df: DataFrame, step: str = "5 minutes", keys: list[str] = ("DeviceId",),
    time: str = "BucketTime",
) -> DataFrame:
    """Insert the missing steps between a series' first and last row.

    Each row learns the stamp of its successor and explodes into the steps up to it, so the
    dense rows are neither joined nor shuffled. Rows off the series' own grid drop out; a
    stamp that occurs twice is an error.
    """
    keys = list(keys)
    size = step_seconds(step)
    whole = W.partitionBy(*keys)
    order = whole.orderBy(time)
    marked = df.withColumns({"_s": epoch(time), "_s0": epoch(F.min(time).over(whole)), "_after": F.lead(time).over(order)})
    # Looked for before rows off the grid go: a repeated one is as wrong as any other.
    twice = F.raise_error(F.lit(f"asfreq: a series of {keys} has a stamp twice")).cast("boolean")
    on_grid = marked.filter(
        F.when(F.col("_after") == F.col(time), twice).otherwise((F.col("_s") - F.col("_s0")) % size == 0)
    )
    last = F.coalesce(F.lead("_s").over(order) - size, F.col("_s"))
    rest = [c for c in df.columns if c not in keys + [time]]
    return (
        on_grid.withColumn("_to", last)
        .select("*", F.explode(F.sequence("_s", "_to", F.lit(size).cast("long"))).alias("_at"))
        .select(
            *[
                F.when(F.col("_at") == F.col("_s"), F.col(c)).alias(c) if c in rest
                else (from_epoch("_at").alias(c) if c == time else F.col(c))
                for c in df.columns
            ]
        )
    )


def _running_last(order: str, descending: bool, keys: list[str]):
    by = F.col(order).desc() if descending else F.col(order).asc()
    return W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, 0)


def _groups(cols: list[str], together: list[list[str]] | None) -> list[list[str]]:
    """Columns by shared null pattern; a column that is named nowhere stands alone."""
    shared = [[c for c in g if c in cols] for g in (together or [])]
    named = {c for g in shared for c in g}
    return [g for g in shared if g] + [[c] for c in cols if c not in named]


def _known_neighbours(
    groups: list[list[str]], time: str, keys: list[str], strict_next: bool = False
) -> list[dict]:
    """Position (per group) and value (per column) of the last known cell and the next one.

    Two maps for two window passes: descending first, so that whatever follows in time
    order reuses the ascending sort. Needs a ``_pos`` column.
    """
    before, after = _running_last(time, False, keys), _running_last(time, True, keys)
    if strict_next:
        after = after.rowsBetween(W.unboundedPreceding, -1)
    found = []
    for side, frame in (("n", after), ("p", before)):
        new = {}
        for g in groups:
            at = F.when(F.col(g[0]).isNotNull(), F.col("_pos"))
            new[f"_{side}i_{g[0]}"] = F.last(at, True).over(frame)
            new |= {f"_{side}x_{c}": F.last(c, True).over(frame) for c in g}
        found.append(new)
    return found


def _on_line(
    df: DataFrame, groups: list[list[str]], pos: str, limit: int | None, max_gap: int | None
) -> tuple[DataFrame, dict[str, Column]]:
    """Values at ``pos`` on the lines between known neighbours.

    What to take is decided once per group (1 previous, 2 next, 3 the line between).
    """
    ways, out = {}, {}
    for g in groups:
        pi, ni, here = F.col(f"_pi_{g[0]}"), F.col(f"_ni_{g[0]}"), F.col(pos)
        dp, dn = here - pi, ni - here
        near = lambda d: F.lit(True) if limit is None else d <= limit
        inside = near(dp) | near(dn)
        if max_gap is not None:
            inside = inside & (ni - pi - 1 <= max_gap)
        ways[f"_way_{g[0]}"] = (
            F.when(dp == 0, 1)
            .when(pi.isNull(), F.when(near(dn), 2))
            .when(ni.isNull(), F.when(near(dp), 1))
            .when(inside, 3)
        )
        way = F.col(f"_way_{g[0]}")
        for c in g:
            px, nx = F.col(f"_px_{c}"), F.col(f"_nx_{c}")
            line = px + (nx - px) * dp / (ni - pi)
            out[c] = F.when(way == 1, px).when(way == 2, nx).when(way == 3, line)
    return df.withColumns(ways), out


def _lines(
    groups: list[list[str]], pos: str, limit: int | None, max_gap: int | None
) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """The rule of ``_on_line`` for segments: a struct per group before they explode; behind, ways and values at ``pos``.

    What all cells of a segment share is worked out once: the last cell that the previous value reaches (``head``),
    the first that the next one reaches (``tail``), starts and rises. A struct goes to a cell as one field, and no field
    in it is null. The way of a group is 1 for the known value, 2 for the line and 0 for an open cell.
    """
    never = 1 << 62  # beyond every position, in steps of a second too
    packed, ways, out = {}, {}, {}
    for g in groups:
        pi, ni = F.col(f"_pi_{g[0]}"), F.col(f"_ni_{g[0]}")
        head, tail = (F.lit(never), F.lit(-never)) if limit is None else (pi + limit, ni - limit)
        if max_gap is not None:
            wide = F.coalesce(ni - pi - 1 > max_gap, F.lit(False))
            head, tail = F.when(wide, pi).otherwise(head), F.when(~wide, tail)
        zero = F.lit(0.0)
        packed[f"_line_{g[0]}"] = F.struct(
            F.coalesce(pi, F.lit(-never)).alias("at"),
            F.coalesce((ni - pi).cast("double"), F.lit(1.0)).alias("span"),
            F.coalesce(F.when(pi.isNotNull(), head), F.lit(-never)).alias("head"),
            F.coalesce(F.when(ni.isNotNull(), tail), F.lit(never)).alias("tail"),
            *[F.coalesce(f"_px_{c}", f"_nx_{c}", zero).alias(f"start{i}") for i, c in enumerate(g)],
            *[F.coalesce(F.col(f"_nx_{c}") - F.col(f"_px_{c}"), zero).alias(f"rise{i}") for i, c in enumerate(g)],
        )
        own, here = F.col(f"_line_{g[0]}"), F.col(pos)
        reached = (here <= own["head"]) | (here >= own["tail"])
        way = ways[g[0]] = F.when(here == own["at"], 1).when(reached, 2).otherwise(0)
        steps = here.cast("double") - own["at"].cast("double")  # whole numbers, so exact
        for i, c in enumerate(g):
            on = own[f"start{i}"] + own[f"rise{i}"] * steps / own["span"]
            out[c] = F.when(way == 1, own[f"start{i}"]).when(way == 2, on)
    return packed, ways, out


def position(time: str, step: str) -> Column:
    """Number of the step a stamp falls into."""
    return F.floor(epoch(time) / step_seconds(step))


def interpolate(
    df: DataFrame, cols: list[str], keys: list[str], step: str, limit: int | None = 12,
    max_gap: int | None = None, time: str = "BucketTime",
) -> DataFrame:
    """Linear interpolation by position on a regular grid, from both sides.

    A gap cell is filled when it lies within ``limit`` steps of a known value on either
    side; series edges hold the nearest known value. ``max_gap`` keeps longer gaps open.
    Position comes from the stamp, so no row numbers are computed.
    """
    groups = _groups(cols, None)
    ahead, back = _known_neighbours(groups, time, keys)
    seen = df.withColumn("_pos", position(time, step)).withColumns(ahead).withColumns(back)
    seen, line = _on_line(seen, groups, "_pos", limit, max_gap)
    return seen.select(*[line[c].alias(c) if c in line else F.col(c) for c in df.columns])


def densify(
    observed: DataFrame, cols: list[str], step: str, limit: int | None = 12,
    max_gap: int | None = None, observed_pairs_only: bool = False, partitions: int | None = None,
    together: list[list[str]] | None = None,
) -> DataFrame:
    """Dense device x lane x time grid with interpolated values, in one go.

    Same rows as ``interpolate(dense_grid ⟕ observed)``, but windows run over the few
    observed rows: each one learns its neighbours and the stamp of its successor, then
    explodes into the cells up to it. A virtual row before the first step opens every
    series (never-seen pairs too). Dense rows are neither joined, shuffled nor windowed.
    ``_known`` tells whether the first column was known in the cell itself. Columns listed
    ``together`` are null in the same rows and share their positions; that is verified.
    """
    rows = segments(observed, cols, step, observed_pairs_only, partitions, together)
    return cells(rows, cols, step, limit, max_gap, together)


def segments(
    observed: DataFrame, cols: list[str], step: str, observed_pairs_only: bool = False,
    partitions: int | None = None, together: list[list[str]] | None = None,
) -> DataFrame:
    """Runs of cells (``_from`` to ``_to``) between observed rows, with their known neighbours; see ``densify``."""
    time, keys = "BucketTime", SERIES
    size = step_seconds(step)
    span = one_row(
        bounds(observed, step).select(
            position("t0", step).alias("p0"), position("t1", step).alias("p1")
        )
    )
    rows = (
        observed.filter(F.pmod(epoch(time), F.lit(size)) == 0)  # off-grid stamps meet no cell
        .select(*keys, position(time, step).alias("_pos"), *cols)
        .unionByName(
            series_pairs(observed, observed_pairs_only).select(
                *keys, (span["p0"] - 1).alias("_pos"),
                *[F.lit(None).cast("double").alias(c) for c in cols],
            )
        )
        .repartition(partitions or shuffle_partitions(observed.sparkSession), *keys)
    )
    groups = _groups(cols, together)
    differ = [F.col(g[0]).isNull() != F.col(c).isNull() for g in groups for c in g[1:]]
    if differ:
        odd = differ[0]
        for d in differ[1:]:
            odd = odd | d
        failed = F.raise_error(F.lit("columns declared to be null together are not"))
        rows = rows.withColumn("_pos", F.when(odd, failed.cast("long")).otherwise(F.col("_pos")))
    ahead, back = _known_neighbours(groups, "_pos", keys, strict_next=True)
    nxt = F.lead("_pos").over(W.partitionBy(*keys).orderBy("_pos"))
    return rows.withColumns(ahead).withColumns({**back, "_until": nxt}).select(
        *keys,
        F.greatest(F.col("_pos"), span["p0"]).alias("_from"),
        (F.coalesce(F.col("_until"), span["p1"] + 1) - 1).alias("_to"),
        *[f"_{k}i_{g[0]}" for g in groups for k in "pn"],
        *[f"_{k}x_{c}" for c in cols for k in "pn"],
    ).filter(F.col("_from") <= F.col("_to"))


def by_hour(runs: DataFrame, step: str) -> DataFrame:
    """Segments cut at full hours; ``Hour`` is the hour of day of all their cells."""
    size = step_seconds(step)
    hour_of = lambda c: F.floor(F.col(c) * size / 3600)
    if size >= 3600:  # every cell has an hour of its own
        cut = runs.withColumn("_from", F.explode(F.sequence("_from", "_to"))).withColumns(
            {"_to": F.col("_from"), "_hour": hour_of("_from")}
        )
    else:
        first = lambda hour: F.ceil(hour * 3600 / size)
        cut = runs.select("*", F.explode(F.sequence(hour_of("_from"), hour_of("_to"))).alias("_hour")).withColumns(
            {"_from": F.greatest("_from", first(F.col("_hour"))), "_to": F.least(F.col("_to"), first(F.col("_hour") + 1) - 1)}
        )
    return cut.withColumn("Hour", F.pmod("_hour", F.lit(24)).cast("int")).drop("_hour")


def cells(
    runs: DataFrame, cols: list[str], step: str, limit: int | None = 12, max_gap: int | None = None,
    together: list[list[str]] | None = None, otherwise: dict[str, Column] | None = None,
) -> DataFrame:
    """The cells of ``segments`` with values on the lines between their neighbours; see ``densify``.

    ``otherwise`` has values over the columns of ``runs`` for cells that no line reaches, and leaves a column
    ``_filled`` that tells whether the line gave the first one.
    """
    time, groups = "BucketTime", _groups(cols, together)
    packed, ways, line = _lines(groups, "_cell", limit, max_gap)
    used = [f"_{k}i_{g[0]}" for g in groups for k in "pn"] + [f"_{k}x_{c}" for c in cols for k in "pn"]
    found = runs.withColumns(packed).drop(*used).select("*", F.explode(F.sequence("_from", "_to")).alias("_cell"))
    lead = next(g[0] for g in groups if cols[0] in g)
    rest = otherwise or {}
    return found.select(
        *SERIES,
        F.timestamp_seconds(F.col("_cell") * step_seconds(step)).cast("timestamp_ntz").alias(time),
        *[(F.coalesce(line[c], rest[c]) if c in rest else line[c]).alias(c) for c in cols],
        (ways[lead] == 1).alias("_known"),
        *([line[cols[0]].isNotNull().alias("_filled")] if rest else []),
    )


def bfill_ffill(
    df: DataFrame, cols: list[str], keys: list[str], time: str = "BucketTime",
    default: float | None = 0.0, ffill_first: bool = False,
) -> DataFrame:
    """Next known value, else the previous one, else the default."""
    before, after = _running_last(time, False, keys), _running_last(time, True, keys)
    out = df.withColumns({f"_n_{c}": F.last(c, True).over(after) for c in cols}).withColumns(
        {f"_p_{c}": F.last(c, True).over(before) for c in cols}
    )

    def pick(c):
        order = [f"_p_{c}", f"_n_{c}"] if ffill_first else [f"_n_{c}", f"_p_{c}"]
        tail = [] if default is None else [F.lit(default)]
        return F.coalesce(c, *order, *tail)

    return out.select(*[(pick(c).alias(c) if c in cols else F.col(c)) for c in df.columns])


def series_window(keys: list[str], time: str = "BucketTime"):
    return W.partitionBy(*keys).orderBy(time)


def with_lags(
    df: DataFrame, cols: list[str], keys: list[str], lags: list[int] = (1,), time: str = "BucketTime"
) -> DataFrame:
    w = series_window(keys, time)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in lags})


def rolling(
    df: DataFrame, cols: list[str], keys: list[str], spans: dict[str, int] = ROLLING,
    time: str = "BucketTime",
) -> DataFrame:
    """Mean and sample deviation over the last n rows, the current one included."""
    w = series_window(keys, time)
    new = {}
    for c in cols:
        for name, n in spans.items():
            frame = w.rowsBetween(1 - n, 0)
            new[f"{c}_roll_mean_{name}"] = F.avg(c).over(frame)
            new[f"{c}_roll_std_{name}"] = F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0))
    return df.withColumns(new)


def difference(
    df: DataFrame, column: str, keys: list[str], d: int = 1, time: str = "BucketTime"
) -> DataFrame:
    """d-th difference; the first d rows of a series are null."""
    w = series_window(keys, time)
    weights = {0: [1], 1: [1, -1], 2: [1, -2, 1]}[d]
    terms = [F.lag(column, k).over(w) * F.lit(v) for k, v in enumerate(weights)]
    expr = terms[0]
    for term in terms[1:]:
        expr = expr + term
    return df.withColumn(f"{column}_diff{d}", expr)


def tail_n(df: DataFrame, n: int, keys: list[str], time: str = "BucketTime") -> DataFrame:
    """Last n rows of each series."""
    w = W.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def split_tail(
    df: DataFrame, keys: list[str], test: int = 12, val: int = 0, train: int | None = None,
    time: str = "BucketTime",
) -> DataFrame:
    """Label rows train / val / test by position from the end of their series.

    ``train`` bounds the training tail; it shrinks to what the series has (60 at least).
    """
    w = W.partitionBy(*keys).orderBy(F.col(time).desc())
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    rn = F.row_number().over(w)
    out = df.withColumns({"_rn": rn, "_n": n})
    held = test + val
    keep = (
        F.lit(True)
        if train is None
        else F.col("_rn") <= held + F.greatest(F.lit(60), F.least(F.lit(train), F.col("_n") - held))
    )
    label = (
        F.when(F.col("_rn") <= test, "test")
        .when(F.col("_rn") <= held, "val")
        .when(keep, "train")
    )
    return out.withColumn("split", label).drop("_rn", "_n")


def momentum(df: DataFrame, column: str, keys: list[str], time: str = "BucketTime") -> DataFrame:
    """First and second change in percent with their trend labels.

    A missing predecessor repeats the current value, a base at or below 0 gives 0.
    """
    w = series_window(keys, time)
    y = F.col(column)
    prev1 = F.coalesce(F.lag(column, 1).over(w), y)
    prev2 = F.coalesce(F.lag(column, 2).over(w), prev1)
    pct = lambda a, b: F.when(b > 0, (a - b) / b * 100.0).otherwise(0.0)
    return (
        df.withColumns({"_y1": prev1, "_y2": prev2})
        .withColumn("change_pct", pct(y, F.col("_y1")))
        .withColumn("accel_pct", F.col("change_pct") - pct(F.col("_y1"), F.col("_y2")))
        .drop("_y1", "_y2")
    )


def momentum_labels(df: DataFrame) -> DataFrame:
    def band(c, edge, up, down):
        return F.when(F.col(c) >= edge, up).when(F.col(c) <= -edge, down).otherwise("stable")

    return df.withColumns(
        {
            "trend": band("change_pct", 0.5, "rise", "fall"),
            "pressure": band("accel_pct", 1.0, "congesting", "clearing"),
        }
    )


def resample_mean(
    df: DataFrame, cols: list[str], keys: list[str], step: str = "5 minutes",
    time: str = "BucketTime",
) -> DataFrame:
    """Mean per step; steps between a series' first and last one exist even when empty."""
    binned = (
        df.withColumn(time, floor_to(time, step))
        .groupBy(*keys, time)
        .agg(*[F.avg(c).alias(c) for c in cols])
    )
    return asfreq(binned, step, keys, time)


def future_index(
    origins: DataFrame, n: int, step: str = "5 minutes", time: str = "BucketTime"
) -> DataFrame:
    """n stamps after each origin row, with the step number."""
    return origins.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "FutureTime", add_steps(time, F.col("step"), step)
    )


def last_row(df: DataFrame, keys: list[str], time: str = "BucketTime") -> DataFrame:
    """Latest row of each series, by a partial aggregate (no sort, no window)."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(time)).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
    )


def future_exog_persist(
    df: DataFrame, cols: list[str], n: int = 12, step: str = "5 minutes",
    keys: list[str] = ("DeviceId",),
) -> DataFrame:
    """Future regressors: the last row's values with the calendar of the future stamp."""
    keys = list(keys)
    ahead = future_index(last_row(df.select(*keys, "BucketTime", *cols), keys), n, step)
    return ahead.withColumns(
        {"IsHoliday": is_holiday("FutureTime"), **calendar_dummies("FutureTime")}
    ).drop("BucketTime")


def clamp_origin(
    df: DataFrame, requests: DataFrame, history: int, horizon: int, keys: list[str] = ("DeviceId",),
    step: str = "5 minutes", time: str = "BucketTime",
) -> DataFrame:
    """Move a requested origin so that it has ``history`` rows before and ``horizon`` after.

    On a regular series the guard rails follow from its first and last stamp.
    """
    keys = list(keys)
    rails = df.groupBy(*keys).agg(
        add_steps(F.min(time), history, step).alias("_lo"),
        add_steps(F.max(time), -horizon, step).alias("_hi"),
    )
    return requests.join(rails, keys).withColumn(
        "origin", F.least(F.greatest("origin", "_lo"), F.col("_hi"))
    ).drop("_lo", "_hi")
