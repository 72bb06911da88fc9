"""Moment matrices of many series in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import series_window

_OPEN_SERIES = 64

GRAMS = "DeviceId string, window string, reach int, n double, gram array<double>"


class Sums:
    """Matrices of the series a task has met, handed on when they are many."""

    def __init__(self) -> None:
        self.sums: dict[tuple, list] = {}

    def add(self, key: tuple, z: np.ndarray) -> None:
        v = np.column_stack([np.ones(len(z)), z])
        slot = self.sums.setdefault(key, [0, 0.0])
        slot[0] += len(z)
        slot[1] = slot[1] + v.T @ v

    def flush(self) -> pa.RecordBatch:
        keys, found = list(self.sums), list(self.sums.values())
        self.sums.clear()
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
            pa.array([k[2] for k in keys], pa.int32()), pa.array([float(n) for n, _ in found], pa.float64()),
            pa.array([g.ravel() for _, g in found], pa.list_(pa.float64())),
        ], ["DeviceId", "window", "reach", "n", "gram"])


def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """The devices of a batch and the places of their rows."""
    codes = batch.column("DeviceId").dictionary_encode()
    places = codes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(places, kind="stable")
    cuts = np.flatnonzero(np.diff(places[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield codes.dictionary[int(places[at[0]])].as_py(), at


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as numbers, nulls as NaN."""
    return batch.column(name).to_numpy(zero_copy_only=False)


def added_up(partial: DataFrame) -> DataFrame:
    """(DeviceId, window, grams): the matrices of each reach, added up by the JVM; raw rows never meet in Python."""
    first = F.element_at(F.collect_list("gram"), 1)
    rest = F.slice(F.collect_list("gram"), 2, 2**31 - 1)
    add = lambda acc, g: F.zip_with(acc, g, lambda a, b: a + b)
    whole = partial.groupBy("DeviceId", "window", "reach").agg(F.sum("n").alias("n"), F.aggregate(rest, first, add).alias("gram"))
    return whole.groupBy("DeviceId", "window").agg(F.sort_array(F.collect_list(F.struct("reach", "n", "gram"))).alias("grams"))


def in_ranges(rows: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` that a range of their series holds, with the ends of its ranges (``low_i``, ``high_i``).

    ``ranges``: one row per series (DeviceId, ``low_i``, ``high_i`` for the i-th window), ends counted as ``rn``.
    """
    inside = [F.col("rn").between(F.col(f"low_{i}"), F.col(f"high_{i}")) for i in range(len(names))]
    use = inside[0]
    for other in inside[1:]:
        use = use | other
    return rows.join(ranges, "DeviceId").where(use)


def bounds(names: list[str]) -> list[str]:
    return [f"{end}_{i}" for i in range(len(names)) for end in ("low", "high")]


def series_moments(
    rows: DataFrame, columns: dict[int, list[str]], ranges: DataFrame, names: list[str], own: dict[int, list[str]] | None = None,
) -> DataFrame:
    """Gram matrices of ``[1, columns]`` per series and window, one for each reach: (DeviceId, window, grams).

    ``columns``: reach -> column names; rows with a null in them are left out, so a near reach keeps rows that a far
    one loses. All windows and reaches come from one pass. ``own``: reach -> further columns that every window has
    for itself, named ``<column>_<i>``.
    """
    own = own or {reach: [] for reach in columns}

    used = sorted({c for cols in columns.values() for c in cols})
    used += sorted({f"{c}_{i}" for cols in own.values() for c in cols for i in range(len(names))})
    place = {c: i for i, c in enumerate(used)}
    picked = {(i, reach): [place[c] for c in [*base, *[f"{c}_{i}" for c in own[reach]]]]
              for i in range(len(names)) for reach, base in columns.items()}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            values = np.column_stack([numbers(batch, c) for c in used])
            known = ~np.isnan(values)
            rn, ends = numbers(batch, "rn"), {c: numbers(batch, c) for c in bounds(names)}
            inside = [(rn >= ends[f"low_{i}"]) & (rn <= ends[f"high_{i}"]) for i in range(len(names))]
            whole = {key: known[:, at].all(axis=1) & inside[key[0]] for key, at in picked.items()}
            for device, rows_of in runs(batch):
                part = values[rows_of]
                for (i, reach), at in picked.items():
                    z = part[whole[i, reach][rows_of]][:, at]
                    if len(z):
                        sums.add((device, names[i], reach), z)
                if len(sums.sums) > _OPEN_SERIES * len(names) * len(columns):
                    yield sums.flush()
        if sums.sums:
            yield sums.flush()

    kept = in_ranges(rows, ranges, names).select(
        "DeviceId", "rn", *bounds(names), *[F.col(c).cast("double").alias(c) for c in used])
    return added_up(kept.mapInArrow(reduce, GRAMS))


def lag_moments(rows: DataFrame, ranges: DataFrame, names: list[str], lags: Column, widest: int) -> DataFrame:
    """Gram matrices of ``[1, y, y_1 .. y_R]`` with R = ``lags`` of the series' own window (one column per window).

    All lags up to R are there, whatever the design holds; ``widest`` is the largest R of any series.
    """
    known = F.coalesce(F.col("y").cast("double"), F.lit(float("nan")))
    back = F.collect_list(known).over(series_window(["DeviceId"]).rowsBetween(-widest, 0))
    # One array of at most ``widest`` + 1 numbers a row, made where it is reduced.
    kept = in_ranges(rows.select("DeviceId", "BucketTime", "rn", back.alias("back")), ranges, names)
    kept = kept.select("DeviceId", "rn", *bounds(names), "back", *[lags(i).alias(f"lags_{i}") for i in range(len(names))])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            back = batch.column("back")
            # The newest value of a row is the last of its list.
            flat, ends = back.values.to_numpy(zero_copy_only=False), back.offsets.to_numpy()
            size, newest = np.diff(ends), ends[1:] - 1
            rn, column = numbers(batch, "rn"), {c: numbers(batch, c) for c in [*bounds(names), *[f"lags_{i}" for i in range(len(names))]]}
            for device, at in runs(batch):
                for i, name in enumerate(names):
                    reach = int(column[f"lags_{i}"][at[0]])
                    use = at[(rn[at] >= column[f"low_{i}"][at]) & (rn[at] <= column[f"high_{i}"][at]) & (size[at] > reach)]
                    z = flat[newest[use][:, None] - np.arange(reach + 1)]
                    z = z[~np.isnan(z).any(axis=1)]
                    if len(z):
                        sums.add((device, name, reach), z)
                if len(sums.sums) > _OPEN_SERIES * len(names):
                    yield sums.flush()
        if sums.sums:
            yield sums.flush()

    return added_up(kept.mapInArrow(reduce, GRAMS))
