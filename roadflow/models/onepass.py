"""All a model job asks of a series, in one pass over its rows.

Rows come sorted, oldest first, and narrow: the target, its regressors and flags packed into one number. Lags, shocks,
moment matrices and what is solved on them are made where the rows are, so nothing wide is shuffled, sorted or written.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.calendar import DUMMY_COLS
from ..plans.features import LAGS, MAX_LAG, MAX_SHOCK, REACHES, SHOCK_LAGS, regressor_names
from ..session import shuffle_partitions
from .moments import bounds, numbers

HELD = 100_000  # rows of a series that are kept in memory; those of a longer one wait in a temporary file
BLOCK = 10_000  # rows that are opened into lags at a time
_ANSWERS = 64
FLAGS = ["IsHoliday", *DUMMY_COLS]


def padded(values: np.ndarray, size: int, fill: float) -> np.ndarray:
    return np.concatenate([values, np.full(max(size - len(values), 0), fill)])[:size]


class Held:
    """Rows of one series, oldest first, to be read more than once: in memory or, if they are many, in a file."""

    def __init__(self) -> None:
        self.parts, self.rows, self.file = [], 0, None

    def add(self, part: np.ndarray) -> None:
        self.parts.append(part)
        self.rows += len(part)
        if self.rows > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            for kept in self.parts:
                np.save(self.file, kept)
            self.parts, self.rows = [], 0

    def __iter__(self) -> Iterator[np.ndarray]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                part = np.load(self.file)
                yield from (part[at : at + BLOCK] for at in range(0, len(part), BLOCK))
        if self.parts:
            part = np.concatenate(self.parts)
            yield from (part[at : at + BLOCK] for at in range(0, len(part), BLOCK))


class Groups:
    """Matrices of rows that count for the same windows and reaches: a row is multiplied once, whatever it counts for."""

    def __init__(self) -> None:
        self.sums: dict[tuple, list] = {}

    def add(self, code: np.ndarray, columns: Callable[[tuple, np.ndarray | slice], np.ndarray]) -> None:
        """``code``: for each row and window the number of reaches that the row is complete for."""
        whole = np.ravel_multi_index(code.T, [len(REACHES) + 1] * code.shape[1])
        for at in np.unique(whole[code.any(axis=1)]):
            rows = np.flatnonzero(whole == at)
            key = tuple(code[rows[0]].tolist())
            # Rows that count alike mostly follow each other, and need no copy then.
            z = columns(key, slice(rows[0], rows[-1] + 1) if rows[-1] - rows[0] + 1 == len(rows) else rows)
            slot = self.sums.setdefault(key, [0.0, 0.0])
            slot[0] += len(z)
            slot[1] = slot[1] + z.T @ z

    def grams(self, window: int, picked: Callable[[tuple, int], np.ndarray | slice]) -> dict[int, tuple[np.ndarray, float]]:
        """reach -> (matrix, rows) of a window."""
        found = {}
        for j, reach in enumerate(REACHES):
            held = [(key, n, gram) for key, (n, gram) in self.sums.items() if key[window] > j]
            if held:
                at = [picked(key, j) for key, _, _ in held]
                found[reach] = (sum(g[p][:, p] for (_, _, g), p in zip(held, at)), sum(n for _, n, _ in held))
        return found


class Study:
    """One series: its first stage and its moments with shocks, for each window."""

    def __init__(self, held: Held, target: str, ends: list[tuple[int, int]], keep: int, first: Callable, lag_count: Callable) -> None:
        self.held, self.ends, self.keep = held, ends, keep
        self.m = len(regressor_names(target))
        self.sizes = [2 + self.m + sum(k <= r for k in LAGS) for r in REACHES]
        self.n_shocks = [sum(k <= r for k in SHOCK_LAGS) for r in REACHES]
        # As many lags as the series' length asks for, and what two differences and the difference tested add.
        self.tested = [lag_count(max(high - low + 1, 0)) + 3 for low, high in ends]
        self.known: list | None = None
        self.first = [first(grams, lagged) for grams, lagged in self._plain()]
        self.second = self._with_shocks()

    def _blocks(self) -> Iterator[tuple]:
        """Row numbers, rows as ``[1, x, y, lags]`` and room for shocks, and the target with what lies before it.

        Those of a series of one block are kept.
        """
        if self.known is None:
            self.known = list(self._opened()) if self.held.file is None and self.held.rows <= BLOCK else []
        return iter(self.known) if self.known else self._opened()

    def _opened(self) -> Iterator[tuple]:
        reach = max(MAX_LAG, *self.tested)
        before = np.full(reach, np.nan)
        for part in self.held:
            rn, y, mask = part[:, 0], part[:, 1], part[:, -1]
            n, plain = len(part), part.shape[1] - 3
            z = np.zeros((n, self.sizes[-1] + len(SHOCK_LAGS) * len(self.ends)))
            z[:, 0] = 1.0
            z[:, 1 : 1 + plain] = part[:, 2:-1]
            known = ~np.isnan(mask)
            z[:, 1 + plain : 1 + self.m] = (np.where(known, mask, 0).astype(np.int64)[:, None] >> np.arange(self.m - plain)) & 1
            z[~known, 1 + plain : 1 + self.m] = np.nan
            whole = np.concatenate([before, y])
            for i, k in enumerate((0, *LAGS)):
                z[:, 1 + self.m + i] = whole[reach - k : reach - k + n]
            yield rn, z, whole
            before = whole[-reach:]

    def _complete(self, z: np.ndarray) -> np.ndarray:
        """For each row and reach, whether all its columns are known; what a far reach has, the nearer ones have."""
        unknown, out = np.isnan(z[:, : self.sizes[-1]]), np.empty((len(z), len(REACHES)), dtype=bool)
        for j, (low, high) in enumerate(zip([0, *self.sizes], self.sizes)):
            out[:, j] = ~unknown[:, low:high].any(axis=1) & (out[:, j - 1] if j else True)
        return out

    def _inside(self, rn: np.ndarray) -> np.ndarray:
        return np.column_stack([(rn >= low) & (rn <= high) for low, high in self.ends])

    def _plain(self) -> list[tuple[dict, dict]]:
        """For each window the matrices of all reaches, and that of all lags that the stationarity test asks for."""
        groups, lagged = Groups(), [[0.0, 0.0] for _ in self.ends]
        for rn, z, whole in self._blocks():
            inside, complete = self._inside(rn), self._complete(z).sum(axis=1)
            groups.add(np.where(inside, complete[:, None], 0), lambda key, rows: z[rows, : self.sizes[max(key) - 1]])
            at = np.arange(len(rn)) + len(whole) - len(rn)
            for i, reach in enumerate(self.tested):
                back = whole[at[inside[:, i]][:, None] - np.arange(reach + 1)]
                back = back[~np.isnan(back).any(axis=1)]
                back = np.column_stack([np.ones(len(back)), back])
                lagged[i] = [lagged[i][0] + len(back), lagged[i][1] + back.T @ back]
        leading = lambda key, j: slice(self.sizes[j])
        return [(groups.grams(i, leading), {self.tested[i]: (gram, n)} if n else {}) for i, (n, gram) in enumerate(lagged)]

    def _with_shocks(self) -> list[dict]:
        groups, width, size = Groups(), len(SHOCK_LAGS), self.sizes[-1]
        before = [np.full(MAX_SHOCK, np.nan) for _ in self.ends]
        recent = []
        for rn, z, _ in self._blocks():
            inside, complete = self._inside(rn), self._complete(z)
            code, shocks, now = np.zeros(inside.shape, dtype=int), z[:, size:], []
            for i, model in enumerate(self.first):
                now.append(self._shock(model, z))
                whole = np.concatenate([before[i], now[i]])
                lags = np.column_stack([whole[MAX_SHOCK - k : MAX_SHOCK - k + len(rn)] for k in SHOCK_LAGS])
                known = np.logical_and.accumulate(~np.isnan(lags), axis=1)
                with_lags = np.column_stack([complete[:, j] & known[:, s - 1] for j, s in enumerate(self.n_shocks)])
                code[:, i] = np.where(inside[:, i], np.logical_and.accumulate(with_lags, axis=1).sum(axis=1), 0)
                shocks[:, width * i : width * (i + 1)] = lags
                before[i] = whole[-MAX_SHOCK:]
            # A shock that is unknown belongs to no window or reach that counts the row.
            shocks[np.isnan(shocks)] = 0.0
            groups.add(code, lambda key, rows: z[rows] if max(key) == len(REACHES) else np.column_stack(
                [z[rows, : self.sizes[max(key) - 1]], shocks[rows]]))
            late = rn <= self.keep
            recent.append((rn[late], z[late, : 2 + self.m], *[e[late] for e in now]))
        self.recent = [np.concatenate(c) for c in zip(*recent)]

        def picked(i: int) -> Callable:
            return lambda key, j: np.concatenate([
                np.arange(self.sizes[j]), self.sizes[max(key) - 1] + width * i + np.arange(self.n_shocks[j])])

        return [groups.grams(i, picked(i)) for i in range(len(self.ends))]

    def _shock(self, model: dict | None, z: np.ndarray) -> np.ndarray:
        """Distance from the first stage; unknown where a lag that counts is."""
        if model is None:
            return np.full(len(z), np.nan)
        w = np.asarray(model["w"])[np.array(LAGS) - 1]
        used = np.flatnonzero(w)
        at = 1 + self.m
        return z[:, at] - (model["const"] + z[:, 1:at] @ np.asarray(model["beta"]) + z[:, at + 1 + used] @ w[used])

    def tails(self, window: int, rn: int) -> dict[str, np.ndarray]:
        """What lies before row ``rn``, newest first (``fit.tails_before``); zeros where nothing does."""
        rns, z, e = self.recent[0], self.recent[1], self.recent[2 + window]
        at = np.flatnonzero((rns > rn) & (rns <= rn + MAX_LAG))[::-1]
        y = z[at, 1 + self.m]
        last = y[-1] if len(y) and not np.isnan(y[-1]) else 0.0
        return {"y_tail": padded(y, MAX_LAG, last), "e_tail": padded(np.nan_to_num(e[at], nan=0.0), MAX_SHOCK, 0.0)}

    def rows(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Regressors and target of the rows ``rn`` in [first, last], oldest first."""
        z = self.recent[1][(self.recent[0] >= first) & (self.recent[0] <= last)]
        return z[:, 1 : 1 + self.m], z[:, 1 + self.m]


def studied(
    rows: DataFrame, target: str, facts: DataFrame, names: list[str], keep: int, first: Callable, lag_count: Callable,
    answer: Callable[[str, Study, dict], list[dict]], kind: str, given: str | None = None,
) -> DataFrame:
    """``answer(device, study, facts)`` of every series, as rows of ``kind``.

    ``rows``: whole series (DeviceId, rn, y, regressors). ``facts``: one row per series (DeviceId, ``low_i``, ``high_i``
    for the i-th window, and what ``given`` names); they travel as a last row of their series, so nothing is joined.
    ``keep``: rows at the end of a series that the answer looks at.
    """
    plain = [c for c in regressor_names(target) if c not in FLAGS]
    cols, extra = ["rn", "y", *plain, "_flags"], [*bounds(names), *([given] if given else [])]
    mask = sum((F.shiftleft(F.col(c).cast("long"), i) for i, c in enumerate(FLAGS)), F.lit(0).cast("long"))
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, held, out = None, Held(), []
        for batch in batches:
            values = np.column_stack([numbers(batch, c) for c in cols]).astype(float, copy=False)
            ids = batch.column("DeviceId").dictionary_encode()
            places = ids.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(places)) + 1), len(places)]
            for low, high in zip(cuts, cuts[1:]):
                name = ids.dictionary[int(places[low])].as_py() if high > low else device
                if name != device:
                    device, held = name, Held()
                last = high > low and values[high - 1, 0] == 0
                if high - last > low:
                    held.add(values[low : high - last])
                if last:
                    known = {c: batch.column(c)[int(high) - 1].as_py() for c in extra}
                    ends = [(known[f"low_{i}"], known[f"high_{i}"]) for i in range(len(names))]
                    out += answer(device, Study(held, target, ends, keep, first, lag_count), known)
                    held = Held()
                if len(out) >= _ANSWERS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    narrow = rows.select("DeviceId", F.col("rn").cast("int").alias("rn"), *[F.col(c).cast("double").alias(c) for c in ("y", *plain)],
                         mask.alias("_flags"))
    ends = facts.select("DeviceId", F.lit(0).alias("rn"), *extra)
    whole = narrow.unionByName(ends, allowMissingColumns=True).where("DeviceId IS NOT NULL")
    dealt = whole.repartition(shuffle_partitions(rows.sparkSession), "DeviceId")
    return dealt.sortWithinPartitions("DeviceId", F.col("rn").desc()).select("DeviceId", *cols, *extra).mapInArrow(run, kind)
