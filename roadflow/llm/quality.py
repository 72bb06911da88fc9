"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few figures (lengths, shares of characters, repetition). Each figure is cut into
quantile bins. Training cycles over the figures: in each round every figure gets one shallow tree (at
most SPLITS cuts over its bins) fitted to the gradient that the others leave, shrunken and added to its
lookup table; then pairs of figures get trees over their grid of bins, for the pairs that still explain most.
Scoring adds up the looked-up values of the bins and passes them through the logistic function.

Figures are computed where the text is; only they reach the driver, for at most TRAIN_ROWS labelled rows.

Null and empty texts have figures of zero and a score like any other. Without labelled rows of both kinds the
model gives every text the share of good rows (0.5 without any). Other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import forget, give_back, labelled, slices

#: Labelled rows that training uses at most.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 5
ROUNDS, PAIR_ROUNDS, SPLITS, RATE = 150, 60, 3, 0.15
ACCEPT = 0.5

FIGURES = [
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "mark_share", "space_share", "bang_share",
    "distinct_share", "top_share", "repeat_next", "distinct_pairs", "line_repeat", "words_per_line", "ended_lines", "longest_word",
]

_ASCII_UPPER, _DIGITS = re.compile("[A-Z]+"), bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def figures(text: str | None) -> list[float]:
    """The figures of a text, in the order of FIGURES."""
    if not text:
        return [0.0] * len(FIGURES)
    words = text.split()
    raw, n, w = text.encode(), len(text), max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    # A character that lower() changes is an upper-case one.
    upper = sum(map(str.isupper, text)) if n < 512 else sum(a != b for a, b in zip(text, text.lower()))
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return [
        np.log1p(n), np.log1p(len(words)), n / w, upper / n, without(_DIGITS) / n, without(_MARKS) / n, without(b" \t\r\n") / n,
        text.count("!") / w, len(counts) / w, (max(counts.values()) if counts else 0) / w,
        sum(map(str.__eq__, words, words[1:])) / w, len(set(zip(words, words[1:]))) / w,
        1 - len(set(lines)) / max(1, len(lines)), w / max(1, len(lines)),
        sum(x[-1] in ".!?:;" for x in lines) / max(1, len(lines)), float(max(map(len, words), default=0)),
    ]


def grow(gradient: np.ndarray, weight: np.ndarray, splits: int) -> np.ndarray:
    """The values of a tree over ordered bins: the best cut of the piece that gains most, ``splits`` times."""
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    value = lambda a, b: (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    pieces = [(0, len(gradient))]
    for _ in range(splits):
        best = (1e-9, None, 0)
        for a, b in pieces:
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                better = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                at = int(better.argmax())
                if better[at] > best[0]:
                    best = (better[at], (a, b), a + 1 + at)
        if best[1] is None:
            break
        a, b = best[1]
        pieces.remove((a, b))
        pieces += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in pieces:
        out[a:b] = value(a, b)
    return out


def grow_grid(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree over a grid: a cut of one side, then of the other side in each half."""
    best, out = -1.0, np.zeros_like(gradient)
    for turned in (False, True):
        g, h = (gradient.T, weight.T) if turned else (gradient, weight)
        for cut in range(1, len(g)):
            halves = [grow(g[rows].sum(axis=0), h[rows].sum(axis=0), 1) for rows in (slice(0, cut), slice(cut, None))]
            gains = [(half * (2 * g[rows].sum(axis=0) - half * (h[rows].sum(axis=0)))).sum()
                     for half, rows in zip(halves, (slice(0, cut), slice(cut, None)))]
            if sum(gains) > best:
                best = sum(gains)
                grid = np.vstack([np.tile(halves[0], (cut, 1)), np.tile(halves[1], (len(g) - cut, 1))])
                out = grid.T if turned else grid
    return out


class Model:
    """Lookup tables over bins: one for each figure and one for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        share = float(y.mean()) if len(y) else 0.5
        self.base = float(np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1)))
        k = len(FIGURES)
        if len(y) == 0:
            x = np.zeros((1, k))
        inner = lambda n: [np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) for f in range(k)]
        self.edges, self.pair_edges = inner(BINS), inner(PAIR_BINS)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        if len(np.unique(y)) == 2:
            self._train(x, y)

    def _train(self, x: np.ndarray, y: np.ndarray) -> None:
        bins = [np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)]
        logit = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, own in enumerate(bins):
                p = 1 / (1 + np.exp(-logit))
                size = len(self.tables[f])
                step = RATE * grow(np.bincount(own, y - p, size), np.bincount(own, p * (1 - p), size), SPLITS)
                self.tables[f] += step
                logit += step[own]
        cells = [np.searchsorted(e, x[:, f]) for f, e in enumerate(self.pair_edges)]

        def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-logit))
            shape = (len(self.pair_edges[a]) + 1, len(self.pair_edges[b]) + 1)
            at = cells[a] * shape[1] + cells[b]
            return at, *(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

        def explains(pair: tuple[int, int]) -> float:
            _, g, h = grids(*pair)
            return float((g * g / (h + 1.0)).sum())

        for pair in sorted(combinations(range(len(FIGURES)), 2), key=explains, reverse=True)[:PAIRS]:
            self.pairs[pair] = np.zeros((len(self.pair_edges[pair[0]]) + 1, len(self.pair_edges[pair[1]]) + 1))
        for _ in range(PAIR_ROUNDS):
            for pair, values in self.pairs.items():
                at, g, h = grids(*pair)
                step = RATE * grow_grid(g, h)
                values += step
                logit += step.ravel()[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            logit += values[np.searchsorted(edges, x[:, f])]
        for (a, b), values in self.pairs.items():
            logit += values[np.searchsorted(self.pair_edges[a], x[:, a]), np.searchsorted(self.pair_edges[b], x[:, b])]
        return 1 / (1 + np.exp(-logit))


def train(spark: SparkSession, folder: str, docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled rows of ``docs``; labels come from ``folder``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [figures(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    found = labelled(spark, folder, docs, "quality", rows).mapInArrow(run, "x array<double>, y int").toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FIGURES))
    order = np.lexsort(x.T)  # the same model whatever the order of the rows
    model = Model(x[order], found.column("y").to_numpy()[order].astype(np.float64))
    del found, x
    give_back()
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, the probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema if f.name != name] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            x = np.array([figures(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FIGURES))
            scores = pa.array(shared.value.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.drop(name).mapInArrow(run, schema)


def report(scored: DataFrame, held) -> DataFrame:
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))
