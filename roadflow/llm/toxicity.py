"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and of its character n-grams, with its borders marked, hashed into BUCKETS rows of
an embedding table. A text is the average of all its rows, and a linear softmax over two classes reads that
average. Table and softmax are trained together (Adagrad over small batches), so a misspelt word that was never
seen is scored by the n-grams that it shares. How many passes that takes, and how rare a table row may be (ONE_IN), is
found on one in SPLIT of the training rows, by a digest of their features: passes over the others go on until the loss
on these has not fallen for PATIENCE passes. The model is then trained on all of them the way that had the smallest loss.

Features are made where the text is; the driver gets them for at most TRAIN_ROWS labelled rows. For scoring, the
softmax is linear in the average, so each row of the table becomes one number; only these are broadcast.

Null and empty texts, and texts without words, have the score of an empty average. Without labelled rows of both
kinds every text gets the share of toxic rows (0 without any). Other columns pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import byte_words, give_back, labelled, slices, worker_slot

#: Labelled rows that training uses at most.
TRAIN_ROWS = 4_000
BUCKETS, GRAMS, DIMS = 1 << 18, (3, 4, 5), 8
BATCH, RATE = 64, 0.5
#: Training rows that the loss is taken on: one in so many. A pass counts as better if the loss falls by GAIN.
SPLIT, PATIENCE, GAIN = 5, 5, 1e-4
#: Table rows that fewer than one in so many training texts touch are left out of averages (three texts at least).
#: The split of the training rows decides which of these it is.
ONE_IN = (400, 200, 100, 50, 25)
REJECT = 0.7
#: Words that one of the two generations of a worker's cache holds.
CACHED = 100_000
_EDGES = b".,;:!?\"'()[]{}<>-*_"


def subwords(word: bytes) -> list[int]:
    """Buckets of a word and of its n-grams."""
    marked, crc = b"<" + word + b">", zlib.crc32
    out = [crc(marked) % BUCKETS]
    for n in GRAMS:
        out += [crc(marked[i : i + n]) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    counts: Counter[int] = Counter()
    for word, n in Counter(w.strip(_EDGES) for w in byte_words(text)).items():
        if word:
            for f in subwords(word):
                counts[f] += n
    keys = np.fromiter(counts.keys(), np.int32, len(counts))
    return keys, np.fromiter(counts.values(), np.float32, len(counts))


class Model:
    """``values``: what a table row adds to the logit, times its weight; ``weights`` of the average; ``bias``."""

    def __init__(self, keys: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray) -> None:
        share = float(y.mean()) if len(y) else 0.0
        self.values, self.weights = np.zeros(BUCKETS, np.float32), np.ones(BUCKETS, np.float32)
        self.share = self.bias = float(np.log((share * len(y) + 1e-9) / ((1 - share) * len(y) + 1)))
        self.losses: list[float] = []
        if len(np.unique(y)) == 2:
            self._train(keys, counts, y)

    def _train(self, keys: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray) -> None:
        apart = np.array([zlib.crc32(k.tobytes()) % SPLIT == 0 for k in keys])
        # With one kind of rows only on a side, nothing can be told from the split: all rows are on both.
        fit, check = (~apart, apart) if len(np.unique(y[apart])) == 2 and len(np.unique(y[~apart])) == 2 else (~apart | apart,) * 2
        fit, check = np.flatnonzero(fit), np.flatnonzero(check)
        some, rest = ([keys[i] for i in fit], [counts[i] for i in fit], y[fit]), ([keys[i] for i in check], [counts[i] for i in check], y[check])
        best, passes, cut = np.inf, 0, ONE_IN[0]
        for one_in in {max(3, len(fit) // k): k for k in reversed(ONE_IN)}.values():
            lowest, at = np.inf, 0
            for n, _ in enumerate(self._passes(*some, one_in), 1):
                self.losses.append(self.loss(*rest))
                if self.losses[-1] < lowest - GAIN:
                    lowest, at = self.losses[-1], n
                elif n - at >= PATIENCE:
                    break
            if lowest < best:
                best, passes, cut = lowest, at, one_in
        for n, _ in enumerate(self._passes(keys, counts, y, cut), 1):
            if n >= passes:
                break

    def loss(self, keys: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray) -> float:
        """The mean log loss of some texts."""
        values = self.values * self.weights
        logits = np.array([self.bias + float(c @ values[k]) / max(1e-9, float(c @ self.weights[k])) for k, c in zip(keys, counts)])
        return float(np.logaddexp(0, np.where(y == 1, -logits, logits)).mean())

    def _passes(self, keys: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, one_in: int) -> Iterator[None]:
        """Trains from the start, one pass over the texts for each step; the model is that of the passes so far."""
        rng = np.random.default_rng(7)
        texts = np.bincount(np.concatenate(keys), minlength=BUCKETS)
        # The average weighs a row by how rare it is among texts; what only a few texts hold would be learned by heart.
        least = max(3, len(y) // one_in)
        rows = np.flatnonzero(texts >= least)
        self.values, self.bias = np.zeros(BUCKETS, np.float32), self.share
        self.weights = np.where(texts >= least, least / (least + texts), 0).astype(np.float32)
        if not len(rows):
            return
        place = np.full(BUCKETS, -1, np.int32)
        place[rows] = np.arange(len(rows))
        table = rng.uniform(-1, 1, (len(rows), DIMS)).astype(np.float32) / DIMS
        softmax, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
        squares = [np.full(p.shape, 1e-8, np.float32) for p in (table, softmax, bias)]
        batches = [self._batch(b, keys, counts, y, place) for b in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH))]
        while True:
            for b in rng.permutation(len(batches)):
                f, w, starts, of, at, cuts, mine = batches[b]
                mean = np.add.reduceat(table[f] * w, starts)
                logits = mean @ softmax + bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(mine)), mine] -= 1
                p /= len(mine)
                to_table = np.add.reduceat((p @ softmax.T)[of[at]] * w[at], cuts)
                touched = f[at[cuts]]
                steps = ((softmax, mean.T @ p, squares[1], ...), (bias, p.sum(axis=0), squares[2], ...),
                         (table, to_table, squares[0], touched))
                for param, gradient, square, where in steps:
                    square[where] += gradient**2
                    param[where] -= RATE * gradient / np.sqrt(square[where])
            self.values[rows] = table @ (softmax[:, 1] - softmax[:, 0])
            self.bias = float(bias[1] - bias[0])
            yield

    def _batch(self, rows: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, place: np.ndarray):
        """Table rows and weights of some texts, where each text starts, and their order by table row."""
        f, w = [], []
        for i in rows:
            weight = counts[i] * self.weights[keys[i]]
            known = place[keys[i]] >= 0
            # An empty text still has one row, of weight zero.
            f.append(np.append(place[keys[i]][known], np.int32(0)))
            w.append(np.append(weight[known] / max(1e-9, weight.sum()), np.float32(0)))
        sizes = [len(x) for x in f]
        flat = np.concatenate(f)
        at = np.argsort(flat, kind="stable").astype(np.int32)
        cuts = np.flatnonzero(np.concatenate(([True], flat[at][1:] != flat[at][:-1])))
        return (flat, np.concatenate(w)[:, None].astype(np.float32, copy=False), np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(rows), dtype=np.int32), sizes),
                at, cuts, y[rows])


def train(spark: SparkSession, folder: str, docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled rows of ``docs``; labels come from ``folder``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bags = [bag(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k.tobytes() for k, _ in bags], pa.binary()), pa.array([c.tobytes() for _, c in bags], pa.binary()),
                 batch.column("y")], names=["keys", "counts", "y"])

    found = labelled(spark, folder, docs, "toxic", rows).mapInArrow(run, "keys binary, counts binary, y int").toArrow()
    keys = [np.frombuffer(k, np.int32) for k in found.column("keys").to_pylist()]
    counts = [np.frombuffer(c, np.float32) for c in found.column("counts").to_pylist()]
    y = found.column("y").to_numpy().astype(np.int64)
    # The same model whatever the order of the rows.
    order = sorted(range(len(y)), key=lambda i: (len(keys[i]), keys[i].tobytes(), counts[i].tobytes(), y[i]))
    model = Model([keys[i] for i in order], [counts[i] for i in order], y[order])
    del found, keys, counts, y
    give_back()
    return model


class Scorer:
    """Logits of texts; what a word adds is worked out once as long as the cache holds it."""

    def __init__(self, values: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.values, self.weights, self.bias = (values * weights).tolist(), weights.tolist(), bias
        self.new: dict[bytes, tuple[float, float]] = {}
        self.old: dict[bytes, tuple[float, float]] = {}

    def word(self, word: bytes) -> tuple[float, float]:
        found = self.old.get(word)
        if found is None:
            stem = word.strip(_EDGES)
            rows = subwords(stem) if stem else []
            found = (sum(map(self.values.__getitem__, rows)), sum(map(self.weights.__getitem__, rows)))
        if len(self.new) >= CACHED:
            self.old, self.new = self.new, {}
        self.new[word] = found
        return found

    def logit(self, text: str | None) -> float:
        total = weight = 0.0
        for word in byte_words(text):
            v, w = self.new.get(word) or self.word(word)
            total += v
            weight += w
        return self.bias + (total / weight if weight else 0.0)


def scorer_of(key: bytes, model: tuple[np.ndarray, np.ndarray, float]) -> Scorer:
    """One scorer for each model and worker, so its cache outlives a task."""
    return worker_slot(("toxicity", key), lambda: Scorer(*model))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, the probability that the text is toxic."""
    parts = (model.values, model.weights, model.bias)
    key = zlib.crc32(model.values.tobytes()).to_bytes(4, "big") + zlib.crc32(model.weights.tobytes()).to_bytes(4, "big")
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    schema = T.StructType([f for f in docs.schema if f.name != name] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(key, shared.value)
        for batch in slices(batches):
            logits = np.array([scorer.logit(t) for t in batch.column("text").to_pylist()], np.float64)
            scores = pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.drop(name).mapInArrow(run, schema)


def report(scored: DataFrame, held) -> DataFrame:
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= REJECT, 1).otherwise(0).alias("predicted"))
