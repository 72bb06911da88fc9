"""Language-model scores: a hidden Markov model over word classes, trained by Baum-Welch.

Tokens are the words of a text and one end. The model draws a chain of hidden states, in each state the class
of the next token, and in the class its word. The FREQUENT most frequent tokens are classes of their own; all
other words fall in one of BUCKETS classes by a digest, inside which a word has its smoothed share of
the class. So the chain works on a bounded alphabet while every word of the corpus keeps a count of its own:

    log P(text) = log P(classes; chain) + sum of log P(word | class)

* **Counts**: words are counted in the tasks and added up by word, over all training texts.
* **Training**: each round broadcasts the chain, runs forward and backward over all training texts, and adds up the
  expected counts of the partitions (those of states x (states + classes) numbers that are not zero). Texts are whole
  sequences. Rounds end when the probability of the training tokens hardly rises, and after ROUNDS.
* **Scores**: the exact likelihood, by the scaled forward recursion. A long text is cut into segments whose transfer
  matrices are computed side by side and then multiplied in order, which is the same recursion.
* **Words**: the most frequent words, at most KNOWN, and their counts are broadcast, which is bounded and takes
  the hot words out; all other words meet the table of counts in a join of (row, word) pairs. Nothing is dropped.

Null and empty texts consist of the end. A null id counts as empty text when rows are held out. Repeated rows are
texts of their own. Without any training text counts are zero and the chain stays as it starts.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import byte_words, held_out

STATES, ROUNDS, GAIN = 6, 6, 0.002
FREQUENT, BUCKETS = 20_000, 1024
CLASSES = FREQUENT + BUCKETS
KNOWN = 200_000
LEVELS = 16
#: Tokens of a segment, and of the texts that are worked on at once.
SEGMENT, TOKENS = 64, 200_000
#: Bytes of the texts whose words are looked up at once, and the parts of one in which expected counts are added up.
CHARS, PARTS = 1 << 21, 10_000
HELD_OUT = 5
END = " "  # no word holds a blank


def words_of(text: str | None) -> list[bytes]:
    return [*byte_words(text), END.encode()]


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all ``texts``: counted in each task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(words_of(text))
                if len(counts) > 500_000:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words with counts, and the class of every word."""

    def __init__(self, known: list[tuple[str, int]], class_sizes: dict[int, tuple[int, int]], total: int, distinct: int) -> None:
        self.counts = {w.encode(): c for w, c in known}
        self.own = {w.encode(): k for k, (w, _) in enumerate(known[:FREQUENT])}
        self.class_sizes, self.total, self.distinct = class_sizes, total, distinct

    def class_of(self, word: bytes) -> int:
        found = self.own.get(word)
        return bucket(word) if found is None else found


def bucket(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word) % BUCKETS


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the table of counts: its head, and for each bucket the tokens and words outside the head.

    The head is every word from a level of counts up, the lowest level at which KNOWN words or fewer are
    in it; a table of levels (LEVELS for each doubling of the count) finds it without sorting the words.
    """
    level = F.floor(F.log2("c") * LEVELS)
    found, lowest = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        found += r["count"]
        if found > KNOWN:
            break
        lowest = r["level"]
    rows = [] if lowest is None else counts.where(level >= lowest).collect()
    head = sorted(((r["word"], r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))
    all_ = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    in_bucket = (F.crc32(F.col("word").cast("binary")) % BUCKETS + FREQUENT).cast("int")
    sizes = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy(in_bucket.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    for word, c in head[:FREQUENT]:
        n, v = sizes[bucket(word.encode())]
        sizes[bucket(word.encode())] = n - c, v - 1
    return Vocabulary(head, sizes, all_["n"], all_["v"])


def word_in_class(vocabulary: Vocabulary, k: int, c: int) -> float:
    """log10 P(word | class): one for a word with a class of its own, else its smoothed share with room for one unseen word."""
    if k < FREQUENT:
        return 0.0
    n, v = vocabulary.class_sizes.get(k, (0, 0))
    return float(np.log10((c + 0.5) / (n + 0.5 * (v + 1))))


def portions(sizes: list[int], bound: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose ``sizes`` come to about ``bound`` together."""
    start, size = 0, 0
    for k, n in enumerate(sizes):
        size += n
        if size >= bound:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def joined_binary(content: bytes, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one behind the other in ``content``, by where each ends."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(content)])


class Reader:
    """Looks the words of some texts up at once."""

    def __init__(self, v: Vocabulary) -> None:
        floor = v.total + 0.5 * (v.distinct + 1)
        self.index = {w: k for k, w in enumerate(v.counts)}
        # Class, and what one token adds to the base and inside its class; the last entry stands for a rare word.
        self.classes = np.array([v.class_of(w) for w in v.counts] + [0], np.uint16)
        self.base = np.append(np.log10((np.array(list(v.counts.values()), float) + 0.5) / floor), 0.0)
        self.inner = np.array([word_in_class(v, v.class_of(w), c) for w, c in v.counts.items()] + [0.0])

    def read(self, texts: list[str | None]) -> list[pa.Array]:
        """n_tokens, n_known, base, inner, classes, rare, times of each text."""
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words])
        ends = lengths.cumsum()
        starts = ends - lengths
        flat = list(itertools.chain.from_iterable(words))
        ids = np.fromiter(map(self.index.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(ids < 0)
        classes = self.classes[ids]
        classes[missing] = [bucket(flat[k]) for k in missing.tolist()]
        # Rare words of each text, each once with how often it stands there.
        cuts = np.searchsorted(missing, np.concatenate((starts, ends[-1:])))
        rare, times, offsets = [], [], [0]
        for a, b in itertools.pairwise(cuts.tolist()):
            if a < b:
                found = Counter(flat[k] for k in missing[a:b].tolist())
                rare += found
                times += found.values()
            offsets.append(len(rare))
        offsets = pa.array(offsets, pa.int32())
        # No text is without a token, so no sum is empty.
        return [
            pa.array(lengths, pa.int64()), pa.array(np.add.reduceat((ids >= 0).astype(np.int64), starts)),
            pa.array(np.add.reduceat(self.base[ids], starts)), pa.array(np.add.reduceat(self.inner[ids], starts)),
            joined_binary(classes.tobytes(), ends * 2),
            pa.ListArray.from_arrays(offsets, pa.array(rare, pa.binary()).cast(pa.string())),
            pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
        ]


def read_texts(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each text by numbers: row, doc_id, held_out, n, classes (packed), known tokens and what they add, and rare words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, classes binary, "
              "rare array<string>, times array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, context = Reader(shared.value), TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column("text")), 0).to_pylist()
            for a, b in portions(sizes, CHARS):
                batch = whole.slice(a, b - a)
                made = reader.read(batch.column("text").to_pylist())
                rows = pa.array(np.arange(row, row + b - a))
                row += b - a
                yield pa.RecordBatch.from_arrays(
                    [rows, batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), *made],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "classes", "rare", "times"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


class Chain:
    """Start, transition and emission probabilities of the hidden states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit
        self.by_class = np.ascontiguousarray(emit.T)

    @staticmethod
    def initial(shares: np.ndarray) -> Chain:
        """Near the shares of the classes, each state tilted its own way, and slow to change: topics and languages
        last longer than a word, and training tells such states apart in few rounds."""
        rng = np.random.default_rng(11)
        emit = shares * rng.uniform(0.2, 1.8, (STATES, CLASSES))
        move = rng.uniform(0.5, 1.5, (STATES, STATES)) + 40 * np.eye(STATES)
        return Chain(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Chain:
        """From expected counts, as if each state had also seen one token for each class, dealt by the shares: nothing is
        impossible, and few texts do not tie their words to a state."""
        parts = start + 0.1, move + 0.1, emit + CLASSES * shares
        return Chain(*(p / p.sum(axis=-1, keepdims=True) for p in parts))


class Segments:
    """Some texts cut into pieces of SEGMENT tokens, the longest pieces first: those with a token at a place are the first so many.

    ``place`` has where each piece stands, the pieces of a text following each other.
    """

    def __init__(self, packed: list[bytes]) -> None:
        lengths = np.array([len(p) // 2 for p in packed])
        self.pieces = -(-lengths // SEGMENT)
        self.first = self.pieces.cumsum() - self.pieces
        count = int(self.pieces.sum())
        flat = np.zeros(count * SEGMENT, np.uint16)
        flat[np.arange(lengths.sum()) + np.repeat(self.first * SEGMENT - (lengths.cumsum() - lengths), lengths)] = np.frombuffer(b"".join(packed), np.uint16)
        sizes = np.full(count, SEGMENT)
        sizes[self.first + self.pieces - 1] = lengths - (self.pieces - 1) * SEGMENT
        order = np.argsort(-sizes, kind="stable")
        self.place = np.empty(count, np.int64)
        self.place[order] = np.arange(count)
        self.tokens = np.ascontiguousarray(flat.reshape(-1, SEGMENT)[order].T)
        self.live = [int((sizes > at).sum()) for at in range(SEGMENT)]
        self.opens = np.zeros(count, bool)
        self.opens[self.place[self.first]] = True

    def emissions(self, chain: Chain) -> np.ndarray:
        """What each state gives each token: place in the piece, piece, state."""
        return np.take(chain.by_class, self.tokens, axis=0)

    def transfers(self, chain: Chain, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scaled product of each piece's steps, as matrices, and the log10 of the scale. A text opens without a transition."""
        matrix = np.where(self.opens[:, None, None], np.eye(STATES), chain.move)
        scale = np.zeros(len(matrix))
        for at, k in enumerate(self.live):
            if at:
                matrix[:k] = (matrix[:k].reshape(-1, STATES) @ chain.move).reshape(-1, STATES, STATES)
            matrix[:k] *= emissions[at, :k, None, :]
            if at % 8 == 7:
                k = self.live[at - 7]
                size = matrix[:k].reshape(k, STATES * STATES) @ np.ones(STATES * STATES)
                matrix[:k] /= size[:, None, None]
                scale[:k] += np.log10(size)
        return matrix, scale

    def entries(self, chain: Chain, matrix: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State weights before each piece, weights of what follows after it, and log10 P of each text."""
        alpha, beta = np.zeros((len(matrix), STATES)), np.ones((len(matrix), STATES))
        now, total = np.tile(chain.start, (len(self.first), 1)), np.zeros(len(self.first))
        for k in range(self.pieces.max(initial=0)):
            live = np.flatnonzero(self.pieces > k)
            rows = self.place[self.first[live] + k]
            alpha[rows] = now[live]
            after = np.einsum("ts,tsu->tu", now[live], matrix[rows])
            size = after.sum(axis=1)
            total[live] += np.log10(size) + scale[rows]
            now[live] = after / size[:, None]
        for k in range(self.pieces.max(initial=0) - 1, 0, -1):
            at = self.first[np.flatnonzero(self.pieces > k)] + k
            rows = self.place[at]
            back = np.einsum("tsu,tu->ts", matrix[rows], beta[rows])
            beta[self.place[at - 1]] = back / back.sum(axis=1, keepdims=True)
        return alpha, beta, total

    def expected(self, chain: Chain, emissions: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, transitions and emissions, by forward and backward inside the pieces."""
        ones, later = np.ones(STATES), ~self.opens
        forward, sizes, now = np.empty(emissions.shape), np.empty(emissions.shape[:2]), alpha
        for at, k in enumerate(self.live):
            before = now[:k]
            now = before @ chain.move
            if at == 0:
                now[self.opens] = before[self.opens]
            now *= emissions[at, :k]
            sizes[at, :k] = now @ ones
            now /= sizes[at, :k, None]
            forward[at, :k] = now
        move, shares, beta = np.zeros((STATES, STATES)), np.zeros(emissions.shape), beta.copy()
        for at in range(SEGMENT - 1, -1, -1):
            k = self.live[at]
            here = forward[at, :k] * beta[:k]
            size = here @ ones
            shares[at, :k] = here / size[:, None]
            ahead = emissions[at, :k] * beta[:k]
            # The weight of both tokens together is the forward step's size times ``size``.
            joint = ahead / (sizes[at, :k] * size)[:, None]
            move += (forward[at - 1, :k].T @ joint if at else alpha[later].T @ joint[later]) * chain.move
            if at:
                back = ahead @ chain.move.T
                beta[:k] = back / (back @ ones)[:, None]
        # Padding has no share, so it adds nothing to the class that it is filled with.
        flat = self.tokens.ravel()
        emit = np.stack([np.bincount(flat, shares[:, :, s].ravel(), CLASSES) for s in range(STATES)])
        return shares[0, self.opens].sum(axis=0), move, emit


def class_shares(vocab: Vocabulary) -> np.ndarray:
    """The share of each class in the training tokens, smoothed."""
    shares = np.full(CLASSES, 0.5)
    for word, k in vocab.own.items():
        shares[k] += vocab.counts[word]
    for k, (n, _) in vocab.class_sizes.items():
        shares[k] += n
    return shares / shares.sum()


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, gain: float = GAIN) -> Chain:
    """Baum-Welch over all ``texts`` (of ``read_texts``), until a round adds less than ``gain`` to the log10 probability
    of a token, or for ``rounds`` rounds."""
    shares = class_shares(vocab)
    chain, last = Chain.initial(shares), -np.inf
    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(chain)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, likelihood, tokens = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))], 0.0, 0
            for batch in batches:
                for part in segments(batch):
                    emissions = part.emissions(shared.value)
                    alpha, beta, logs = part.entries(shared.value, *part.transfers(shared.value, emissions))
                    for total, more in zip(sums, part.expected(shared.value, emissions, alpha, beta)):
                        total += more
                    likelihood += logs.sum()
                    tokens += sum(part.live)
            flat = np.rint(np.concatenate([*(s.ravel() for s in sums), [likelihood, tokens]]) * PARTS).astype(np.int64)
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

        # One row for each number that is not zero, in whole parts: partitions are added up where they are, then by number,
        # and the sum does not depend on their order.
        summed = texts.select("classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        flat = np.zeros(STATES * (1 + STATES + CLASSES) + 2)
        flat[summed["at"].to_numpy()] = summed["n"].to_numpy() / PARTS
        start, move, emit, (likelihood, tokens) = np.split(flat, [STATES, STATES * (1 + STATES), len(flat) - 2])
        chain = Chain.of_counts(start, move.reshape(STATES, STATES), emit.reshape(STATES, CLASSES), shares)
        shared.unpersist()
        if likelihood - last < gain * tokens:
            break
        last = likelihood
    return chain


def segments(batch: pa.RecordBatch) -> Iterator[Segments]:
    packed = batch.column("classes").to_pylist()
    for a, b in portions([len(p) // 2 for p in packed], TOKENS):
        yield Segments(packed[a:b])


def likelihoods(texts: DataFrame, chain: Chain) -> DataFrame:
    """(row, chain): log10 probability of the classes of each text."""
    shared = texts.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [part.entries(shared.value, *part.transfers(shared.value, part.emissions(shared.value)))[2] for part in segments(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.concatenate(totals) if totals else np.empty(0), pa.float64())], names=["row", "chain"])

    return texts.select("row", "classes").mapInArrow(run, "row long, chain double")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), "text")
    counts = stage(count_words(docs.where(~F.col("held_out"))), "counts")
    vocab = vocabulary(counts)
    texts = stage(read_texts(docs, vocab), "texts")
    chain = train(texts.where(~F.col("held_out")), vocab)

    sizes = spark.createDataFrame([(k, n, v) for k, (n, v) in vocab.class_sizes.items()] or [(FREQUENT, 0, 0)], "k int, cn long, cv long")
    pairs = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", "p.rare", "p.times")
    met = pairs.join(counts.withColumnRenamed("word", "rare"), "rare", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    met = met.withColumn("k", (F.crc32(F.col("rare").cast("binary")) % BUCKETS + FREQUENT).cast("int"))
    # One row for each class at most: the sizes are as bounded as the classes.
    met = met.join(F.broadcast(sizes), "k", "left")
    floor = vocab.total + 0.5 * (vocab.distinct + 1)
    rare = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).cast("long").alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / floor)).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / (F.coalesce("cn", F.lit(0)) + 0.5 * (F.coalesce("cv", F.lit(0)) + 1)))).alias("rare_inner"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = texts.drop("classes", "rare", "times").join(rare, "row", "left").join(likelihoods(texts, chain), "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("chain") + F.col("inner") + zero("rare_inner")).alias("score"))
