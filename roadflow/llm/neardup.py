"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

Documents are linked when the Jaccard similarity of their shingle sets reaches a
threshold (five-word shingles and 0.8 unless told otherwise); a group is what links reach.

* **Sketch** (Dahlgaard, Knudsen and Thorup, "Fast similarity sketching"): in round i every
  shingle is thrown into one of t bins with value i + v, each bin keeps its smallest value,
  and rounds go on until no bin is empty. After t rounds of random bins, round t + b throws
  everything into bin b, so every coordinate fills. A large set fills in a few rounds.
* **Banding**: BANDS x ROWS coordinates. A pair of similarity 0.8 shares no band with
  probability (1 - 0.8^ROWS)^BANDS, 5e-7 here.
* **Verification** counts the intersection of the full sets.

Copies collapse before anything else: nodes are distinct shingle sets, found by a 128-bit
digest. A bucket is linked through its smallest member (a star), never as all pairs. Members
that verification leaves in different groups are compared again inside the bucket, in blocks of
bounded size, by their sketches and then by packed sets, and verified where these agree. So no
link between different texts is lost that would join two groups.

``one_of_each`` passes other columns through; its own name begins with ``_nd``. Null or empty texts, and texts without words, have an empty set and are linked with nothing.
Repeated rows fall in one group. A null doc_id takes part; it names a group only if no id is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import connected_components
from .text import byte_words, forget

WORDS = 5
PERCENT = 80
ROWS, BANDS = 6, 48
SIZE = ROWS * BANDS
#: Rows of a bucket in a part of it; a block holds two parts at most.
PART = 1024
#: Cells that one vectorised step of rounds may touch.
STEP = 2600

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    found = byte_words(text)
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(words, len(w))
    last = len(w) - width + 1
    out = w[:last] + np.uint64(width)
    for k in range(1, width):
        out *= _GOLD
        out ^= w[k : k + last]
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketch(items: np.ndarray, size: int = SIZE) -> np.ndarray:
    """``size`` coordinates of a non-empty set; equal with the probability of the Jaccard similarity."""
    bins = np.full(size, _EMPTY)
    start, n = 0, len(items)
    while start < size:
        rounds = np.arange(start, min(size, start + max(1, STEP // n)), dtype=np.uint64)
        h = mix(items[None, :] + ((rounds + np.uint64(1)) * _GOLD)[:, None])
        to = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        value = (h & np.uint64(0xFFFFFFFF)) | (rounds << np.uint64(32))[:, None]
        np.minimum.at(bins, to.ravel().astype(np.int64), value.ravel())
        start += len(rounds)
        if bins.max() != _EMPTY:
            return bins
    for b in np.flatnonzero(bins == _EMPTY):
        at = np.arange(size + b, size + b + 1, dtype=np.uint64)
        h = mix(items + (at + np.uint64(1)) * _GOLD)
        bins[b] = (h & np.uint64(0xFFFFFFFF)).min() | (at << np.uint64(32))[0]
    return bins


def band_keys(bins: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each sketch (one sketch a row); the band's number is part of it."""
    parts = bins.reshape(len(bins), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        key = mix(key * _GOLD + parts[:, :, k] + np.uint64(1))
    return key.view(np.int64)


def digest(items: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(items.tobytes()) if len(items) else None


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def row_key():
    """Names a row for a later look at its text; rows equal in id and text may share it."""
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, n, node, bands, marks) of each row. node: digest of its set, null if empty;
    marks: one byte of each coordinate, to estimate similarities."""
    none = np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
                # Sets of up to three can only match equal sets, which share a node already.
                large = [i for i, s in enumerate(sets) if len(s) > 3]
                bands, marks = [none] * len(sets), [None] * len(sets)
                if large:
                    bins = np.stack([sketch(sets[i]) for i in large])
                    for i, keys, low in zip(large, band_keys(bins), (bins & np.uint64(255)).astype(np.uint8)):
                        bands[i], marks[i] = keys, low.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(map(digest, sets), pa.binary()), lists(bands), pa.array(marks, pa.binary())],
                    names=["doc_id", "key", "n", "node", "bands", "marks"])

    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(
        run, "doc_id long, key long, n long, node binary, bands array<long>, marks binary")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, items, low): the full set of each row, for verification, and its low 32 bits, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = [shingle_set(t, words) for t in whole.slice(at, 500).column("text").to_pylist()]
                low = [np.unique(s.astype(np.uint32)).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(digest, sets), pa.binary()), lists(sets), pa.array(low, pa.binary())], names=["node", "items", "low"])

    return docs.select("text").mapInArrow(run, "node binary, items array<long>, low binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent`` per cent similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    common = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", common.alias("common"), (F.size("items_a") + F.size("items_b")).alias("sizes"))
            .where(f"100 * common >= {percent} * (sizes - common)").select("a", "b"))


def sizes_allow(a: str, b: str, percent: int):
    """Needed for a link: the smaller set has ``percent`` per cent of the larger one's size."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def close_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) inside a block that are in different groups and almost surely similar enough.

    ``blocks``: bucket, lo, hi, part, node, n, root, marks, bands, low. A block compares part lo with part hi
    of a bucket, about 2 * PART rows. A pair is looked at in the first bucket that it shares. The estimate from
    SIZE coordinates has a deviation of 0.024 at 0.8 and sorts out pairs more than five deviations
    below the threshold; for the rest the low halves of the full sets are counted, which can only
    miss what collides in 32 bits, and twice that is allowed for.
    """
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / SIZE) ** 0.5
    keys = ["bucket", "lo", "hi"]

    def pairs(g: dict[str, np.ndarray]) -> Iterator[tuple[bytes, bytes]]:
        part, n, root, node, sets = g["part"], g["n"], g["root"], g["node"], g["low"]
        order = np.arange(len(n))
        for i in order:
            other = (root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            # Within one part each pair once; between two parts from the lower one.
            other &= (order > i) if g["lo"][0] == g["hi"][0] else (part > part[i])
            at = np.flatnonzero(other)
            at = at[(g["marks"][at] == g["marks"][i]).mean(axis=1) >= least]
            same = g["bands"][at] == g["bands"][i]
            at = at[g["bands"][i][same.argmax(axis=1)] == g["bucket"][i]]
            if len(at):
                own, many = sets[i], np.concatenate([sets[j] for j in at])
                found = own[np.minimum(np.searchsorted(own, many), len(own) - 1)] == many
                common = np.add.reduceat(found, np.cumsum([0] + [len(sets[j]) for j in at[:-1]]))
                spare = 2 + n[i] ** 2 // 2**31
                for j in at[(100 + percent) * (common + spare) >= percent * (n[at] + n[i])]:
                    yield (node[i], node[j]) if node[i] < node[j] else (node[j], node[i])

    def flush(group: dict[str, np.ndarray]) -> pa.RecordBatch:
        found = list(pairs(group))
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

    def objects(values: list) -> np.ndarray:
        out = np.empty(len(values), object)
        out[:] = values
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for whole in batches:
            for at in range(0, whole.num_rows, PART):
                batch = whole.slice(at, PART)
                now = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in [*keys, "part", "n"]}
                now |= {k: objects(batch.column(k).to_pylist()) for k in ("node", "root")}
                now["marks"] = np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint8).reshape(-1, SIZE)
                now["bands"] = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
                low = np.empty(batch.num_rows, object)
                for k, packed in enumerate(batch.column("low").to_pylist()):
                    low[k] = np.frombuffer(packed, np.uint32)
                now["low"] = low
                if kept is not None:
                    now = {k: np.concatenate([kept[k], now[k]]) for k in now}
                change = np.any([now[k][1:] != now[k][:-1] for k in keys], axis=0)
                cuts = [0, *(np.flatnonzero(change) + 1)]
                for a, b in zip(cuts, cuts[1:]):
                    yield flush({k: v[a:b] for k, v in now.items()})
                kept = {k: v[cuts[-1] :] for k, v in now.items()}
        if kept is not None:
            yield flush(kept)

    placed = blocks.repartition(*keys).sortWithinPartitions(*keys, "node")
    return placed.mapInArrow(run, "a binary, b binary").distinct()


def find_links(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) between nodes, enough to join all that belong together."""
    nodes = stage(
        rows.where("marks is not null").groupBy("node")
        .agg(F.first("n").alias("n"), F.first("key").alias("key"), F.first("bands").alias("bands"),
             F.first("marks").alias("marks")), "nodes")
    members = nodes.select(F.explode("bands").alias("bucket"), "node", "n")
    first = members.groupBy("bucket").agg(
        F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last"), F.count("*").alias("size"))
    first = first.where("first.node <> last").select("bucket", "first", "size")
    shared = stage(members.join(first, "bucket"), "shared")

    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("key")
    texts = docs.select("text", row_key().alias("key")).join(wanted, "key", "left_semi")
    sets = stage(shingle_sets(texts, words).groupBy("node").agg(
        F.first("items").alias("items"), F.first("low").alias("low")), "sets")

    star = shared.where(sizes_allow("n", "first.n", percent) & (F.col("node") != F.col("first.node")))
    star = star.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(verified(star, sets, percent), "links")

    # Members that the star leaves in different groups.
    roots = connected_components(links)
    placed = shared.join(roots, "node", "left").select(
        "bucket", "node", "n", "size", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    parts = F.ceil(F.col("size") / PART).cast("int")
    rest = placed.join(split.select("bucket"), "bucket", "left_semi").select(
        "bucket", "node", "n", "root", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    blocks = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")).select(
        "bucket", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), "part", "node", "n", "root")
    looks = nodes.select("node", "marks", "bands").join(sets.select("node", "low"), "node")
    more = close_pairs(blocks.join(looks, "node"), percent)
    return links.union(stage(verified(stage(more, "close"), sets, percent), "links"))


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, key) of each row of ``docs`` (doc_id, text)."""
    return rooted(docs, words, percent).drop("root")


def rooted(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``groups`` with ``root``, which tells groups of one smallest id apart."""
    rows = stage(sketches(docs, words), "sketches")
    roots = connected_components(find_links(docs, rows, words, percent))
    placed = rows.select("doc_id", "n", "node", "key").join(roots, "node", "left").select(
        "doc_id", "n", "node", "key", F.coalesce("root", "node").alias("root"))
    names = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("name"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("name"))
    return placed.join(names, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "key", "root")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id, and of several with this id the one
    with the smallest key. Rows without words stay, and so does a group without any id, as it cannot be named. Rows
    equal in id and text count as one."""
    found = rooted(docs, words, percent)
    alone = F.col("n_shingles").eqNullSafe(0) | F.col("component_id").isNull()
    keep = found.where(F.col("kept") & ~alone).groupBy("root").agg(F.min("key").alias("key")).select("key")
    keep = keep.union(found.where(alone).select("key")).distinct()
    return (docs.withColumn("_nd_key", row_key()).join(keep.withColumnRenamed("key", "_nd_key"), "_nd_key", "left_semi")
            .dropDuplicates(["_nd_key", "doc_id"]).select(*docs.columns))
