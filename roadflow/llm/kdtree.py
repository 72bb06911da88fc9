"""Exact top-k by inner product: KD-trees per shard, best-first traversal with box bounds.

Components become integers, floor(SCALE * x). A shard is up to SHARD vectors of one length in a partition: split at
the median of the widest side until LEAF vectors are left, each node with its tight bounding box. Trees are
built once and written; every block of queries reads them. The
largest score that a box allows is sum(max(q * low, q * high)). A query visits the nodes of a
tree in the order of that bound and stops below its kth best score so far, which it takes along from one
tree to the next of its task and, to begin with, from a first round that looks into the best leaf of every
shard only. Equal scores go to the smaller id, so boxes that reach the kth score exactly are still visited.

Queries are handled in blocks of QUERIES, each broadcast (its size is a constant); each block meets every
row. Partitions return k rows for a query, and a grouped top-k joins them.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids. A vector meets
those of its own length, as there is no inner product with others. Rows that repeat an id are rows of their own: each
is a candidate for all but itself, and each that is asked for has its own results under its id. An empty table gives
an empty result; fewer than k candidates give all of them.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

SCALE = 1024
SHARD = 4096
LEAF = 64
QUERIES = 2048
K = 10
FOUND = "query long, query_id long, vec_id long, score long"
_LEAST = np.iinfo(np.int64).min


class Tree:
    """A KD-tree over integer vectors: (id, row, point), a leaf's rows one behind the other.

    Points are kept in the smallest integers that hold them and score as doubles, whose sums of products stay
    exact below 2^53.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, nodes: np.ndarray) -> None:
        self.ids, self.rows, self.points, self.low, self.high = ids, rows, points.astype(np.float64), low, high
        #: First and last row and the two children of each node; a leaf has no children (0).
        self.nodes = nodes.tolist()

    @staticmethod
    def build(ids: np.ndarray, rows: np.ndarray, points: np.ndarray) -> Tree:
        low, high, nodes, order = [], [], [], []

        def split(own: np.ndarray) -> int:
            me, inside = len(nodes), points[own]
            low.append(inside.min(axis=0))
            high.append(inside.max(axis=0))
            start, side = len(order), high[me].astype(float) - low[me]
            nodes.append([start, start + len(own), 0, 0])
            if len(own) <= LEAF or not side.any():
                order.extend(own.tolist())
            else:
                middle = len(own) // 2
                cut = np.argpartition(inside[:, side.argmax()], middle)
                nodes[me][2:] = split(own[cut[:middle]]), split(own[cut[middle:]])
            return me

        split(np.arange(len(ids)))
        return Tree(ids[order], rows[order], points[order], np.array(low, np.float64), np.array(high, np.float64), np.array(nodes))

    def packed(self) -> bytes:
        end = max(-self.low[0].min(), self.high[0].max())
        small = next((t for t in (np.int16, np.int32) if end <= np.iinfo(t).max), np.int64)
        out = io.BytesIO()
        np.savez(out, ids=self.ids, rows=self.rows, points=self.points.astype(small), low=self.low, high=self.high, nodes=np.array(self.nodes))
        return out.getvalue()

    @staticmethod
    def unpacked(content: bytes) -> Tree:
        with np.load(io.BytesIO(content)) as parts:
            return Tree(**parts)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest score of each query (row) in each node's box (column)."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def scores(self, node: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, _, _ = self.nodes[node]
        return (self.points[a:b] @ query).astype(np.int64), self.ids[a:b], self.rows[a:b]

    def best_leaf(self, bounds: np.ndarray) -> int:
        node = 0
        while self.nodes[node][2]:
            _, _, a, b = self.nodes[node]
            node = a if bounds[a] >= bounds[b] else b
        return node


class Best:
    """The k best (score, id) of one query row, ties to smaller ids, and the score that must be reached."""

    def __init__(self, k: int, own: int, floor: int) -> None:
        self.k, self.own, self.floor = k, own, floor
        self.found: list[tuple[int, int]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.floor) & (rows != self.own))
        if len(at):
            self.found += zip(scores[at].tolist(), (-ids[at]).tolist())
            self.found = heapq.nlargest(self.k, self.found)
            if len(self.found) == self.k:
                self.floor = max(self.floor, self.found[-1][0])


def search(tree: Tree, bounds: np.ndarray, query: np.ndarray, best: Best) -> None:
    heap = [(-bounds[0], 0)]
    while heap and -heap[0][0] >= best.floor:
        _, node = heapq.heappop(heap)
        _, _, *children = tree.nodes[node]
        if children[0]:
            for child in children:
                if bounds[child] >= best.floor:
                    heapq.heappush(heap, (-bounds[child], child))
        else:
            best.add(*tree.scores(node, query))


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, id, point): each row with an id and a finite vector, numbered, in integers."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & finite)
    point = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    # Numbers are given once: the written rows keep them.
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), point.alias("point")), "vectors")


def planted(rows: DataFrame) -> DataFrame:
    """(size, tree): the packed trees over all rows, one for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def grown(size: int) -> pa.RecordBatch:
            parts = [np.concatenate(p) for p in zip(*waiting.pop(size))]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([Tree.build(*parts).packed()], pa.binary())], names=["size", "tree"])

        for whole in batches:
            for at in range(0, whole.num_rows, SHARD):
                batch = whole.slice(at, SHARD)
                sizes = pc.list_value_length(batch.column("point")).to_numpy(zero_copy_only=False)
                for size in np.unique(sizes).tolist():
                    part = batch.filter(pa.array(sizes == size))
                    waiting.setdefault(size, []).append(
                        (part.column("id").to_numpy(), part.column("row").to_numpy(), part.column("point").flatten().to_numpy().reshape(-1, size)))
                    if sum(len(w[0]) for w in waiting[size]) >= SHARD:
                        yield grown(size)
        for size in list(waiting):
            yield grown(size)

    return stage(rows.mapInArrow(run, "size int, tree binary"), "trees")


class Block:
    """Queries with vectors of one length: rows, ids, points, and the scores to reach."""

    def __init__(self, asked: list) -> None:
        self.rows = [r["row"] for r in asked]
        self.ids = [r["id"] for r in asked]
        self.points = np.array([r["point"] for r in asked], np.float64)
        self.floors = [_LEAST] * len(asked)


def search_all(trees: DataFrame, blocks: dict[int, Block], k: int, first: bool) -> DataFrame:
    """(query, query_id, vec_id, score): k best of each query row in each partition.

    ``first``: only the best leaf of each shard.
    """
    shared = trees.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        best = {size: [Best(k, row, floor) for row, floor in zip(b.rows, b.floors)] for size, b in blocks.items()}
        for batch in batches:
            for size, content in zip(batch.column("size").to_pylist(), batch.column("tree")):
                if size in blocks:
                    tree, queries = Tree.unpacked(content.as_py()), blocks[size].points
                    bounds = tree.bounds(queries)
                    for q, mine in enumerate(best[size]):
                        if first:
                            mine.add(*tree.scores(tree.best_leaf(bounds[q]), queries[q]))
                        else:
                            search(tree, bounds[q], queries[q], mine)
        found = [(b.own, query_id, -i, s) for size, mine in best.items() for b, query_id in zip(mine, blocks[size].ids) for s, i in b.found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[c] for f in found], pa.int64()) for c in range(4)], names=["query", "query_id", "vec_id", "score"])

    return trees.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for which ``is_query`` (over ``id``) holds."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    rows = usable(vectors, id_col, vector_col, scale)
    asked, trees, results, last = rows.where(is_query), planted(rows), [], None
    while True:
        page = asked if last is None else asked.where(F.col("row") > last)
        block = page.orderBy("row").limit(QUERIES).collect()
        if not block:
            break
        last = block[-1]["row"]
        sizes = sorted({len(r["point"]) for r in block})
        blocks = {size: Block([r for r in block if len(r["point"]) == size]) for size in sizes}
        # The kth score over the best leaves: any k candidates give a bound that the result reaches.
        ranked = search_all(trees, blocks, k, True).withColumn("rank", rank)
        reached = {r["query"]: r["score"] for r in ranked.where(F.col("rank") == k).select("query", "score").collect()}
        for b in blocks.values():
            b.floors = [reached.get(row, _LEAST) for row in b.rows]
        results.append(stage(search_all(trees, blocks, k, False), "found"))
    found = results[0] if results else rows.sparkSession.createDataFrame([], FOUND)
    for more in results[1:]:
        found = found.union(more)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
