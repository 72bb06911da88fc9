"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in SQL functions only.

Every shard owns VNODES points of a ring. A row falls on the ring by the digest of its id, size and text
digest and belongs to the shard of the next point clockwise. A shard takes its share of rows and no more
(shares differ by one at most); rows that meet a full shard go on clockwise to the next shard with room.

Rows between two points all see the same shards in the same order, so who overflows is decided for counts
of arcs: one aggregate yields a count for each arc (shards x VNODES numbers, whatever the data), a small
loop hands out the room, and the rows of an arc are divided by their rank in it. Ranks come from a window
over each arc of rows that are counted first: equal rows are one row there, so no repeated row, however
common, makes a partition large.

Null ids and texts take part (a null text has size 1 and digest 0). Rows equal in id, size and digest
are interchangeable; they get the places of as many rows. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

SHARDS = 16
VNODES = 128
_DIGITS = 12  # hexadecimal digits of a place on the ring: exact in a long and in a double


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes in clockwise order. A shard's points do not depend on the others."""
    points = ((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:_DIGITS], 16), s)
              for s in range(shards) for v in range(vnodes))
    return sorted(points)


def place(*cols: Column) -> Column:
    """The place of a row on the ring: the first digits of a digest of its columns."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")


def longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def arc_of(at: Column, points: list[tuple[int, int]]) -> Column:
    """Number of the first point at or after ``at``; past the last one the ring closes."""
    edges = longs([p for p, _ in points])
    # A binary search by halving steps: as many comparisons as the number of points has binary digits.
    step = 1 << (len(points) - 1).bit_length()
    steps = F.array(*[F.lit(1 << k) for k in range(step.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda n, s: F.when(
        (n + s <= len(points)) & F.coalesce(F.get(edges, n + s - 1) < at, F.lit(False)), n + s).otherwise(n))
    return F.pmod(found, F.lit(len(points)))


def shares(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hand_out(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, shard, first rank, count, first slot): who takes which ranks of each arc.

    Rounds, as if all arcs walked clockwise in step: in round k every arc offers what it has left to
    the k-th shard on its way, and a shard that is asked for more than its room takes from the arcs in
    ring order. Rows stay with the owner of their arc as long as that one has room.
    """
    room = shares(sum(counts.values()), shards)
    ways = {}
    for arc in counts:
        ways[arc] = list(dict.fromkeys(points[(arc + k) % len(points)][1] for k in range(len(points))))
    taken, given, slots, out = dict.fromkeys(counts, 0), dict(counts), [0] * shards, []
    for k in range(shards):
        for arc in sorted(given):
            shard = ways[arc][k]
            n = min(given[arc], room[shard])
            if n:
                out.append((arc, shard, taken[arc], n, slots[shard]))
                taken[arc], given[arc] = taken[arc] + n, given[arc] - n
                room[shard], slots[shard] = room[shard] - n, slots[shard] + n
    return out


def assign(rows: DataFrame, keys: list[str], shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """``rows`` (of ``keys``) with ``shard``, ``slot`` (gapless from 0 in each shard) and ``home`` (the owner)."""
    points = ring(shards, vnodes)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("copies"))
    counted = counted.withColumn("at", place(*[F.col(k) for k in keys])).withColumn("arc", arc_of(F.col("at"), points))
    counts = {r["arc"]: r["n"] for r in counted.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}
    table = hand_out(counts, points, shards)
    spark = rows.sparkSession
    room = spark.createDataFrame(table, "arc int, shard int, first long, n long, slot long")
    before = Window.partitionBy("arc").orderBy("at", *keys).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("start", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    # Ranks start .. start + copies - 1 of the arc, cut where a shard is full.
    first, last = F.greatest("start", "first"), F.least(F.expr("start + copies"), F.expr("first + n"))
    pieces = ranked.join(F.broadcast(room), "arc").where(first < last)
    home = F.get(longs([s for _, s in points]), F.col("arc")).cast("int")
    return pieces.select(*keys, "shard", home.alias("home"), F.explode(F.sequence(
        F.col("slot") + first - F.col("first"), F.col("slot") + last - F.col("first") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, home) of each row: counts at most one apart."""
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    placed = assign(stage(rows, "sizes"), ["doc_id", "size", "text_crc32"], shards, vnodes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home")
