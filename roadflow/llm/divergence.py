"""How far the sources of a language differ in their words: pairs of sources, and the terms that set one apart.

Terms are runs of letters, with A-Z lower-cased; a language keeps those in at least ``MIN_DOCS`` of its documents.
A group (language, source) gives each kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N the group's
occurrences of kept terms, V the language's kept terms. Two groups differ by the sum of |p - q| over all V terms.

Count-level bitmaps: p depends on the count alone, so a group stores for each count a bitset of the terms that
have it. For a pair of groups, AND and popcount of two bitsets give how many terms have these two counts (a joint
cell), which is multiplied by |p - q| of the two counts. Count zero is the complement of all others.

* Terms are dealt by hash into chunks of about ``CHUNK`` ids, so bitsets, tasks and groups are bounded whatever V.
  In a chunk ids follow the frequency: rare terms, whose counts repeat, share words, frequent ones stand apart.
* A bitset is held as its non-zero 64-bit words; two are met word by word, so counts without common words cost nothing.
* Sources are dealt into blocks of ``BLOCK``; a task meets two blocks in one chunk, and chunks are added up.

All arithmetic is in whole numbers: counts and sums as 64-bit integers, the fraction in p by exact division of decimals.

Null texts, languages and sources count as empty; such groups are reported like others. Groups without terms take
part with zero counts; a language without kept terms gives pairs of value 0 and no terms. Repeated rows count as
often as they occur. Equal values rank by the item's UTF-8 bytes. A very long text is cut at blanks while it is
read. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .text import slices

MIN_DOCS = 30
TOP_TERMS = 50
#: Terms of a language in one chunk, about; sources in one block.
CHUNK = 32_768
BLOCK = 32
#: Entries of a task's tallies after which they are handed on.
TALLY = 300_000
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20

#: Every ASCII byte that is no letter becomes a blank, A-Z become a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SCALE = 1_000_000_000


def pieces(text: str) -> Iterator[list[bytes]]:
    """Words of a text, a piece of it at a time."""
    low = text.encode("utf-8", "surrogatepass").translate(LETTERS)
    at = 0
    while at < len(low):
        end = low.find(b" ", at + PIECE)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def tallies(docs: DataFrame) -> DataFrame:
    """(lang, source, term, own, n, docs) of the rows that a task read: occurrences and documents, to be added up.

    A null term stands for the group itself, which may have none; ``own`` then deals such rows out by source.
    """
    def flush(counts, holders) -> pa.RecordBatch:
        keys = [(lang, source, term) for (lang, source), c in counts.items() for term in c]
        n = [v for c in counts.values() for v in c.values()]
        d = [holders[group][term] for group, c in counts.items() for term in c]
        lang, source, term = zip(*keys) if keys else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()),
             pa.array([s if t is None else None for s, t in zip(source, term)], pa.string()),
             pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "own", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, holders = defaultdict(Counter), defaultdict(Counter)
        size, seen = 0, set()
        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                group = lang, source
                seen.add(group)
                tally, before, distinct = counts[group], len(counts[group]), set()
                for words in pieces(text):
                    tally.update(words)
                    distinct.update(words)
                holders[group].update(distinct)
                size += len(tally) - before
                if size > TALLY:
                    yield flush(counts, holders)
                    counts.clear(), holders.clear()
                    size = 0
            if len(seen) > TALLY:
                yield flush({g: {None: 0} for g in seen}, {g: {None: 0} for g in seen})
                seen.clear()
        yield flush(counts, holders)
        yield flush({g: {None: 0} for g in seen}, {g: {None: 0} for g in seen})

    whole = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return whole.mapInArrow(run, "lang string, source string, term string, own string, n long, docs long")


def probability(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exactly."""
    wide = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"1 + (({wide(count)} + 5) * cast({SCALE} as decimal(10,0))) div ({wide(total)} + {wide(kept)} * 5)")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by difference, and the ``top`` terms."""
    counted = stage(kept_counts(tallies(docs), min_docs), "term-counts")
    kept = counted.where("kept")
    languages = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = counted.groupBy("lang", "source").agg(F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("total"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = groups.join(totals, "lang").join(languages, "lang", "left").fillna({"v": 0})
    groups = stage(groups, "groups")
    return pair_part(kept, groups).unionByName(term_part(kept, groups, top))


def kept_counts(parts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, all_n, kept): kept terms of each group, and a row of each group without a term.

    All rows of a (lang, term) meet in one place, one for each task and source that saw it.
    """
    summed = parts.repartition("lang", "term", "own").groupBy("lang", "term", "own", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    place = Window.partitionBy("lang", "term", "own")
    whole = summed.withColumns({"all_docs": F.sum("docs").over(place), "all_n": F.sum("n").over(place)})
    whole = whole.withColumn("kept", F.col("term").isNotNull() & (F.col("all_docs") >= min_docs))
    return whole.where(F.col("kept") | F.col("term").isNull()).select("lang", "source", "term", "n", "all_n", "kept")


def term_part(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    rows = kept.where("n > 0").join(groups, ["lang", "source"])
    p, q = probability("n", "total", "v"), probability("all_n", "lang_total", "v")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).cast("long").alias("value"))
    return ranked(rows.where("value > 0")).where(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def chunked(kept: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, chunk, size) and (lang, source, chunk, id, n): ids 0.. in each chunk by falling frequency."""
    terms = kept.groupBy("lang", "term").agg(F.max("all_n").alias("all_n"))
    sizes = groups.select("lang", "v").distinct()
    chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / CHUNK)).cast("int")
    terms = terms.join(sizes, "lang").withColumn("chunk", chunk)
    order = Window.partitionBy("lang", "chunk").orderBy(F.desc("all_n"), "term")
    terms = stage(terms.select("lang", "term", "chunk", (F.row_number().over(order) - 1).alias("id")), "term-ids")
    filled = terms.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("size"))
    # A language without kept terms has one empty chunk, so its pairs come out as well.
    none = sizes.where("v = 0").select("lang", F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("size"))
    return filled.unionByName(none), kept.join(terms, ["lang", "term"]).select("lang", "source", "chunk", "id", "n")


BITMAPS = "lang string, source string, chunk int, counts array<long>, starts array<int>, places array<int>, words array<long>"


def bitmaps(rows: DataFrame) -> DataFrame:
    """Of each group and chunk: the counts that occur, and for each the places and non-zero words of its bitset.

    Words of the k-th count are ``starts[k]`` up to ``starts[k + 1]``.
    """
    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, n = part["id"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        counts, level = np.unique(n, return_inverse=True)
        place = ids >> 6
        slot, at = np.unique(level * (1 << 40) + place, return_inverse=True)
        words = np.zeros(len(slot), np.uint64)
        np.bitwise_or.at(words, at, np.uint64(1) << (ids & 63).astype(np.uint64))
        starts = np.searchsorted(slot >> 40, np.arange(len(counts) + 1))
        return pd.DataFrame([{
            "lang": key[0], "source": key[1], "chunk": key[2], "counts": counts, "starts": starts.astype(np.int32),
            "places": (slot & ((1 << 40) - 1)).astype(np.int32), "words": words.view(np.int64),
        }])

    return rows.groupBy("lang", "source", "chunk").applyInPandas(build, BITMAPS)


class Levels:
    """The bitsets of one group in one chunk, by word: place, word and p of the count; zeros by complement."""

    def __init__(self, row, size: int) -> None:
        total, v = int(row.total), int(row.v)
        weight = lambda count: 1 + SCALE * (int(count) + 5) // (total + 5 * v) if v else 0
        width = (size + 63) // 64
        rest = np.full(width, ~np.uint64(0), np.uint64)
        if size % 64:
            rest[-1] = (np.uint64(1) << np.uint64(size % 64)) - np.uint64(1)
        place, words, p = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if row.counts is not None:
            place = np.asarray(row.places, np.int64)
            words = np.asarray(row.words, np.int64).view(np.uint64)
            each = np.diff(np.asarray(row.starts, np.int64))
            p = np.repeat(np.array([weight(c) for c in row.counts], np.int64), each)
            np.bitwise_and.at(rest, place, ~words)
        zero = np.flatnonzero(rest)
        place, words = np.concatenate([place, zero]), np.concatenate([words, rest[zero]])
        p = np.concatenate([p, np.full(len(zero), weight(0), np.int64)])
        order = np.argsort(place, kind="stable")
        self.place, self.words, self.p = place[order], words[order], p[order]
        self.first = np.searchsorted(self.place, np.arange(width + 1))

    def difference(self, other: Levels) -> int:
        """Sum over all terms of the chunk: AND and popcount of the words at one place, times |p - q|."""
        low = other.first[self.place]
        met = other.first[self.place + 1] - low
        mine = np.repeat(np.arange(len(self.place)), met)
        theirs = np.arange(len(mine)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(low, met)
        cells = np.bitwise_count(self.words[mine] & other.words[theirs]).astype(np.int64)
        return int(cells @ np.abs(self.p[mine] - other.p[theirs]))


def pair_part(kept: DataFrame, groups: DataFrame) -> DataFrame:
    chunks, rows = chunked(kept, groups)
    # Blocks of sources by rank of their digest: a block of more than BLOCK sources cannot come about.
    names = Window.partitionBy("lang").orderBy("source")
    blocks = groups.withColumn("block", F.floor((F.row_number().over(names) - 1) / BLOCK).cast("int"))
    blocks = blocks.withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    members = blocks.join(chunks, "lang").join(bitmaps(rows), ["lang", "source", "chunk"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = members.select("*", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        low, high = key[2], key[3]
        size = int(part["size"].iloc[0])
        levels = [(r.source, r.block, Levels(r, size)) for r in part.sort_values("source").itertuples(index=False)]
        out = []
        for i, (a, block, mine) in enumerate(levels):
            for b, their_block, theirs in levels[i + 1:]:
                if low == high or block != their_block:
                    out.append((key[0], a, b, mine.difference(theirs)))
        return pd.DataFrame(out, columns=["lang", "a", "b", "value"])

    met = placed.groupBy("lang", "chunk", "low", "high").applyInPandas(meet, "lang string, a string, b string, value long")
    sums = met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                            F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rows = sums.select("lang", "value", both).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return ranked(rows)


def report_sql(min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= {min_docs}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
tot AS (SELECT lang, source, sum(n) AS total FROM full_c GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (CAST({SCALE} AS HUGEINT) * CAST(n + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS p
  FROM full_c JOIN tot USING (lang, source) JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (CAST({SCALE} AS HUGEINT) * CAST(n + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY ALL)
  JOIN (SELECT lang, sum(total) AS total FROM tot GROUP BY lang) USING (lang) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= {top}
"""
