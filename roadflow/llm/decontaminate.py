"""Benchmark decontamination: windows of test words found in training texts, in SQL functions only.

A window is WINDOW consecutive words of a benchmark item; an item with fewer words (but any) is one
window. A document word inside an occurrence of a window is hit.

The windows form a hash set that travels with the plan, so nothing is shuffled to find occurrences. Most
texts are settled by a coarser question: an occurrence of ten words covers one of the five-word grams that
start at every sixth word of the document, so only these are looked up; texts without one are clean. The
others are scanned window by window, comparing words and not digests. Items are joined to the few
windows that occur.

The set is used up to MAX_WINDOWS windows, which is checked. A larger benchmark takes the other way:
all windows of the documents meet it in an ordinary join, for reports, removal and cutting alike.

Null texts have no words. Null item ids take part as hits but are not listed. Repeated items count once per
distinct id. An empty benchmark hits nothing. Repeated rows and ids are judged one by one. ``remove`` and
``strip`` keep the columns of their input; internal names begin with ``_dc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import ascii_lower, let, split_words

WINDOW = 10
GRAM = 5
#: Windows that may travel with the plan; above, documents and benchmark are joined.
MAX_WINDOWS = 200_000


def run_of(words: Column, start: Column, length: int) -> Column:
    """``length`` words from ``start`` (from 0) as one string; words hold no blanks."""
    return F.concat_ws(" ", F.slice(words, start + 1, length))


def gram_key(words: Column, start: Column) -> Column:
    return F.xxhash64(*[F.get(words, start + k) for k in range(GRAM)])


def places(words: Column, length: int, step: int = 1) -> Column:
    """Every ``step``-th place where ``length`` words begin; null if there is none."""
    return F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length, F.lit(step)))


def bench_windows(bench: DataFrame) -> DataFrame:
    """(item_id, window, length) distinct."""
    items = bench.select("item_id", split_words(ascii_lower(F.col("text"))).alias("words"))
    long_ = items.select("item_id", F.explode(places(F.col("words"), WINDOW)).alias("i"), "words").select(
        "item_id", run_of(F.col("words"), F.col("i"), WINDOW).alias("window"), F.lit(WINDOW).alias("length"))
    short = items.where(F.size("words").between(1, WINDOW - 1)).select(
        "item_id", F.array_join("words", " ").alias("window"), F.size("words").alias("length"))
    return long_.union(short).distinct()


def occurrences(text: Column, windows: DataFrame, large: bool) -> Column:
    """struct<n_words, hits: array<struct<start, length, window>>> of a text.

    ``large``: all places of the document, to be joined with the benchmark.
    """
    by_length: dict[int, list[str]] = {}
    if large:
        by_length = {r["length"]: [] for r in windows.select("length").distinct().collect()}
    else:
        for r in windows.select("window", "length").distinct().collect():
            by_length.setdefault(r["length"], []).append(r["window"])
    grams = F.explode(F.transform(places(F.col("w"), GRAM), lambda i: gram_key(F.col("w"), i)))
    anchors = [] if large else [r[0] for r in windows.where(F.col("length") == WINDOW).select(
        F.split("window", " ").alias("w")).select(grams.alias("gram")).distinct().collect()]

    def hits(words: Column, length: int) -> Column:
        every = F.transform(places(words, length), lambda i: F.struct(
            i.alias("start"), F.lit(length).alias("length"), run_of(words, i, length).alias("window")))
        if large:
            return every
        found = F.filter(every, lambda h: h["window"].isin(by_length[length]))
        if length < WINDOW:
            return found
        anchored = F.exists(places(words, GRAM, GRAM + 1), lambda i: gram_key(words, i).isin(anchors))
        return F.when(anchored, found)

    none = F.expr("cast(array() as array<struct<start int, length int, window string>>)")
    return let(ascii_lower(text), lambda low: let(split_words(low), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.concat(none, *[F.coalesce(hits(words, n), none) for n in sorted(by_length)]).alias("hits"))))


def is_large(windows: DataFrame, most: int) -> bool:
    return windows.count() > most


def covered(spans: Column) -> Column:
    """How many places an array of distinct struct<start, length> covers."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), zero, lambda acc, s: let(
        F.greatest(acc["end"], s["start"] + s["length"]), lambda end: F.struct(
            end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], s["start"])).cast("long").alias("n"))))["n"]


def scan(docs: DataFrame, bench: DataFrame, most: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of each row: hit words, and ids of the items whose windows occur."""
    windows = stage(bench_windows(bench), "windows")
    large = is_large(windows, most)
    found = docs.select(F.monotonically_increasing_id().alias("_dc_row"), "doc_id", occurrences(F.col("text"), windows, large).alias("_dc"))
    each = found.select("_dc_row", "doc_id", F.col("_dc.n_words").alias("n_words"), F.explode_outer("_dc.hits").alias("hit"))
    each = each.select("_dc_row", "doc_id", "n_words", "hit.window", F.struct("hit.start", "hit.length").alias("span"))
    known = windows.groupBy("window").agg(F.collect_set("item_id").alias("ids"))
    # At most ``most`` pairs of item and window travel to the rows: a window that many documents hold loads no task.
    joined = each.join(known if large else F.broadcast(known), "window", "left")
    rows = joined.groupBy("_dc_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("ids").isNotNull(), F.col("span"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"))
    return rows.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), "items")


def report(scanned: DataFrame) -> DataFrame:
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, bench: DataFrame, most: int = MAX_WINDOWS) -> DataFrame:
    """The documents without any hit word."""
    windows = stage(bench_windows(bench), "windows")
    if not is_large(windows, most):
        return docs.where(F.size(occurrences(F.col("text"), windows, False)["hits"]) == 0)
    each = docs.select(F.sha2("text", 256).alias("_dc_text"), F.explode(occurrences(F.col("text"), windows, True)["hits"]["window"]).alias("window"))
    hit = each.join(windows.select("window").distinct(), "window", "left_semi").select("_dc_text").distinct()
    keyed = docs.withColumn("_dc_text", F.sha2("text", 256))
    return keyed.join(hit, "_dc_text", "left_anti").select(*docs.columns)


def strip(docs: DataFrame, bench: DataFrame, most: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with the hit words, and the separators before them, cut out of ``text``."""
    windows = stage(bench_windows(bench), "windows")
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"({gap}{word})"), 1)

    def rest(hits: Column) -> Column:
        kept = F.filter(pieces, lambda _, i: ~F.exists(hits, lambda h: (i >= h["start"]) & (i < h["start"] + h["length"])))
        return F.concat(F.array_join(kept, ""), F.regexp_extract("text", f"({gap})$", 1))

    if not is_large(windows, most):
        return docs.withColumn("text", let(occurrences(F.col("text"), windows, False), lambda o: F.when(
            F.size(o["hits"]) > 0, rest(o["hits"])).otherwise(F.col("text"))))
    # Spans of a text are a set, so copies of it add none.
    each = docs.select(F.sha2("text", 256).alias("_dc_text"), F.explode(occurrences(F.col("text"), windows, True)["hits"]).alias("_dc_hit"))
    hits = each.select("_dc_text", "_dc_hit.*").join(windows.select("window").distinct(), "window", "left_semi").groupBy("_dc_text").agg(
        F.collect_set(F.struct("start", "length")).alias("_dc_hits"))
    met = docs.withColumn("_dc_text", F.sha2("text", 256)).join(hits, "_dc_text", "left")
    cut = F.when(F.col("_dc_hits").isNotNull(), rest(F.col("_dc_hits"))).otherwise(F.col("text"))
    return met.withColumn("text", cut).select(*docs.columns)
