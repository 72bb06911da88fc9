"""Token counts of texts with a cache of digests: a content met before is never encoded again.

Every text gets two digests: one of its normalised content, one of the tokenizer's version. A table in the shared
folder holds the count for each pair met so far. Contents that it lacks are reduced to one text a digest, encoded
and appended; then every row takes its count from the table.

* Normalised content: runs of ASCII white space become one blank, none stay at the ends. The tokenizers this
  module accepts drop white space, so texts of one normalised content have one count.
* Tokenizer version: the vocabulary file, the library's version and the rule above.

Pieces (words, digits, other runs) that a worker has met keep their count in a bounded memo, and the tokenizers
library encodes new ones; a part with letters beyond the Latin blocks is handed to the library whole.

Null texts count as empty: 0 bytes, 0 tokens. Repeated rows all come back. A text of any length is encoded whole;
one text must fit a worker. Only the columns in ``keep`` are carried (one named like a result is refused), so other
columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .text import join_unique, slices, worker_slot

#: Version of ``normalised``; part of the tokenizer's version.
RULE = "ascii white space 1"
#: Pieces that one of the two generations of a worker's memo holds.
CACHED = 200_000
#: Tokens above which a document is over its limit.
LIMIT = 2048

CACHE = "tokenizer string, digest binary, n_tokens long"
RESULTS = ("n_bytes", "n_tokens", "over_limit")

# Fixed value: the split of the vocabulary file, whose pieces are encoded on their own.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+", " "), F.lit(" "))


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def plain_pieces() -> tuple[re.Pattern, re.Pattern]:
    """A pattern for characters beyond those known by rule, and the vocabulary's split over the known ones.

    Known are the Latin blocks and common punctuation: there lower case is one character for one, composition
    changes nothing and the classes are the same in every Unicode version.
    """
    blocks = list(map(chr, [*range(0x250), *range(0x2010, 0x2028)]))
    known = [c for c in blocks if c.lower() in blocks and unicodedata.category(c) != "Cn"]
    kind = {c: unicodedata.category(c)[0] for c in known}
    blank = {c for c in known if c in "\t\n\v\f\r \x85" or kind[c] == "Z"}
    group = lambda keep: "".join(map(re.escape, filter(keep, known)))
    letters, numbers = group(lambda c: kind[c] == "L"), group(lambda c: kind[c] == "N")
    others = group(lambda c: kind[c] not in "LN" and c not in blank)
    return (re.compile(f"[^{group(lambda c: True)}]"),
            re.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", f"[{others}]").replace(r"\p{L}", letters).replace(r"\p{N}", numbers)))


class Counter:
    """Token counts of normalised contents with one vocabulary."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are what runs side by side
        from tokenizers import Tokenizer

        check(spec)
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        special = sorted((t["content"] for t in json.loads(spec)["added_tokens"]), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.beyond, self.pieces = plain_pieces()
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: set[str]) -> None:
        """Counts of ``pieces`` into the memo; older ones go when a generation is full."""
        missing = pieces.difference(self.new)
        if missing and len(self.new) + len(missing) > CACHED:
            self.old, self.new, missing = self.new, {}, pieces
        unknown = []
        for p in missing:
            known = self.old.get(p)
            if known is None:
                unknown.append(p)
            else:
                self.new[p] = known
        if unknown:
            # One call for all: blanks keep pieces apart, and tokens know the piece they are of.
            piece = self.library.encode(" ".join(unknown), add_special_tokens=False).word_ids
            self.new.update(zip(unknown, np.bincount(piece, minlength=len(unknown)).tolist()))

    def count(self, text: str) -> int:
        total = 0
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                total += 1
            elif part and self.beyond.search(part):
                total += self.whole([part])[0]
            elif part:
                pieces = self.pieces.findall(part.lower())
                self.learn(set(pieces))
                total += sum(map(self.new.__getitem__, pieces))
        return total


def check(spec: str) -> None:
    """Refuse a vocabulary whose counts could depend on white space or on what stands around a piece."""
    given = json.loads(spec)
    normal = [n["type"] for n in (given["normalizer"] or {}).get("normalizers", [])]
    split = (given["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    if (given["model"]["type"] != "BPE" or given["model"].get("dropout") or normal != ["NFC", "Replace", "Lowercase"]
            or split.get("pattern") != {"Regex": SPLIT} or split.get("behavior") != "Removed" or given["post_processor"]
            or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in given["added_tokens"])):
        raise ValueError("a word-end BPE vocabulary is needed that lower-cases, cuts into pieces and drops white space")


def tokenizer_version(spec: str) -> str:
    import tokenizers

    return hashlib.sha256("\n".join([RULE, tokenizers.__version__, spec]).encode()).hexdigest()


def known_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version. Jobs that ran side by side may have stored a digest twice."""
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append(counts: DataFrame, cache: str) -> None:
    counts.write.mode("append").partitionBy("tokenizer").parquet(cache)


def count_tokens(docs: DataFrame, spec: str, cache: str, keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """``keep`` of every row of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` of its ``text``.

    ``spec`` is the vocabulary file's text, ``cache`` the folder of the table of counts; it need not exist yet.
    """
    if clash := sorted(set(keep) & {*RESULTS, "digest"}):
        raise ValueError(f"columns {clash} are names of results")
    check(spec)
    spark, version = docs.sparkSession, tokenizer_version(spec)
    content = docs.select(digest(normalised(F.col("text"))).alias("digest"), normalised(F.col("text")).alias("content"))
    rows = stage(docs.select(*keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                             digest(normalised(F.col("text"))).alias("digest")), "digests")
    append(spark.createDataFrame([], CACHE), cache)
    known = known_counts(spark, cache, version)
    if not rows.select("digest").distinct().join(known, "digest", "left_anti").isEmpty():
        # One text of each digest leaves a task, so copies cost no more than their rows.
        misses = content.dropDuplicates(["digest"]).join(known, "digest", "left_anti")
        append(encoded(misses, spec, version), cache)
        known = known_counts(spark, cache, version)
    counted = join_unique(rows, known, "digest").drop("digest")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def encoded(contents: DataFrame, spec: str, version: str) -> DataFrame:
    """Rows of the cache for (digest, content)."""
    shared = contents.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_slot(("token counts", version), lambda: Counter(shared.value))
        for batch in slices(batches):
            counts = np.fromiter(map(counter.count, batch.column("content").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * batch.num_rows, pa.string()), batch.column("digest"), pa.array(counts)],
                names=["tokenizer", "digest", "n_tokens"])

    return contents.select("digest", "content").mapInArrow(run, CACHE)
