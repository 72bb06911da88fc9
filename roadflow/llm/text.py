"""What several operators share: words, digests, held-out rows, one-time sub-expressions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Word characters are digits, lower-case a-z and everything outside ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case. Null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def split_words(lowered: Column) -> Column:
    """Words of a lower-cased text; the split leaves empty strings at its ends only."""
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once.

    A column used inside a lambda can be inlined into it and then runs again for every
    element; the variable of an enclosing lambda cannot.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strings(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def held_out(doc_id: Column, parts: int) -> Column:
    return remainder(doc_id, parts) == 1


def byte_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased: what bytes do by themselves."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings of the jobs and small Arrow batches: a row can be a long text."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


_slot: dict = {}


def worker_slot(key, build: Callable):
    """What ``build`` gives, kept in the worker under ``key`` until another key is asked for.

    A worker lives through many tasks and operators; one slot for all keeps its memory bounded.
    """
    if key not in _slot:
        _slot.clear()
        _slot[key] = build()
    return _slot[key]


def forget() -> None:
    _slot.clear()


def give_back() -> None:
    """Hand memory that this process no longer uses back to the system: after training, say, where libraries keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as no column in ``taken`` has."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time: texts become Python objects only as long as they are worked on."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def labelled(spark: SparkSession, folder: str, docs: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` training texts with their label, as (text, y).

    Rows whose id leaves remainder 1 of 3 are never used. Above the bound the rows with
    the smallest id digest are taken, the same ones at every run. A document labelled
    twice counts with its larger label.
    """
    marks = (
        table(spark, folder, "labels")
        .where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "y")


def join_unique(rows: DataFrame, facts: DataFrame, key: str, heavy: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each key of ``rows``.

    A key that at least one in ``heavy`` rows holds would load one task; there are at most ``heavy`` such keys
    whatever the input, so their facts are broadcast and only the other rows move.
    """
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * heavy >= rows.count())
    often = stage(often.select(key), "heavy-keys")
    near = rows.join(F.broadcast(facts.join(F.broadcast(often), key)), key)
    far = rows.join(F.broadcast(often), key, "left_anti").join(facts, key)
    return near.unionByName(far)
