"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

1. quality: documents that the quality model rejects go.
2. toxicity: documents that the toxicity model calls toxic go.
3. near duplicates: one document of each group of similar texts stays.
4. decontamination: documents that hold a window of the benchmark go.
5. tokens: what is left as ids of a byte-level vocabulary, with the text they decode to.

The models learn from the labelled rows of ``documents`` that are not held out, whatever an earlier stage kept.
All stages but the last return the columns of ``documents``; it adds ``n_tokens``, ``tokens`` and ``decoded``, with an
underscore behind a name that the documents have already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.llm import bpe, decontaminate, neardup, quality, toxicity
from roadflow.llm.queries import vocabulary_file
from roadflow.llm.text import free_name, prepared, table
from roadflow.session import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(prepared(spark), sf_dir, table(spark, sf_dir, "documents"))
    name = free_name("quality", docs.columns)
    return quality.score(docs, model, name).where(F.col(name) >= quality.ACCEPT).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(prepared(spark), sf_dir, table(spark, sf_dir, "documents"))
    name = free_name("toxicity", docs.columns)
    return toxicity.score(docs, model, name).where(F.col(name) < toxicity.REJECT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(prepared(spark), sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    tokens, decoded, n = (free_name(name, docs.columns) for name in ("tokens", "decoded", "n_tokens"))
    coded = bpe.round_trip(docs, vocabulary_file(), tokens, decoded)
    return coded.select(*docs.columns, F.size(tokens).alias(n), tokens, decoded)


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("tokens", to_tokens),
]

#: The first two stages are trained models; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"corpus-{name}")
    return docs
