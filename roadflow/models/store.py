"""Model tables, and the metrics and search results that go with them, stored by name, in versions.

A version is a folder of its own that is never changed. What is current is told by a table of pointers, to which a
row is appended when the version is complete: a reader sees the last complete version, whatever happens to a
writer. Models are numbers and arrays, so a stored one forecasts like the one that was fitted.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fit import MODEL_TYPE

POINTER = "name string, version string, models long"


def _folder(folder: str, name: str) -> str:
    if not name or not name.replace("-", "").replace("_", "").replace(".", "").isalnum() or name.startswith("."):
        raise ValueError(f"model name {name!r}: letters, digits, dots, dashes and underscores only")
    return f"{folder.rstrip('/')}/{name}"


def save(models: DataFrame, folder: str, name: str, kind: str = "parquet") -> str:
    """Store a table as the current version of ``name``, in files of a ``kind``; returns the version."""
    home = _folder(folder, name)
    spark, version = models.sparkSession, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    models.write.format(kind).save(f"{home}/{version}")
    stored = spark.read.schema(models.schema).format(kind).load(f"{home}/{version}").count()
    spark.createDataFrame([(name, version, stored)], POINTER).coalesce(1).write.mode("append").parquet(f"{home}/pointers")
    return version


def versions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(name, version, models) of every complete version; versions sort by their time."""
    return spark.read.schema(POINTER).parquet(f"{_folder(folder, name)}/pointers")


def current(spark: SparkSession, folder: str, name: str, **missing: None) -> str | None:
    """The newest complete version. Without one this fails, or returns ``missing`` if that is given."""
    try:
        newest = versions(spark, folder, name).agg(F.max("version")).first()[0]
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    if newest is None and "missing" in missing:
        return missing["missing"]
    if newest is None:
        raise ValueError(f"no complete version of {name!r} in {folder}")
    return newest


def read(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    """Any table that was stored by name: metrics, results of a search, coefficients."""
    version = version or current(spark, folder, name)
    return spark.read.parquet(f"{_folder(folder, name)}/{version}")


def load(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    """The models of a version, the current one unless named. A stream that starts takes the version of that moment."""
    found = read(spark, folder, name, version)
    lacking = {f.split()[0] for f in MODEL_TYPE.split(", ")} - set(found.columns)
    if lacking:
        raise ValueError(f"{name!r} in {folder} is no model table: {sorted(lacking)} are missing")
    return found
