"""CSV feeds, newest-file choice and the processed table."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FINAL_COLS, TRAFFIC_SCHEMA, VEHICLE_SCHEMA, WEATHER_SCHEMA

FEEDS = {"traffic": TRAFFIC_SCHEMA, "vehicle": VEHICLE_SCHEMA, "weather": WEATHER_SCHEMA}
# As split size and as opening cost: no file is split, and none shares its task with another.
WHOLE_FILE = 1 << 60


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(header, files): the distinct header rows of CSV files and the files that begin with each.

    One job, one task a file, and a task stops after the first line that holds anything; files without one are left
    out. The number of files is bounded by the driver's own listing of them.
    """
    own = spark.newSession()  # of the same context; the caller's settings stay as they are
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", str(WHOLE_FILE))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.filter(pc.not_equal(pc.utf8_trim_whitespace(batch["value"]), ""))
            if lines.num_rows:
                yield lines.slice(0, 1)
                return

    lines = own.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.mapInArrow(first, "value string, file string")
    return heads.groupBy(F.col("value").alias("header")).agg(F.collect_list("file").alias("files"))


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV by header name: columns a file lacks read as null, others are not parsed.

    Files may order their columns differently. One job finds the headers; the files of one header are one scan, so
    jobs and plan grow with the number of different headers, not of files. A name that a header holds twice is its
    first column.
    """
    found = sorted(headers(spark, path).collect(), key=lambda r: r["header"])
    out = None
    for row in found:
        # A byte order mark belongs to the first name.
        names = next(csv.reader([row["header"].lstrip("\ufeff").rstrip("\r")]))
        text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        rows = spark.read.option("header", True).option("encoding", "UTF-8").schema(text).csv(path)
        if len(found) > 1:
            # The listing is pruned by it: no other file is opened.
            rows = rows.filter(F.col("_metadata.file_path").isin(row["files"]))
        part = rows.select(*[
            (F.col(f"c{names.index(f.name)}") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ])
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def read_feed(spark: SparkSession, kind: str, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, FEEDS[kind])


def newest_file(spark: SparkSession, folder: str, glob: str = "*.csv") -> str | None:
    """Path of the most recently modified file that matches the pattern."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "modificationTime")
    )
    row = files.orderBy(F.col("modificationTime").desc(), F.col("path").desc()).limit(1).first()
    return row["path"] if row else None


def newest_drop(spark: SparkSession, folder: str, glob: str = "*.csv") -> str | None:
    """Folder of the newest file: a delivery that was written as several part files."""
    file = newest_file(spark, folder, glob)
    return file and file.rsplit("/", 1)[0]


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*FINAL_COLS)
