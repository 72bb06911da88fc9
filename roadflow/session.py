"""Session settings, the shared work folder and staged tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # Stamps are timezone-naive local times; UTC keeps every cast an identity.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows with matrices or request arrays weigh 10 to 200 KB: a Python worker holds so many bytes of them, not 10,000 rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # The JVM never compiles methods above 8000 bytes of bytecode. Wide projections run
    # several times faster when such stages fall back to split, compilable methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs rely on and ship the package to the workers."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, as ``--py-files`` would; once per context."""
    context = spark.sparkContext
    if getattr(context, "_roadflow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="roadflow-package-"), "roadflow")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), "roadflow"))
    context._roadflow_shipped = True


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("roadflow")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: a
    machine-local path on a cluster would be lost with its machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="roadflow-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where several branches read the same reduced table: the lineage is cut
    by a table that survives lost executors, and later reads prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
