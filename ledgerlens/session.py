"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Row work here is costly per byte: keep small exchanges on all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even if that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, name: str = "ledgerlens") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_TEST_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: the cluster's ``spark.checkpoint.dir``.

    Where it is unset and driver and executors are one process (tests), one temporary folder per application
    is made and reused. A cluster must set it: its machines share no temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _TEST_FOLDERS:
        _TEST_FOLDERS[app] = tempfile.mkdtemp(prefix="ledgerlens-")
    return _TEST_FOLDERS[app]


def cut(df: DataFrame) -> DataFrame:
    """Materialise a step that later steps read several times, as a table in the shared folder.

    A written table ends the lineage, survives lost executors, and gives later joins real sizes.
    """
    path = f"{shared_folder(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of costly row work a task gets at most, about.
TASK_ROWS = 1 << 14


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Deal rows for costly row work evenly: over all cores, and in tasks of about ``task_rows`` rows, however large the input.

    The splits of a file say little about its rows: a row group is read by one task whole. Rows are counted from the
    footers of the files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // task_rows)))
