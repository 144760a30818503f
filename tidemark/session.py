"""Session helpers: a UTC session, the shared folder, and stable intermediate tables."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session settings read by the library (all optional).
MAX_ROWS_KEY = "tidemark.maxRowsPerTask"
DEFAULT_MAX_ROWS = 1_000_000


def get_session(app: str = "tidemark", master: str | None = None, shuffle: int | None = None,
                driver_memory: str | None = None) -> SparkSession:
    """Session for local runs; on a cluster the submitted configuration wins."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master:
        b = b.master(master)
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    return utc(b.getOrCreate())


def utc(spark: SparkSession) -> SparkSession:
    """All wall-clock rules of the library assume a UTC session; Python tasks need its modules."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(os.path.join(root, "tidemark")):
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tidemark-py-"), "tidemark"), "zip", root, "tidemark")
        spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def max_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_ROWS_KEY, str(DEFAULT_MAX_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  A local session that names none gets a private one; a cluster must name it."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def stable(df: DataFrame, label: str = "stage", compression: str | None = None, options: dict | None = None) -> DataFrame:
    """Write once to the shared folder and read back; large packed columns may name a stronger compression.

    Cuts lineage durably (a lost executor re-reads the files) and freezes values such as
    the range-partition number, which two independent evaluations could draw differently.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Partitions of as many rows each for CPU-heavy row work, whatever the splits of the input.

    Their number is fixed: narrow rows would be merged by their bytes into a few tasks, however long each row's work is.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
