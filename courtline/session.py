"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(name: str = "courtline", cpus: int | str = "*", **settings) -> SparkSession:
    """A session on this machine, for tests and benches."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"} | settings
    return SparkSession.builder.appName(name).master(f"local[{cpus}]").config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, for functions that run in Python workers."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="courtline-"), "courtline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder: that of spark.checkpoint.dir; where it is unset a temporary one, on one machine only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors need a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="courtline-"))
    return spark


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the session's shared one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or with_checkpoints(spark).sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/courtline-{label}-{uuid.uuid4().hex}"


def saved_rows(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again: what several jobs read is made once and survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
