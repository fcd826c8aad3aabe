"""Folders for tables that a run writes for itself. The driver and all executors see them, and they go when Python exits."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="glyphward-")
    atexit.register(shutil.rmtree, path, True)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session is still there."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def scratch(spark: SparkSession, name: str = "files") -> str:
    """A new folder below spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _local_folder()
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(deleted, spark, path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read back, so that lost executors cost nothing and what comes after reads the same rows."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
