"""Tables in the folder that the driver and all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import quote

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; if it is unset, a folder of this machine serves a local session, and a cluster is told."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "tomewright-shared")
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/tomewright/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, and read from there."""
    path = new_path(df.sparkSession, name)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str) -> tuple[FileSystem, str]:
    """The Arrow file system of a path as Spark writes it, and the path in it, where a task opens files by itself."""
    if path.startswith(("file:", "/")):
        return LocalFileSystem(), re.sub("^file:/+", "/", path)
    return FileSystem.from_uri(quote(path, safe=":/"))
