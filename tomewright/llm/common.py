"""Helpers shared by the training-data operators: shared-folder tables, guards for odd input, hashing."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, \\n, \\v, \\f and \\r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``. If it is unset, a folder of this machine
    serves a local session; on a cluster, where it would lose data, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "tomewright-shared")
    return at.rstrip("/")


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors.

    What isn't dropped before goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tomewright/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    release_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages: it does so when the driver collects their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``stage_table`` that nothing reads any more."""
    fs, at = _file_system(df.sparkSession, df._table_path)
    fs.delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of a column's text form, modulo n; 0 for null."""
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")) % n, F.lit(0).cast("long"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that a caller's further columns can't clash with ours."""
    return df.select(*[df[f"`{n}`"] for n in names])
