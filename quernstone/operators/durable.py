"""Intermediate tables in the folder that the cluster shares: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="quernstone-base-")
        atexit.register(shutil.rmtree, shared_dir.own, True)
    return f"file://{shared_dir.own}"


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/quernstone/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(df: DataFrame) -> None:
    """Remove a table of ``durable`` that no later step reads."""
    jvm, path = df.sparkSession._jvm, df.written_to
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Let the shuffle files of plans that nothing refers to any more go now, not when the driver next happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
