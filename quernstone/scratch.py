"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, on a local master only, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quernstone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(rows: DataFrame, name: str) -> DataFrame:
    """rows without their lineage: written once and read again, so that several readers cost
    one computation and a lost executor costs none."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/quernstone-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    _remove_at_end(spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """Let the session's file system delete the path when its JVM ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
