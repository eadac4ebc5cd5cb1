"""Streaming ingestion into a folder of chunks and one of embeddings.

Each micro-batch merges by key: chunk rows whose id is there are left out, and a text is
embedded only if its hash has no vector yet, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embed


def _held(spark: SparkSession, path: str, column: str, kind: str) -> DataFrame:
    """One column of what a folder holds; an empty frame before the first write."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.parquet(path).select(column)
    return spark.createDataFrame([], f"{column} {kind}")


def merge_batch(out: str, provider: Callable[[DataFrame, str], DataFrame] = embed.hashing_embedding) -> Callable[[DataFrame, int], None]:
    """foreachBatch function for chunks (chunk_id, content_hash, text, ...)."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kind = dict(batch.dtypes)["chunk_id"]
        rows = batch.dropDuplicates(["chunk_id"]).persist()
        texts = rows.select("content_hash", "text").dropDuplicates(["content_hash"]).join(_held(spark, f"{out}/embeddings", "content_hash", "string"), "content_hash", "left_anti")
        # vectors before chunks: a chunk is never there without its vector
        provider(texts, "content_hash").write.mode("append").parquet(f"{out}/embeddings")
        rows.join(_held(spark, f"{out}/chunks", "chunk_id", kind), "chunk_id", "left_anti").write.mode("append").parquet(f"{out}/chunks")
        rows.unpersist()

    return run


def ingest(chunks: DataFrame, out: str, checkpoint: str, provider=embed.hashing_embedding) -> None:
    """Run a streaming frame of chunks to its end."""
    query = chunks.writeStream.foreachBatch(merge_batch(out, provider)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stats(spark: SparkSession, out: str) -> DataFrame:
    c, e = (spark.read.parquet(f"{out}/{n}").agg(F.count(F.lit(1)).alias(n)) for n in ("chunks", "embeddings"))
    return c.crossJoin(e)
