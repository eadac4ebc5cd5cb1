"""Queries of streaming ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import shared_dir
from ..streaming import ingest as I
from . import base as P


def stream_ingest_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """documents streamed in twice: rows and vectors after the second time."""
    d = P.table(spark, sf, "documents")
    out = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    for turn in (1, 2):
        stream = spark.readStream.schema(d.schema).parquet(sf + "/documents*.parquet" if not sf.endswith("/") else sf + "documents*.parquet")
        chunks = stream.select(F.col("doc_id").alias("chunk_id"), X.content_hash(F.col("text")).alias("content_hash"), "text", F.col("source").alias("document_id"))
        I.ingest(chunks, out, f"{out}/checkpoint{turn}")
    return I.stats(spark, out)


QUERIES = {"stream_ingest_idempotent": stream_ingest_idempotent}
SQL = {"stream_ingest_idempotent": f"WITH {P.CHUNKS_SQL} SELECT count(DISTINCT chunk_id) AS chunks, count(DISTINCT content_hash) AS embeddings FROM chunks"}
