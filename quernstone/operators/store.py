"""The two stores: one vector for each distinct text, one chunk row for each version.

Tables are Parquet snapshots; a merge returns the next snapshot's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MUTABLE = ("content_hash", "text", "citation")


def new_hashes(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One chunk for each hash that has no vector yet: the ones to embed."""
    once = W.partitionBy("content_hash").orderBy("chunk_id")
    first = chunks.withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k")
    return first.join(embeddings.select("content_hash"), "content_hash", "left_anti")


def insert_embeddings(embeddings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors to append: hashes that aren't there, rows without a vector left out."""
    return vectors.where("vector IS NOT NULL").dropDuplicates(["content_hash"]).join(embeddings.select("content_hash"), "content_hash", "left_anti")


def reuse(chunks: DataFrame, needed: DataFrame) -> DataFrame:
    """total, embedded, reused, reuse_ratio."""
    total, new = (d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((chunks, "total"), (needed, "embedded")))
    out = total.crossJoin(new).withColumn("reused", F.col("total") - F.col("embedded"))
    return out.withColumn("reuse_ratio", F.when(F.col("total") > 0, F.col("reused") / F.col("total")).otherwise(0.0))


def upsert_chunks(current: DataFrame, incoming: DataFrame, refresh: bool = False) -> DataFrame:
    """Merge by chunk_id. A chunk that is there takes hash, text and citation only (all
    columns, if refresh); one that isn't is inserted whole."""
    names = current.columns
    mutable = set(names if refresh else MUTABLE)
    a = current.select("chunk_id", F.struct(*names).alias("_old"))
    b = incoming.select("chunk_id", F.struct(*names).alias("_new"))
    both = a.join(b, "chunk_id", "full_outer")
    pick = lambda n: F.when(F.col("_old").isNull() | (F.lit(n in mutable) & F.col("_new").isNotNull()), F.col("_new")[n]).otherwise(F.col("_old")[n])
    return both.select(*(F.col("chunk_id") if n == "chunk_id" else pick(n).alias(n) for n in names))


def point_to_version(chunks: DataFrame, document_id: str, version: int, chunk_ids: list[str] | None = None) -> DataFrame:
    """Rows that point a new version at chunks that are there; ids that exist are left out."""
    rows = chunks if chunk_ids is None else chunks.where(F.col("chunk_id").isin(chunk_ids))
    new = F.format_string("%s-v%d-%s", F.lit(document_id), F.lit(version), F.coalesce("clause_id", "chunk_id"))
    rows = rows.withColumn("_id", new)
    if "citation" in chunks.columns:
        c = F.col("citation").withField("document_id", F.lit(document_id)).withField("version", F.lit(version)).withField("chunk_id", F.col("_id"))
        rows = rows.withColumn("citation", c)
    rows = rows.withColumns({"document_id": F.lit(document_id), "version": F.lit(version), "chunk_id": F.col("_id")}).drop("_id")
    return rows.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns)


def merge_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by (document_id, version): an incoming row replaces the one that is there."""
    key = ["document_id", "version"]
    return current.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def latest(documents: DataFrame) -> DataFrame:
    """Highest version of each document."""
    names = documents.columns
    best = documents.groupBy("document_id").agg(F.max_by(F.struct(*names), "version").alias("r"))
    return best.select(*(F.col("r")[n].alias(n) for n in names))


def latest_uploads(documents: DataFrame) -> DataFrame:
    """Most recent upload of each document, the newest first."""
    w = W.partitionBy("document_id").orderBy(F.col("uploaded_at").desc(), F.col("version").desc())
    return documents.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").orderBy(F.col("uploaded_at").desc(), F.col("version").desc())


def versions_of(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", "version").distinct().orderBy("document_id", "version")


def shared(chunks: DataFrame) -> DataFrame:
    """Hashes that several chunks have, and how many."""
    return chunks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stats(chunks: DataFrame) -> DataFrame:
    """chunks, embeddings (distinct texts), shared_embeddings."""
    per = chunks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count(F.lit(1)).alias("embeddings"), F.count_if(F.col("n") > 1).alias("shared_embeddings"))


def any_chunk(hashes: DataFrame, chunks: DataFrame) -> DataFrame:
    """hashes with a chunk id that has each ('' if none): the smallest."""
    one = chunks.groupBy("content_hash").agg(F.min("chunk_id").alias("chunk_id"))
    return hashes.join(one, "content_hash", "left").withColumn("chunk_id", F.coalesce(F.col("chunk_id").cast("string"), F.lit("")))


def search_scope(chunks: DataFrame, embeddings: DataFrame, document_id=None, version=None, source_kinds=()) -> DataFrame:
    """Chunks of the scope with their vectors; the scope is a predicate of the scan."""
    rows = chunks
    if document_id is not None:
        rows = rows.where(F.col("document_id") == document_id)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    if source_kinds:
        rows = rows.where(F.col("source_kind").isin(*source_kinds))
    return rows.join(embeddings, "content_hash")


def scoped(chunks: DataFrame, embeddings: DataFrame, scopes: DataFrame) -> DataFrame:
    """Chunks of each scope (document_id, version) with their vectors, for a table of scopes."""
    return chunks.join(scopes, ["document_id", "version"], "left_semi").join(embeddings, "content_hash")


def point_to_versions(chunks: DataFrame, pointers: DataFrame) -> DataFrame:
    """As point_to_version, for a table of pointers (document_id, version, new_version): rows
    of each version named, under the new one; ids that exist are left out."""
    rows = chunks.join(pointers, ["document_id", "version"])
    new = F.format_string("%s-v%d-%s", F.col("document_id"), F.col("new_version").cast("int"), F.coalesce("clause_id", "chunk_id"))
    rows = rows.withColumns({"_id": new, "version": F.col("new_version").cast(chunks.schema["version"].dataType)})
    if "citation" in chunks.columns:
        rows = rows.withColumn("citation", F.col("citation").withField("version", F.col("version")).withField("chunk_id", F.col("_id")))
    rows = rows.withColumn("chunk_id", F.col("_id")).drop("_id", "new_version")
    return rows.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns)


def same_clauses(clauses: DataFrame, held: DataFrame) -> DataFrame:
    """(upload_id, document_id, version): the first held version whose set of clause hashes
    equals an upload's (upload_id, and document_id if it is known; else any document's)."""
    digest = lambda d, *key: d.groupBy(*key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("content_hash")), ","), 256).alias("set_hash"))
    known = ["document_id"] if "document_id" in clauses.columns else []
    first = digest(held, "document_id", "version").groupBy(*known, "set_hash").agg(F.min(F.struct("document_id", "version")).alias("_first"))
    found = digest(clauses, "upload_id", *known).join(first, [*known, "set_hash"])
    return found.select("upload_id", F.col("_first.document_id").alias("document_id"), F.col("_first.version").alias("version"))
