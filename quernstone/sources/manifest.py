"""The corpus manifest: a JSON dimension that is checked on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "array<string>"
ENTRY = (
    "id string, file string, title string, reference string, circular_number string, issued_on date, document_kind string, verified_from_pdf boolean, addressees array<string>,"
    f" applicability struct<loan_types:{_LIST},borrower_types:{_LIST},lender_classes:{_LIST},purposes:{_LIST},effective_from:date,effective_to:date>,"
    f" topics {_LIST}, source_url string, source_url_verified boolean, source_url_status string, amends string, amended_by string, notes string,"
    f" repeals struct<effective_from:date,circulars:{_LIST},note:string,subject_keywords:{_LIST}>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry; an error at run time if an entry breaks a rule."""
    raw = spark.read.schema(f"documents array<struct<{_as_struct(ENTRY)}>>").option("multiLine", True).json(path)
    return checked(raw.select(F.explode("documents").alias("d")).select("d.*"))


def _as_struct(ddl: str) -> str:
    parts, depth, at = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = ddl[at:k].strip().split(" ", 1)
            parts.append(f"{name}:{kind}")
            at = k + 1
    return ",".join(parts)


def checked(entries: DataFrame) -> DataFrame:
    """entries, or an error: a link must be verified, no link needs a status, intervals run
    forward, ids and files are unique."""
    a = F.col("applicability")
    doubled = lambda c: entries.groupBy(c).agg(F.count(F.lit(1)).alias(f"_{c}")).select(F.col(c), f"_{c}")
    rows = entries.join(doubled("id"), "id").join(doubled("file"), "file")
    fault = (
        F.when(F.col("source_url").isNotNull() & ~F.coalesce("source_url_verified", F.lit(False)), "its link is not verified")
        .when(F.col("source_url").isNull() & (F.coalesce("source_url_status", F.lit("")) == ""), "it has neither a link nor a status")
        .when(a["effective_to"] < a["effective_from"], "it ends before it begins")
        .when(F.col("_id") > 1, "its id is not unique")
        .when(F.col("_file") > 1, "its file is not unique")
    )
    verdict = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("manifest entry "), F.col("id"), F.lit(": "), fault))).otherwise(F.col("id"))
    return rows.withColumn("id", verdict).select(*entries.columns)


def amendments(entries: DataFrame) -> DataFrame:
    """id, amended_by: each entry that a later one changes, said by either of the two."""
    told = entries.where("amended_by IS NOT NULL").select("id", "amended_by")
    said = entries.where("amends IS NOT NULL").select(F.col("amends").alias("id"), F.col("id").alias("amended_by"))
    return told.unionByName(said).distinct().join(entries.select("id"), "id", "left_semi")
