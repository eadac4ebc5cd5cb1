"""The whole parse: lines to documents, clauses and warnings; goldset and JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import detect as D
from ..operators import segment as G

KEY = list(G.DOC)
GOLDSET = "id string, question string, document_id string, version int, expect_clauses array<string>, expect_corpus array<string>, require_corpus_rank int, expect_insufficient boolean, must_not_contain array<string>, why string"


#: Clauses that tell whose document it is.
PROBE = 12


def parse(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, clauses, warnings of lines; files: (document_id, version, filename) and,
    if known, kind_hint, loan_type_hint, borrower_type_hint, lender_class_hint.

    Headers are stripped, lines segmented, clauses numbered and hashed; detectors look at
    the document's text, which is bounded by the document. A loan agreement that says in two
    ways that it revises another one is an amendment."""
    hint = lambda c: F.col(c) if c in files.columns else F.lit(None).cast("string")
    seg = G.segment(G.strip_running_headers(lines))
    clauses = seg.withColumns({"clause_id": F.format_string("%s-v%d-c%04d", "document_id", "version", F.col("ordinal")), "content_hash": X.content_hash(F.col("text"))})

    def joined(ordered: Column) -> Column:
        return F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")

    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "text")))
    body = clauses.groupBy(*KEY).agg(
        ordered.alias("_all"), F.count(F.lit(1)).alias("n_clauses"), F.max("page_end").alias("page_count"), F.first("strategy").alias("strategy"), F.first("notes").alias("notes")
    )
    body = body.withColumns({"text": joined(F.col("_all")), "_probe": joined(F.slice("_all", 1, PROBE))}).drop("_all")
    hints = ("kind", "loan_type", "borrower_type", "lender_class")
    docs = files.select(*KEY, "filename", *(hint(f"{h}_hint").alias(f"_{h}") for h in hints)).join(body, KEY, "left")
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("_described", D.detect_kind(text, F.col("_kind"))).withColumn("amends", D.detect_amendment(text, F.col("_described")))
    docs = docs.withColumn("kind", F.when(F.col("amends").isNotNull(), "amendment").otherwise(F.col("_described")))
    loan = D.detect_loan_type(docs.where("text IS NOT NULL").withColumn("_k", F.struct(*KEY)), "_k").select("_k.*", F.col("loan_type").alias("_l"))
    docs = docs.join(loan, KEY, "left").join(G.titles(clauses, files.select(*KEY, "filename")), KEY, "left")
    told = lambda name, detected: D.resolve_metadata(F.col("_described"), F.col(f"_{name}"), detected).alias(name)
    documents = docs.select(
        *KEY, "filename", "kind", "title", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("n_clauses", F.lit(0)).alias("n_clauses"), "strategy", "notes",
        told("loan_type", F.col("_l")), told("borrower_type", D.borrower_type(F.col("text"))), told("lender_class", D.detect_lender_class(F.col("text"))),
        F.when(F.col("_described") != "rbi_circular", D.detect_agreement_date(F.col("text"))).alias("agreement_date"), F.lit("INR").alias("currency"), F.lit("en").alias("language"),
        "amends", D.document_key(F.coalesce("_probe", F.lit("")), F.col("filename")).alias("document_key"),
    )
    revises = documents.where("amends IS NOT NULL").select(*KEY, F.lit("amendment_detected").alias("code"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<int>").alias("missing"))
    return documents, clauses, G.structural_warnings(clauses).unionByName(revises)


def read_goldset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDSET).json(path)


def as_json(documents: DataFrame, clauses: DataFrame) -> DataFrame:
    """document_id, version, json: a document with its clauses in order."""
    cols = [c for c in clauses.columns if c not in KEY]
    per = clauses.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("ordinal", *(c for c in cols if c != "ordinal")))).alias("clauses"))
    rows = documents.join(per, KEY, "left")
    return rows.select(*KEY, F.to_json(F.struct(*documents.columns, "clauses")).alias("json"))


def score_goldset(cases: DataFrame, passages: DataFrame, outcomes: DataFrame, threshold: float = 0.72) -> DataFrame:
    """id, clause_recall, corpus_ok, rank_ok, refusal_ok, forbidden, passed for cases (as
    GOLDSET). passages: (query_id, rank, clause_number of the user's documents, corpus_id of
    the corpus's, text); outcomes: (query_id, confidence).

    All expected corpus documents must be there, one of them among the first ranks if the
    case asks for that; a case that expects too little evidence must find nothing, or
    nothing near enough; forbidden words are looked for without regard to case."""
    none = F.array().cast("array<string>")
    ranked = F.struct("rank", F.col("corpus_id").alias("c"))
    per = passages.groupBy(F.col("query_id").alias("id")).agg(
        F.collect_set("clause_number").alias("_c"), F.collect_set(F.when(F.col("corpus_id").isNotNull(), ranked)).alias("_r"), F.collect_list(F.lower("text")).alias("_t"),
    )
    rows = cases.join(per, "id", "left").join(outcomes.select(F.col("query_id").alias("id"), "confidence"), "id", "left")
    want = F.array_distinct(F.coalesce("expect_clauses", none))
    corpus = F.array_distinct(F.coalesce("expect_corpus", none))
    found = lambda r: F.coalesce(F.transform(r, lambda x: x["c"]), none)
    recall = F.when(F.size(want) > 0, F.size(F.array_intersect(want, F.coalesce("_c", none))) / F.size(want)).otherwise(1.0)
    corpus_ok = F.size(F.array_except(corpus, found(F.col("_r")))) == 0
    first = found(F.filter("_r", lambda x: x["rank"] <= F.col("require_corpus_rank")))
    rank_ok = F.col("require_corpus_rank").isNull() | F.col("_t").isNull() | F.arrays_overlap(corpus, first)
    refusal_ok = ~F.coalesce("expect_insufficient", F.lit(False)) | (F.coalesce("confidence", F.lit(0.0)) < threshold)
    forbidden = F.exists(F.coalesce("must_not_contain", none), lambda m: F.exists(F.coalesce("_t", none), lambda t: t.contains(F.lower(m))))
    out = rows.select("id", recall.alias("clause_recall"), corpus_ok.alias("corpus_ok"), rank_ok.alias("rank_ok"), refusal_ok.alias("refusal_ok"), forbidden.alias("forbidden"))
    return out.withColumn("passed", (F.col("clause_recall") >= 1) & F.col("corpus_ok") & F.col("rank_ok") & F.col("refusal_ok") & ~F.col("forbidden"))


def summarize_goldset(scored: DataFrame) -> DataFrame:
    """cases, clause_recall, corpus_found (of those that can be answered, with answerable),
    refusals (with unanswerable) and passed; scored: score_goldset's rows with _no, whether
    a case wants a refusal."""
    yes, no = ~F.col("_no"), F.col("_no")
    return scored.agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.when(yes, F.col("clause_recall"))).alias("clause_recall"), F.count_if(yes).alias("answerable"), F.count_if(yes & F.col("corpus_ok")).alias("corpus_found"),
        F.count_if(no).alias("unanswerable"), F.count_if(no & F.col("refusal_ok")).alias("refusals"), F.count_if("passed").alias("passed"),
    )


def newest(clauses: DataFrame) -> DataFrame:
    """Clauses of each document's highest version."""
    top = F.max("version").over(W.partitionBy("document_id"))
    return clauses.withColumn("_v", top).where("version = _v").drop("_v")
