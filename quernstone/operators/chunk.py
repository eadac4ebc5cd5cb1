"""Chunking: boilerplate, oversize splits, chunk ids, counters, pinned summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Most characters of a chunk, overlap of parts, least characters, labels of web
# pages (a whole chunk, or several in a short one).
MOST, OVERLAP, LEAST = 1800, 200, 25
FURNITURE = (
    r"(?i)^(more links\s*:?|e-lms|rss|follow rbi|sitemap|search|notifications?|master circulars?|master directions?|feedback|disclaimer|"
    r"important websites?|tenders?|faqs?|contact us|useful links)\W*$"
)
NAV = (
    "home", "about us", "notifications", "press releases", "speeches", "publications", "statistics", "regulatory reporting", "complaints",
    "rss", "e-lms", "sitemap", "more links", "follow rbi",
)
NAV_HITS, NAV_LENGTH = 3, 400


def is_boilerplate(text: Column) -> Column:
    """Whether a chunk is only a label, or short and mostly navigation."""
    even = F.trim(F.regexp_replace(text, rf"{X.SPACE}+", " "))
    low = F.lower(even)
    hits = sum((F.when(low.contains(n), 1).otherwise(0) for n in NAV), F.lit(0))
    return even.rlike(FURNITURE) | ((hits >= NAV_HITS) & (F.length(even) < NAV_LENGTH))


def sentences(text: Column) -> Column:
    """Pieces after full stops, semicolons and colons."""
    return F.split(F.regexp_replace(text, r"([.;:])\s+", "$1\u0001"), "\u0001")


def split_text(text: Column) -> Column:
    """Parts of a text: whole up to MOST characters, else sentences packed greedily, each
    part beginning with the last OVERLAP characters of the one before. A sentence that is
    itself too long is cut at its last space before MOST, or at MOST if it has none."""
    kind = "struct<parts:array<string>,cur:string>"

    def step(s: Column, x: Column) -> Column:
        fits = F.length(s["cur"]) + F.length(x) + 1 <= MOST
        joined = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(" "), x))
        flushed = F.when(s["cur"] == "", s["parts"]).otherwise(F.concat(s["parts"], F.array(s["cur"])))
        tail = F.when(s["cur"] == "", F.lit("")).otherwise(F.concat(F.substring(s["cur"], -OVERLAP, OVERLAP), F.lit(" ")))
        return F.when((s["cur"] == "") | fits, F.struct(s["parts"].alias("parts"), joined.alias("cur"))).otherwise(F.struct(flushed.alias("parts"), F.concat(tail, x).alias("cur"))).cast(kind)

    pieces = F.flatten(F.transform(sentences(text), _hard_cut))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur")).cast(kind)
    packed = F.aggregate(pieces, start, step, lambda s: F.when(s["cur"] == "", s["parts"]).otherwise(F.concat(s["parts"], F.array(s["cur"]))))
    return F.when(F.length(text) <= MOST, F.array(text)).otherwise(packed)


def _hard_cut(sentence: Column) -> Column:
    """A sentence in pieces of at most MOST characters, cut at spaces where there are any."""
    marked = F.regexp_replace(sentence, rf"(?s)(.{{1,{MOST - 1}}})(?:\s+|$)|(.{{{MOST}}})", "$1$2\u0001")
    return F.when(F.length(sentence) <= MOST, F.array(sentence)).otherwise(F.filter(F.split(marked, "\u0001"), lambda p: F.length(p) > 0))


def chunk_clauses(clauses: DataFrame, key: tuple[str, ...] = ("document_id", "version"), source_kind: str = "user_document") -> DataFrame:
    """Chunks of resolved clauses (key, ordinal, clause_id, text, content_hash, ...): short
    and boilerplate ones dropped, long ones split; a whole clause keeps its hash."""
    t = F.col("text")
    rows = clauses.where((F.length(t) >= LEAST) & ~is_boilerplate(t)).withColumn("_parts", split_text(t))
    rows = rows.select(*clauses.columns, F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_i", "_part"))
    whole = F.col("_n") == 1
    order = W.partitionBy(*key).orderBy("ordinal", "_i")
    return rows.withColumns({
        "chunk_id": F.when(whole, F.col("clause_id")).otherwise(F.concat_ws("-p", "clause_id", F.col("_i").cast("string"))),
        "content_hash": F.when(whole, F.col("content_hash")).otherwise(X.content_hash(F.col("_part"))),
        "text": F.col("_part"), "ordinal": F.row_number().over(order) - 1, "source_kind": F.lit(source_kind),
    }).drop("_n", "_i", "_part")


def chunk_corpus(clauses: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks of corpus documents (document_id = manifest id): version 1, ids from the entry,
    applicability and citation fields from its row."""
    rows = clauses.withColumn("version", F.lit(1)).withColumn("clause_id", F.format_string("%s-c%04d", "document_id", F.col("ordinal").cast("int")))
    rows = chunk_clauses(rows, source_kind="corpus")
    entry = manifest.select(F.col("id").alias("document_id"), "title", F.col("reference").alias("circular_id"), "source_url", "applicability")
    return rows.join(entry, "document_id")


def report(clauses: DataFrame) -> DataFrame:
    """produced, split, skipped_short, skipped_boilerplate."""
    t = F.col("text")
    short = F.length(t) < LEAST
    furniture = ~short & is_boilerplate(t)
    n = F.when(short | furniture, 0).otherwise(F.size(split_text(t)))
    return clauses.select(short.alias("s"), furniture.alias("b"), n.alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("produced"), F.count_if(F.col("n") > 1).alias("split"), F.count_if("s").alias("skipped_short"), F.count_if("b").alias("skipped_boilerplate")
    )


def pinned_summary(documents: DataFrame) -> DataFrame:
    """document_id, version, summary: facts in a fixed order, those unknown left out."""
    has = lambda c: c in documents.columns
    col = lambda c: F.col(c) if has(c) else F.lit(None).cast("string")
    fact = lambda label, c: F.concat(F.lit(label + ": "), c.cast("string"))
    plain = lambda c: F.replace(col(c), F.lit("_"), F.lit(" "))
    revised = F.col("kind") == "amendment" if has("kind") else F.lit(False)
    effective = F.col("amends.effective_from") if has("amends") else F.lit(None).cast("date")
    facts = (
        fact("Document", F.coalesce(col("title"), F.col("document_id"))), fact("Type", plain("kind")), fact("Version", F.col("version")), fact("Loan type", col("loan_type")),
        fact("Borrower", col("borrower_type")), fact("Lender class", plain("lender_class")), fact("Dated", col("agreement_date")), F.when(revised, fact("Revision effective", effective)),
        F.when(revised, F.lit("This version revises an earlier agreement; unlisted clauses carry forward.")), fact("Clauses in force", col("n_clauses")),
    )
    return documents.select("document_id", "version", F.concat_ws("\n", *facts).alias("summary"))
