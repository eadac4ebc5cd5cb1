"""Queries of parsing and chunking: headers, blocks, splits, boilerplate, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunk as C
from ..operators import detect as D
from ..operators import segment as G
from ..operators import versions as V
from . import base as P

PAGE = 4


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document, four to a page."""
    d = P.table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    page = (F.floor(F.col("line_no") / PAGE) + 1).cast("int")
    return rows.withColumns({"page": page, "is_ocr": F.lit(False), "is_heading": F.lit(False)})


def running_header_strip(spark: SparkSession, sf: str) -> DataFrame:
    out = G.strip_running_headers(_lines(spark, sf))
    return out.select("document_id", F.col("line_no").cast("bigint").alias("line_no"), "page", "text")


def clause_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of documents whose lines start at headings or numbers."""
    out = G.blocks(G.find_starts(_lines(spark, sf)))
    return out.select("document_id", F.col("block").cast("bigint").alias("block"), "page_start", "page_end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _drafted(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of the documents as lines: numbered, under headings, with blank lines between
    them, or as they are, by the documents' ids."""
    said, way = F.split("text", r"\. "), F.col("doc_id") % 4
    numbered = F.transform(said, lambda x, i: F.concat((i % 90 + 1).cast("string"), F.lit(". "), x))
    two = lambda first, second: F.flatten(F.transform(said, lambda x: F.array(first(x), second(x))))
    headed, apart = two(lambda x: F.lit("GENERAL TERMS"), lambda x: x), two(lambda x: x, lambda x: F.lit(""))
    lines = F.when(way == 0, numbered).when(way == 1, headed).when(way == 2, apart).otherwise(said)
    rows = P.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version"), F.posexplode(lines).alias("line_no", "text"))
    page = (F.floor(F.col("line_no") / PAGE) + 1).cast("int")
    return rows.withColumns({"page": page, "is_ocr": F.lit(False), "is_heading": F.lit(False)})


def segmented_strategies(spark: SparkSession, sf: str) -> DataFrame:
    out = G.segment(_drafted(spark, sf))
    return out.groupBy("strategy").agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("clauses"))


def page_clauses(spark: SparkSession, sf: str) -> DataFrame:
    out = G.pages(_lines(spark, sf))
    return out.select("document_id", "page_start", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def paragraph_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraph fallback over the conversations' turns as lines, a blank line after each."""
    c = P.table(spark, sf, "conversations").where("text IS NOT NULL")
    line = F.col("turn").cast("int") * 2
    two = F.explode(F.array(F.struct(line.alias("line_no"), F.col("text").alias("text")), F.struct((line + 1).alias("line_no"), F.lit("").alias("text")))).alias("x")
    rows = c.select("conv_id", two).select(F.col("conv_id").alias("document_id"), F.lit(1).alias("version"), "x.line_no", F.lit(1).alias("page"), "x.text", F.lit(False).alias("is_ocr"))
    out = G.paragraphs(rows)
    return out.groupBy("document_id").agg(F.count(F.lit(1)).alias("clauses"), F.sum(F.length("text")).alias("chars"))


def boilerplate_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the pages' texts that are web furniture."""
    p = P.table(spark, sf, "pages")
    text = F.trim(F.regexp_replace("html", r"<[^>]*>", "\n"))
    lines = p.select("page_id", F.posexplode(F.split(text, "\n+")).alias("line", "text")).where(F.length("text") > 0)
    return lines.groupBy("page_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(C.is_boilerplate(F.col("text"))).alias("furniture"))


def chunking_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.report(P.chunks(spark, sf).select("text"))


def chunk_split(spark: SparkSession, sf: str) -> DataFrame:
    c = P.chunks(spark, sf).select("chunk_id", F.posexplode(C.split_text(F.col("text"))).alias("part", "piece"))
    return c.select("chunk_id", F.col("part").cast("bigint").alias("part"), F.md5(F.col("piece").cast("binary")).alias("piece_md5"))


def chunk_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return P.chunks(spark, sf).select("chunk_id", F.size(C.sentences(F.col("text"))).cast("bigint").alias("sentences"))


def numbering_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders as documents, parts as clauses: numbers missing up to the largest."""
    li = P.table(spark, sf, "lineitem")
    c = li.select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("version"), F.col("l_linenumber").alias("ordinal"), F.lit(1).alias("page_start"), (F.col("l_quantity").cast("int") % 12 + 1).cast("string").alias("number"), F.lit("x").alias("text"))
    out = G.structural_warnings(c).where("code = 'numbering_gap'")
    return out.select("document_id", F.array_join("missing", ",").alias("missing"))


def few_clauses(spark: SparkSession, sf: str) -> DataFrame:
    d = P.table(spark, sf, "documents")
    c = d.select(F.col("source").alias("document_id"), F.col("lang").alias("version"), F.col("doc_id").alias("ordinal"), F.lit(1).alias("page_start"), F.lit(None).cast("string").alias("number"), "text")
    return G.structural_warnings(c).select("document_id", F.col("version").alias("lang"), "code")


def clause_number_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Part sizes and keys as two-level numbers, in clause order within a brand."""
    p = P.table(spark, sf, "part")
    n = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 17).cast("string"))
    c = p.select(F.col("p_brand").alias("document_id"), F.lit(1).alias("version"), F.when(F.col("p_size") % 5 != 0, n).alias("number"), F.col("p_partkey").alias("ordinal"), F.col("p_partkey").cast("string").alias("content_hash"))
    return V.renumber(c).select("document_id", "number", F.col("ordinal").cast("bigint").alias("ordinal"), "content_hash", "clause_id")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a recital in front that depends on their id."""
    recital = F.concat(
        F.element_at(F.array(*map(F.lit, RECITALS)), (F.col("doc_id") % len(RECITALS) + 1).cast("int")), F.lit(" "), F.col("text"),
    )
    return P.table(spark, sf, "documents").select("doc_id", recital.alias("text"))


RECITALS = (
    "LOAN AGREEMENT dated 3rd March 2024 between Alpha Housing Finance Limited (the Lender) and Ravi, an individual, with Mr. Sen as co-borrower (the Borrower), for a home loan. Loan account no. AB-1234/9.",
    "Key Facts Statement for a personal loan by Beta Small Finance Bank. The borrower is Gamma Private Limited, GSTIN 12, udyam 4. Under the master direction of May 5, 2020, and for both sides and all that they have agreed upon here today in this very place as they say, the day is 07/08/2021.",
    "Loan agreement, revised - version 2. Loan account number AB-1234/9X. The original agreement dated 1 January 2023 stands revised with effect from 5 May 2024. Clause 11.2 is hereby deleted. Clauses 3.1, 4 and 5.10 stand superseded; save as expressly revised, all other terms remain unchanged.",
    "RBI/2023-24/77 Notification on a gold loan and a vehicle loan.",
    "Sanction letter of 12/11/2022. The working capital of the business loan; the business loan and the business loan again; one car loan. Shri Rao, the borrower, banks with the urban co-op.",
    "First of all, the second floor. Section 21 of the original agreement is not the loan agreement.",
    "Other text without marks.",
)


def kind_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc_id", D.detect_kind(F.col("text")).alias("kind"))


def lender_class_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc_id", D.detect_lender_class(F.col("text")).alias("lender_class"))


def loan_type_dominance(spark: SparkSession, sf: str) -> DataFrame:
    return D.detect_loan_type(_marked(spark, sf), "doc_id")


def borrower_type_detect(spark: SparkSession, sf: str) -> DataFrame:
    return D.detect_borrower_type(_marked(spark, sf), "doc_id")


def agreement_date_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc_id", D.detect_agreement_date(F.col("text")).alias("agreement_date"))


def amendment_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc_id", F.array_join(D.amendment_evidence(F.col("text")), ",").alias("evidence"))


def amendment_detect(spark: SparkSession, sf: str) -> DataFrame:
    """What the documents that revise another one say of it."""
    rows = _marked(spark, sf).select("doc_id", D.detect_amendment(F.col("text"), D.detect_kind(F.col("text"))).alias("a")).where("a IS NOT NULL")
    return rows.select("doc_id", F.col("a.loan_account_number").alias("account"), F.col("a.base_dated").alias("base_dated"), F.col("a.effective_from").alias("effective_from"), F.array_join("a.evidence", ",").alias("evidence"))


def metadata_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Lender classes: a hint for every seventh document, the detector's for the others but circulars."""
    kind, hint = D.detect_kind(F.col("text")), F.when(F.col("doc_id") % 7 == 0, "nbfc")
    return _marked(spark, sf).select("doc_id", D.resolve_metadata(kind, hint, D.detect_lender_class(F.col("text"))).alias("lender_class"))


def heading_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document that are only a title."""
    return _lines(spark, sf).groupBy("document_id").agg(F.count_if(G.looks_like_heading(F.col("text"))).alias("headings"))


def document_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles from the first lines of the first five pages, else the file's name."""
    pages = G.pages(_lines(spark, sf)).withColumns({"ordinal": F.col("block") - 1, "heading": F.lit(None).cast("string")})
    names = P.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version"), F.concat(F.lit("file "), F.col("doc_id").cast("string")).alias("filename"))
    return G.titles(pages, names).select("document_id", "title")


def _clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as clauses of their source's two versions."""
    c = P.chunks(spark, sf)
    clause = F.format_string("%s-v%d-c%04d", F.col("document_id"), F.col("version"), F.col("chunk_id"))
    return c.select("document_id", "version", F.col("chunk_id").alias("ordinal"), clause.alias("clause_id"), "text", "content_hash")


def clause_chunks(spark: SparkSession, sf: str) -> DataFrame:
    out = C.chunk_clauses(_clauses(spark, sf))
    return out.select("chunk_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.when(F.length("text") < 1000, F.col("content_hash")).alias("content_hash"), F.length("text").alias("chars"))


def corpus_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as corpus documents: ids from the manifest's entry, its citation beside them."""
    manifest = P.table(spark, sf, "documents").groupBy(F.col("source").alias("id")).agg(F.max("lang").alias("title"), F.min("lang").alias("reference"))
    manifest = manifest.withColumns({"source_url": F.lit(None).cast("string"), "applicability": F.array("title")})
    out = C.chunk_corpus(_clauses(spark, sf).where("version = 1").drop("version", "clause_id"), manifest)
    return out.groupBy("document_id", "version", "circular_id", "source_kind").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk_id").alias("first_chunk"), F.max("ordinal").cast("bigint").alias("last_ordinal"))


def pinned_summaries(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    kind = D.detect_kind(t)
    amends = D.detect_amendment(t, kind)
    rows = _marked(spark, sf).select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("version"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("No. "), F.col("doc_id").cast("string"))).alias("title"),
        F.when(amends.isNotNull(), "amendment").otherwise(kind).alias("kind"), amends.alias("amends"), D.detect_lender_class(t).alias("lender_class"), (F.col("doc_id") % 5).alias("n_clauses"),
    )
    return C.pinned_summary(rows).select("document_id", "summary")


def file_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "pages").where("html IS NOT NULL").select("page_id", X.fingerprint(F.col("html")).alias("fingerprint"))


def stemmed_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = P.table(spark, sf, "documents").select(F.explode(X.terms(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def document_keys(spark: SparkSession, sf: str) -> DataFrame:
    name = F.format_string("Loan File %d.v2.pdf", F.col("doc_id"))
    return _marked(spark, sf).select("doc_id", D.document_key(F.col("text"), name).alias("document_key"))


def deleted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc_id", F.array_join(V.deleted_numbers(F.col("text")), ",").alias("deleted"))


def figure_extract(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(X.figures(F.col("text"))), ",").alias("figures"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "documents").select("doc_id", F.md5(X.clean_extracted(F.col("text")).cast("binary")).alias("clean_md5"))


_F = (running_header_strip, clause_blocks, segmented_strategies, page_clauses, paragraph_clauses, boilerplate_filter, chunking_report, chunk_split, chunk_sentences, numbering_gaps, few_clauses, clause_number_sort, kind_detect, lender_class_detect, loan_type_dominance, borrower_type_detect, agreement_date_detect, amendment_evidence, amendment_detect, metadata_resolve, heading_lines, document_titles, clause_chunks, corpus_chunks, pinned_summaries, file_fingerprints, stemmed_terms, document_keys, deleted_numbers, figure_extract, clean_text)
QUERIES = {f.__name__: f for f in _F}

_LINES = f"""lines AS (SELECT doc_id AS document_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
paged AS (SELECT *, (line_no // {PAGE} + 1)::INT AS page, {P.strip_sql('text')} AS t FROM lines)"""
_DRAFTED = f"""dr AS (SELECT doc_id, string_split(text, '. ') AS ls FROM documents),
dl AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN list_transform(ls, lambda x, i: ((i - 1) % 90 + 1) || '. ' || x) WHEN 1 THEN flatten(list_transform(ls, lambda x: ['GENERAL TERMS', x])) WHEN 2 THEN flatten(list_transform(ls, lambda x: [x, ''])) ELSE ls END AS ls FROM dr),
lines AS (SELECT doc_id AS document_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS text FROM dl), paged AS (SELECT *, (line_no // {PAGE} + 1)::INT AS page, {P.strip_sql('text')} AS t FROM lines)"""
_q = lambda x: "'" + x.replace("'", "''") + "'"
_MARKED = "marked AS (SELECT doc_id, [" + ", ".join(map(_q, RECITALS)) + f"][doc_id % {len(RECITALS)} + 1] || ' ' || text AS text FROM documents)"
# fixed values, stated here apart from the operators
_KINDS = (
    ("key_facts_statement", ("key facts statement", "key fact statement")), ("sanction_letter", ("sanction letter", "letter of sanction", "sanction advice")),
    ("loan_agreement", ("loan agreement", "loan cum hypothecation", "facility agreement", "credit agreement")),
)
_LOANS = {
    "home": ("home loan", "housing loan", "mortgage loan"), "vehicle": ("vehicle loan", "car loan", "auto loan", "two wheeler loan"), "education": ("education loan", "student loan"),
    "gold": ("gold loan", "loan against gold", "gold jewellery"), "microfinance": ("microfinance loan", "micro finance loan", "jlg loan"), "credit_card": ("credit card agreement", "cardholder agreement"),
    "business": ("business loan", "working capital", "msme loan", "term loan to msme"), "personal": ("personal loan", "consumer loan"),
}
_LENDERS = (
    ("housing_finance_company", ("housing finance company", "housing finance limited")), ("nbfc_mfi", ("nbfc-mfi", "nbfc mfi", "micro finance institution")),
    ("nbfc", ("non-banking financial company", "non banking financial company", "nbfc")), ("small_finance_bank", ("small finance bank",)), ("regional_rural_bank", ("regional rural bank", "gramin bank")),
    ("cooperative_bank", ("co-operative bank", "cooperative bank", "urban co-op")), ("scheduled_commercial_bank", ("scheduled commercial bank", "banking regulation act, 1949")),
)
_BUSINESS = ("private limited", "pvt. ltd", "pvt ltd", "llp", "partnership firm", "proprietorship", "msme", "udyam", "gstin")
_INDIVIDUAL = ("an individual", "individual borrower", "co-borrower", "aadhaar", "mr.", "ms.", "mrs.", "shri", "smt")
_CUE = r"'(?i)(circular|notification|master direction|master circular|directions,\s*[0-9]{4}|RBI/[0-9]{4}-[0-9]{2}|DOR\.|DNBS|DNBR)'"
_CIRCULAR = r"'(?i)\bRBI/[0-9]{4}-[0-9]{2}/[0-9]+\b|\b(master circular|master direction|notification)\b'"
_EVIDENCE = (
    ("carry-forward clause", "save as (?:expressly |otherwise )?(?:revised|amended|varied)"), ("carry-forward clause", "continue in full force"),
    ("carry-forward clause", "(?:remain|continue)s? (?:unchanged|in effect|to apply)"), ("not restated", "not restated in this document"),
    ("names a base agreement", r"\boriginal agreement\b"), ("revision summary", "summary of revisions?"), ("per-clause revision", r"this revises clause\b"),
    ("version marker", r"\brevised\s*[-–—]?\s*version\s*[0-9]+"), ("stands revised", r"stands? revised\b"),
)
_ACCOUNT = r"'(?i)loan (?:account|a/c)(?:\s*no\.?|\s*number)?\s*:?\s*([A-Z0-9][A-Z0-9/\-]{5,40})'"
_DELETES = r"'(?i)\b(?:is|are|stand|stands)\s+(?:hereby\s+)?(?:deleted|superseded|withdrawn|of no further effect)\b'"
_REFERENCE = r"'(?i)clauses?\s+([0-9]{1,2}(?:\.[0-9]{1,2})*(?:\s*(?:,|and|&)\s*[0-9]{1,2}(?:\.[0-9]{1,2})*)*)'"
_NUMBERED = r"""'^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})[.)]?\s+([A-Za-z"''(].*)$'"""
_STRUCTURAL = r"'(?i)^((?:SCHEDULE|ANNEXURE|ANNEX|APPENDIX|PART|SECTION|ARTICLE|CLAUSE)(?:\s+[IVXLC0-9]+[A-Z]?)?)\b[:.\-\s]*(.*)$'"
_FURNITURE = r"'(?i)^(more links\s*:?|e-lms|rss|follow rbi|sitemap|search|notifications?|master circulars?|master directions?|feedback|disclaimer|important websites?|tenders?|faqs?|contact us|useful links)\W*$'"
_NAV = ("home", "about us", "notifications", "press releases", "speeches", "publications", "statistics", "regulatory reporting", "complaints", "rss", "e-lms", "sitemap", "more links", "follow rbi")

_any = lambda c, ws: "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in ws) + ")"
_EVEN = f"trim(regexp_replace(text, '{P.SPACE_SQL}+', ' ', 'g'))"
_BOILER = f"(regexp_matches({_EVEN}, {_FURNITURE}) OR (" + " + ".join(f"contains(lower({_EVEN}), '{n}')::INT" for n in _NAV) + f" >= 3 AND length({_EVEN}) < 400))"
_PIECES = r"string_split(regexp_replace(text, '([.;:])\s+', '\1' || chr(1), 'g'), chr(1))"
# a count in a pattern goes to 1,000 there
_CUT = rf"CASE WHEN length(s) <= {C.MOST} THEN [s] ELSE list_filter(string_split(regexp_replace(s, '(?s)(.{{1,1000}}.{{0,{C.MOST - 1001}}})(?:\s+|$)|(.{{1000}}.{{{C.MOST - 1000}}})', '\1\2' || chr(1), 'g'), chr(1)), lambda p: length(p) > 0) END"
_SPLIT = f"""sp AS (SELECT doc_id AS chunk_id, text, flatten(list_transform({_PIECES}, lambda s: {_CUT})) AS ps FROM documents WHERE length(text) > {C.MOST}),
w AS (SELECT chunk_id, 1::BIGINT AS i, []::VARCHAR[] AS parts, ps[1] AS cur, ps FROM sp
  UNION ALL SELECT chunk_id, i + 1,
    CASE WHEN cur = '' OR length(cur) + length(ps[i + 1]) + 1 <= {C.MOST} THEN parts ELSE list_append(parts, cur) END,
    CASE WHEN cur = '' THEN ps[i + 1] WHEN length(cur) + length(ps[i + 1]) + 1 <= {C.MOST} THEN cur || ' ' || ps[i + 1] ELSE substr(cur, -{C.OVERLAP}) || ' ' || ps[i + 1] END, ps FROM w WHERE i < len(ps)),
done AS (SELECT chunk_id, CASE WHEN cur = '' THEN parts ELSE list_append(parts, cur) END AS parts FROM w WHERE i = len(ps)
  UNION ALL SELECT doc_id, [text] FROM documents WHERE length(text) <= {C.MOST})"""
_NUM = "l_quantity::INT % 12 + 1"

_PLACES = lambda w: f"list_transform(range(1, len(string_split(t, {_q(w)}))), lambda i: (list_sum(list_transform(string_split(t, {_q(w)})[1:i], lambda p: length(p))) + (i - 1) * {len(w)} + 1)::BIGINT)"
_UNQUOTED = lambda w: f"list_filter({_PLACES(w)}, lambda p: NOT regexp_matches(substr(t, greatest(p - 90, 1), p - greatest(p - 90, 1)), {_CUE}))"
_KIND = f"CASE WHEN regexp_matches(substr(text, 1, 700), {_CIRCULAR}) THEN 'rbi_circular' " + " ".join(f"WHEN {_any(f'lower(substr(text, 1, {z}))', ws)} THEN '{k}'" for z in (700, 3000) for k, ws in _KINDS) + " ELSE 'unknown' END"
_LENDER = "CASE " + " ".join(f"WHEN {_any('lower(text)', ws)} THEN '{k}'" for k, ws in _LENDERS) + " END"
_EVIDENCE_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(substr(text, 1, 6000), {_q('(?i)' + p)}) THEN '{n}' END" for n, p in _EVIDENCE) + "], lambda x: x IS NOT NULL)"
# labels in the cues' order, each once
_EVIDENCE_ONCE = f"list_transform(list_sort(list_distinct(list_transform({_EVIDENCE_LIST}, lambda x: list_position([{', '.join(repr(n) for n in dict(_EVIDENCE))}], x)))), lambda i: [{', '.join(repr(n) for n in dict(_EVIDENCE))}][i])"
_MARKS = lambda ws: " + ".join(f"((length(near) - length(replace(near, {_q(w)}, ''))) / {len(w)})::INT" for w in ws)
_HEADING = rf"""(length(t) > 0 AND NOT regexp_matches(t, '[.;:,]$') AND len(regexp_split_to_array({P.strip_sql('rest')}, '\s+')) <= 12 AND NOT regexp_matches(rest, ':\s*\S') AND NOT regexp_matches(rest, '[0-9]'))"""
_REST = f"CASE WHEN regexp_extract(t, {_NUMBERED}, 2) <> '' THEN regexp_extract(t, {_NUMBERED}, 2) WHEN regexp_extract(t, {_STRUCTURAL}, 1) <> '' THEN regexp_extract(t, {_STRUCTURAL}, 2) ELSE t END"
_DATES = ((r"\b([0-9]{1,2})[stndrh]{0,2}\s+([A-Za-z]{3,9})[,\s]+([0-9]{4})\b", (1, 2, 3)), (r"\b([A-Za-z]{3,9})\s+([0-9]{1,2})[stndrh]{0,2}[,\s]+([0-9]{4})\b", (2, 1, 3)), (r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\b", (1, 2, 3)))


def _first_date(name: str, rows: str, zone: str) -> str:
    """CTEs that end in `name` (doc_id, day): first real, unquoted date of zone over rows."""
    out = []
    for k, (pattern, (d, m, y)) in enumerate(_DATES):
        month = f"coalesce(nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(regexp_extract(m, '{pattern}', {m}), 1, 3))), 0)::VARCHAR, CASE WHEN regexp_matches(regexp_extract(m, '{pattern}', {m}), '^[0-9]') THEN regexp_extract(m, '{pattern}', {m}) END)"
        day = f"try_strptime(regexp_extract(m, '{pattern}', {y}) || '-' || lpad({month}, 2, '0') || '-' || lpad(regexp_extract(m, '{pattern}', {d}), 2, '0'), '%Y-%m-%d')::DATE"
        out.append(
            f"""{name}{k}a AS (SELECT doc_id, {zone} AS z, regexp_extract_all({zone}, '{pattern}', 0) AS ms, regexp_split_to_array({zone}, '{pattern}') AS bs FROM {rows}),
{name}{k}b AS (SELECT doc_id, z, i, ms[i] AS m, 1 + list_sum(list_transform(bs[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS p FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}{k}a)),
{name}{k}c AS (SELECT doc_id, i, {day} AS day FROM {name}{k}b WHERE NOT regexp_matches(substr(z, greatest(p - 90, 1), p - greatest(p - 90, 1)), {_CUE})),
{name}{k} AS (SELECT doc_id, arg_min(day, i) AS day FROM {name}{k}c WHERE day IS NOT NULL GROUP BY doc_id)"""
        )
    days = ", ".join(f"{name}{k}.day" for k in range(3))
    return ", ".join(out) + f", {name} AS (SELECT r.doc_id, coalesce({days}) AS day FROM {rows} r " + " ".join(f"LEFT JOIN {name}{k} ON {name}{k}.doc_id = r.doc_id" for k in range(3)) + ")"


def _agreement_date(name: str, rows: str) -> str:
    """CTEs that end in `name` (doc_id, day) for rows (doc_id, text)."""
    head, tail = _first_date(f"{name}h", rows, "substr(text, 1, 2500)"), _first_date(f"{name}t", rows, "CASE WHEN length(text) > 2500 THEN substr(text, -1200) END")
    return f"{head}, {tail}, {name} AS (SELECT doc_id, coalesce({name}h.day, {name}t.day) AS day FROM {name}h JOIN {name}t USING (doc_id))"


_BASED = r"coalesce(nullif(regexp_extract(x, '(?i)original agreement dated\s*:?\s*([^\n|]{6,40})', 1), ''), nullif(regexp_extract(x, '(?i)agreement dated\s+([0-9]{1,2}\s+\w+\s+[0-9]{4})', 1), ''))"
_FROM = r"coalesce(nullif(regexp_extract(x, '(?i)this revision effective\s*:?\s*([^\n|]{6,40})', 1), ''), nullif(regexp_extract(x, '(?i)with effect from\s+([^\n,.;|]{6,40})', 1), ''), nullif(regexp_extract(x, '(?i)effective\s+(?:from\s+)?([0-9]{1,2}\s+\w+\s+[0-9]{4})', 1), ''))"
_AMENDS = f"""am AS (SELECT doc_id, substr(text, 1, 6000) AS x, {_EVIDENCE_ONCE} AS e, {_KIND} AS kind FROM marked), amd AS (SELECT * FROM am WHERE kind = 'loan_agreement' AND len(e) >= 2),
ab AS (SELECT doc_id, {_BASED} AS text FROM amd), af AS (SELECT doc_id, {_FROM} AS text FROM amd), {_agreement_date('bd', 'ab')}, {_agreement_date('fd', 'af')}"""

_CLEAN = f"regexp_replace({P.glyphs_sql('text')}, '([\\p{{L}}\\p{{N}}_])-{P.SPACE_SQL}*\\n{P.SPACE_SQL}*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '{P.BLANK_SQL}+(\\n|\\z)', '\\1', 'g')"

_STARTS = rf"""f AS (SELECT *, regexp_extract(t, {_NUMBERED}, 1) AS dec, regexp_extract(t, {_STRUCTURAL}, 1) AS word,
  len(regexp_extract_all(t, '\p{{L}}')) AS letters, len(regexp_extract_all(t, '\p{{Lu}}')) AS caps FROM paged),
s AS (SELECT *, length(t) > 0 AND (dec <> '' OR (word <> '' AND (upper(t) = t OR length(t) <= 90))
  OR (length(t) BETWEEN 3 AND 90 AND NOT ends_with(t, '.') AND len(regexp_split_to_array(t, '\s+')) <= 12 AND letters >= 3 AND caps >= letters * 0.85)) AS starts FROM f),
b AS (SELECT *, sum(starts::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS block FROM s),
g AS (SELECT document_id, block::BIGINT AS block, min(page) AS page_start, max(page) AS page_end, {P.strip_sql('string_agg(text, chr(10) ORDER BY line_no)')} AS x FROM b GROUP BY ALL)"""

SQL = {
    "clause_blocks": f"WITH {_LINES}, {_STARTS} SELECT document_id, block, page_start, page_end, md5(x) AS text_md5 FROM g WHERE length(x) > 0",
    "segmented_strategies": f"""WITH RECURSIVE {_DRAFTED}, {_STARTS}, h AS (SELECT document_id, block, x AS t, lead(block) OVER (PARTITION BY document_id ORDER BY block) AS nx FROM g WHERE x <> ''),
hr AS (SELECT *, {_REST} AS rest FROM h), k AS (SELECT document_id, count(*) FILTER (NOT (block > 0 AND NOT contains(t, chr(10)) AND {_HEADING} AND nx IS NOT NULL)) AS n FROM hr GROUP BY 1),
d AS (SELECT document_id, count(*) FILTER (dec <> '') >= 3 AS numbered, bool_or(starts) AS started FROM s GROUP BY 1),
w AS (SELECT document_id, 0::BIGINT AS ln, CASE WHEN t <> '' THEN length(text) ELSE 0 END AS size, 0 AS n FROM paged WHERE line_no = 0
  UNION ALL SELECT w.document_id, ln + 1, CASE WHEN p.t <> '' THEN size + length(p.text) WHEN size >= 900 THEN 0 ELSE size END, n + CASE WHEN p.t = '' AND size >= 900 THEN 1 ELSE 0 END
    FROM w JOIN paged p ON p.document_id = w.document_id AND p.line_no = ln + 1),
pn AS (SELECT document_id, arg_max(n, ln) + CASE WHEN arg_max(size, ln) > 0 THEN 1 ELSE 0 END AS n FROM w GROUP BY 1),
pg AS (SELECT document_id, count(*) AS n FROM (SELECT document_id, page FROM paged GROUP BY ALL HAVING bool_or(t <> '')) GROUP BY 1),
o AS (SELECT CASE WHEN started AND k.n >= 3 THEN CASE WHEN numbered THEN 'clause_numbering' ELSE 'headings' END WHEN pn.n >= 3 THEN 'paragraphs' ELSE 'pages' END AS strategy, k.n AS kn, pn.n AS pnn, pg.n AS pgn
  FROM d JOIN k USING (document_id) JOIN pn USING (document_id) JOIN pg USING (document_id))
SELECT strategy, count(*) AS documents, sum(CASE strategy WHEN 'paragraphs' THEN pnn WHEN 'pages' THEN pgn ELSE kn END)::BIGINT AS clauses FROM o GROUP BY 1""",
    "paragraph_clauses": f"""WITH RECURSIVE c AS (SELECT conv_id, text, {P.strip_sql('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, i, CASE WHEN t <> '' AND length(text) < 900 THEN text END AS cur, CASE WHEN t <> '' AND length(text) < 900 THEN length(text) ELSE 0 END AS size, CASE WHEN t <> '' AND length(text) >= 900 THEN [text] ELSE [] END AS done FROM c WHERE i = 1
  UNION ALL SELECT conv_id, i, CASE WHEN size < 900 THEN cur END, CASE WHEN size < 900 THEN size ELSE 0 END, CASE WHEN size >= 900 THEN list_append(done, cur) ELSE done END
    FROM (SELECT w.conv_id, c.i, CASE WHEN c.t = '' THEN cur WHEN cur IS NULL THEN c.text ELSE cur || chr(10) || c.text END AS cur, size + CASE WHEN c.t = '' THEN 0 ELSE length(c.text) END AS size, done FROM w JOIN c ON c.conv_id = w.conv_id AND c.i = w.i + 1)),
e AS (SELECT conv_id, arg_max(CASE WHEN cur IS NULL THEN done ELSE list_append(done, cur) END, i) AS ps FROM w GROUP BY 1)
SELECT conv_id AS document_id, len(ps) AS clauses, list_sum(list_transform(ps, lambda p: length({P.strip_sql('p')})))::BIGINT AS chars FROM e WHERE len(ps) > 0""",
    "loan_type_dominance": f"""WITH {_MARKED}, low AS (SELECT doc_id, lower(text) AS t FROM marked), """
    + "m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS loan_type, {_UNQUOTED(w)} AS places, {len(w)} AS size FROM low" for k, ws in _LOANS.items() for w in ws) + "), "
    + f"""c AS (SELECT doc_id, loan_type, sum(len(places)) AS n, sum(len(list_filter(places, lambda p: p + size <= 701))) AS z FROM m GROUP BY ALL HAVING sum(len(places)) > 0),
r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS nxt, count(*) OVER p AS many, count(*) FILTER (z > 0) OVER p AS zones, min(loan_type) FILTER (z > 0) OVER p AS zone
  FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, loan_type), p AS (PARTITION BY doc_id)),
o AS (SELECT doc_id, CASE WHEN zones = 1 THEN zone WHEN many = 1 OR n >= nxt * 3 THEN loan_type END AS loan_type FROM r WHERE r = 1) SELECT * FROM o WHERE loan_type IS NOT NULL""",
    "running_header_strip": f"""WITH {_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY line_no) AS a, row_number() OVER (PARTITION BY document_id, page ORDER BY line_no DESC) AS b FROM paged WHERE length(t) > 0),
pg AS (SELECT document_id, count(DISTINCT page) AS pages FROM paged GROUP BY 1),
seen AS (SELECT document_id, t, count(DISTINCT page) AS seen_on, bool_and(a <= {G.EDGE} OR b <= {G.EDGE}) AS always FROM f GROUP BY ALL),
chrome AS (SELECT document_id, t FROM seen JOIN pg USING (document_id) WHERE pages >= 2 AND always AND length(t) <= {G.CHROME_LENGTH} AND seen_on >= CASE WHEN pages <= 3 THEN pages ELSE floor(pages * 0.6 + 0.5) END)
SELECT document_id, line_no, page, text FROM paged p WHERE NOT EXISTS (SELECT 1 FROM chrome c WHERE c.document_id = p.document_id AND c.t = p.t)""",
    "page_clauses": rf"""WITH {_LINES}, g AS (SELECT document_id, page, {P.strip_sql('string_agg(text, chr(10) ORDER BY line_no)')} AS x FROM paged GROUP BY ALL)
SELECT document_id, page AS page_start, md5(x) AS text_md5 FROM g WHERE length(x) > 0""",
    "boilerplate_filter": f"""WITH l AS (SELECT page_id, unnest(regexp_split_to_array(trim(regexp_replace(html, '<[^>]*>', chr(10), 'g')), '\\n+')) AS text FROM pages)
SELECT page_id, count(*) AS lines, count(*) FILTER ({_BOILER}) AS furniture FROM l WHERE length(text) > 0 GROUP BY 1""",
    "chunking_report": f"""WITH RECURSIVE {_SPLIT}, n AS (SELECT doc_id, length(text) < {C.LEAST} AS s, length(text) >= {C.LEAST} AND {_BOILER} AS b, len(parts) AS n FROM documents JOIN done ON chunk_id = doc_id)
SELECT sum(CASE WHEN s OR b THEN 0 ELSE n END)::BIGINT AS produced, count(*) FILTER (NOT s AND NOT b AND n > 1) AS split, count(*) FILTER (s) AS skipped_short, count(*) FILTER (b) AS skipped_boilerplate FROM n""",
    "chunk_split": f"WITH RECURSIVE {_SPLIT} SELECT chunk_id, unnest(range(0, len(parts))) AS part, md5(unnest(parts)) AS piece_md5 FROM done",
    "chunk_sentences": f"SELECT doc_id AS chunk_id, len({_PIECES}) AS sentences FROM documents",
    "numbering_gaps": f"""WITH s AS (SELECT l_orderkey AS document_id, list(DISTINCT {_NUM}) AS tops FROM lineitem GROUP BY 1)
SELECT document_id, array_to_string(list_filter(range(1, list_max(tops) + 1), lambda x: NOT list_contains(tops, x)), ',') AS missing FROM s WHERE len(tops) >= {G.GAP_FROM} AND list_max(tops) > len(tops)""",
    "few_clauses": f"""WITH s AS (SELECT source AS document_id, lang, count(*) AS n, max(length(text)) AS m FROM documents GROUP BY ALL)
SELECT document_id, lang, 'few_clauses' AS code FROM s WHERE n < {G.FEW} UNION ALL SELECT document_id, lang, 'oversized_clause' FROM s WHERE m > {G.OVERSIZED}""",
    "clause_number_sort": """WITH c AS (SELECT p_brand AS document_id, p_size AS a, p_partkey % 17 AS b, p_partkey AS k, CASE WHEN p_size % 5 <> 0 THEN p_size || '.' || (p_partkey % 17) END AS number FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY number IS NULL, CASE WHEN number IS NOT NULL THEN a END, CASE WHEN number IS NOT NULL THEN b END, k) - 1 AS ordinal FROM c)
SELECT document_id, number, ordinal, k::VARCHAR AS content_hash, format('{}-v1-c{:04d}', document_id, ordinal) AS clause_id FROM r""",
    "kind_detect": f"WITH {_MARKED} SELECT doc_id, {_KIND} AS kind FROM marked",
    "lender_class_detect": f"WITH {_MARKED} SELECT doc_id, {_LENDER} AS lender_class FROM marked",
    "metadata_resolve": f"WITH {_MARKED} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'nbfc' WHEN {_KIND} <> 'rbi_circular' THEN {_LENDER} END AS lender_class FROM marked",
    "borrower_type_detect": f"""WITH {_MARKED}, low AS (SELECT doc_id, lower(text) AS t FROM marked),
w AS (SELECT doc_id, array_to_string(list_transform(({_PLACES('borrower')})[1:40], lambda p: string_split(substr(t, greatest(p - 180, 1), p - greatest(p - 180, 1)), 'lender')[-1] || string_split(substr(t, p, 180), 'lender')[1]), ' ') AS near FROM low),
c AS (SELECT doc_id, {_MARKS(_INDIVIDUAL)} AS i, {_MARKS(_BUSINESS)} AS b FROM w),
o AS (SELECT doc_id, CASE WHEN i > 0 AND i >= b * 3 THEN 'individual' WHEN b > 0 AND b >= i * 3 THEN 'business' END AS borrower_type FROM c) SELECT * FROM o WHERE borrower_type IS NOT NULL""",
    "agreement_date_detect": f"WITH {_MARKED}, {_agreement_date('ad', 'marked')} SELECT doc_id, day AS agreement_date FROM ad",
    "amendment_evidence": f"WITH {_MARKED} SELECT doc_id, array_to_string({_EVIDENCE_ONCE}, ',') AS evidence FROM marked",
    "amendment_detect": f"""WITH {_MARKED}, {_AMENDS} SELECT doc_id, nullif(regexp_extract(x, {_ACCOUNT}, 1), '') AS account, bd.day AS base_dated, fd.day AS effective_from, array_to_string(e, ',') AS evidence
FROM amd JOIN bd USING (doc_id) JOIN fd USING (doc_id)""",
    "pinned_summaries": f"""WITH {_MARKED}, {_AMENDS}, r AS (SELECT doc_id, {_KIND} AS kind, {_LENDER} AS lender, fd.doc_id IS NOT NULL AS revised, fd.day AS d FROM marked LEFT JOIN fd USING (doc_id))
SELECT doc_id::VARCHAR AS document_id, concat_ws(chr(10), 'Document: ' || CASE WHEN doc_id % 2 = 0 THEN 'No. ' ELSE '' END || doc_id, 'Type: ' || CASE WHEN revised THEN 'amendment' ELSE replace(kind, '_', ' ') END, 'Version: 1',
  'Lender class: ' || replace(lender, '_', ' '), CASE WHEN revised THEN 'Revision effective: ' || d END, CASE WHEN revised THEN 'This version revises an earlier agreement; unlisted clauses carry forward.' END, 'Clauses in force: ' || (doc_id % 5)) AS summary FROM r""",
    "heading_lines": f"WITH {_LINES}, h AS (SELECT document_id, t, {_REST} AS rest FROM paged) SELECT document_id, count(*) FILTER ({_HEADING}) AS headings FROM h GROUP BY 1",
    "document_titles": f"""WITH {_LINES}, g AS (SELECT document_id, page, {P.strip_sql('string_agg(text, chr(10) ORDER BY line_no)')} AS x FROM paged GROUP BY ALL),
c AS (SELECT document_id, page, array_to_string(list_filter(list_transform(string_split({P.strip_sql('string_split(x, chr(10))[1]')}, ' / '), lambda p: {P.strip_sql('p')}), lambda p: p <> '' AND NOT list_contains(
  ['preamble', 'search', 'notifications', 'master circulars', 'master directions', 'annex', 'annexure', 'schedule', 'more links :', 'more links', 'e-lms', 'rss', 'follow rbi'], lower(p))), ' / ') AS t FROM g WHERE x <> '' AND page <= 5),
b AS (SELECT document_id, arg_min(t, page) AS t FROM c WHERE length(t) BETWEEN 6 AND 120 GROUP BY 1)
SELECT doc_id AS document_id, coalesce(t, 'file ' || doc_id) AS title FROM documents LEFT JOIN b ON document_id = doc_id""",
    "clause_chunks": f"""WITH RECURSIVE {P.CHUNKS_SQL}, {_SPLIT}, k AS (SELECT c.*, parts FROM chunks c JOIN done USING (chunk_id) WHERE length(c.text) >= 25 AND NOT {_BOILER.replace('text', 'c.text')}),
e AS (SELECT format('{{}}-v{{}}-c{{:04d}}', document_id, version, chunk_id) AS clause, document_id, version, chunk_id, content_hash, len(parts) AS n, unnest(range(0, len(parts))) AS i, unnest(parts) AS part FROM k)
SELECT CASE WHEN n = 1 THEN clause ELSE clause || '-p' || i END AS chunk_id, row_number() OVER (PARTITION BY document_id, version ORDER BY e.chunk_id, i) - 1 AS ordinal,
  CASE WHEN length(part) < 1000 THEN CASE WHEN n = 1 THEN content_hash ELSE {P.hash_sql('part')} END END AS content_hash, length(part)::INT AS chars FROM e""",
    "corpus_chunks": f"""WITH RECURSIVE {P.CHUNKS_SQL}, {_SPLIT}, k AS (SELECT c.*, parts FROM chunks c JOIN done USING (chunk_id) WHERE version = 1 AND length(c.text) >= 25 AND NOT {_BOILER.replace('text', 'c.text')}),
m AS (SELECT source AS document_id, min(lang) AS circular_id FROM documents GROUP BY 1),
e AS (SELECT document_id, format('{{}}-c{{:04d}}', document_id, chunk_id) || CASE WHEN len(parts) > 1 THEN '-p' || unnest(range(0, len(parts))) ELSE '' END AS id, unnest(parts) AS part FROM k)
SELECT document_id, 1 AS version, circular_id, 'corpus' AS source_kind, count(*) AS chunks, min(id) AS first_chunk, count(*) - 1 AS last_ordinal FROM e JOIN m USING (document_id) GROUP BY ALL""",
    "file_fingerprints": "SELECT page_id, substr(sha256(html), 1, 16) AS fingerprint FROM pages WHERE html IS NOT NULL",
    "stemmed_terms": f"SELECT term, count(*) AS documents FROM (SELECT unnest({P.terms_sql('text')}) AS term FROM documents) GROUP BY 1",
    "deleted_numbers": rf"""WITH {_MARKED}, s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, {_DELETES})) AS ss FROM marked),
r AS (SELECT doc_id, array_to_string(list_transform(ss, lambda s: array_to_string(regexp_extract_all(s, {_REFERENCE}, 1), ' ')), ' ') AS t FROM s)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[0-9]{{1,2}}(?:\.[0-9]{{1,2}})*'))), ',') AS deleted FROM r""",
    "document_keys": f"""WITH {_MARKED}, a AS (SELECT doc_id, regexp_extract(text, {_ACCOUNT}, 1) AS a FROM marked)
SELECT doc_id, CASE WHEN a <> '' THEN 'loan-' || regexp_replace(regexp_replace(a, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') ELSE 'doc-loan-file-' || doc_id || '-v2' END AS document_key FROM a""",
    "figure_extract": f"SELECT doc_id, array_to_string(list_sort({P.figures_sql('text')}), ',') AS figures FROM documents",
    "clean_text": rf"""SELECT doc_id, md5({P.strip_sql(_CLEAN)}) AS clean_md5 FROM documents""",
}
