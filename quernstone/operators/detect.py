"""Detectors: kind, loan type, lender class, borrower type, dates, amendments, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Dominance ratio, zones in characters, reach of a citation cue, markers.
DOMINANCE = 3
ZONE, KIND_ZONE, DATE_ZONE, TAIL_ZONE, CUE_ZONE, AMENDMENT_ZONE = 700, 3000, 2500, 1200, 90, 6000
BORROWER_WINDOW, BORROWER_MOST = 180, 40
EVIDENCE = 2

_QUOTED_CUE = r"(?i)(circular|notification|master direction|master circular|directions,\s*[0-9]{4}|RBI/[0-9]{4}-[0-9]{2}|DOR\.|DNBS|DNBR)"
_CIRCULAR = r"(?i)\bRBI/[0-9]{4}-[0-9]{2}/[0-9]+\b|\b(master circular|master direction|notification)\b"
#: Title markers of each kind of document, in the order in which they are tried.
KINDS = (
    ("key_facts_statement", ("key facts statement", "key fact statement")),
    ("sanction_letter", ("sanction letter", "letter of sanction", "sanction advice")),
    ("loan_agreement", ("loan agreement", "loan cum hypothecation", "facility agreement", "credit agreement")),
)
#: Words that name each family of loans.
LOANS = {
    "home": ("home loan", "housing loan", "mortgage loan"),
    "vehicle": ("vehicle loan", "car loan", "auto loan", "two wheeler loan"),
    "education": ("education loan", "student loan"),
    "gold": ("gold loan", "loan against gold", "gold jewellery"),
    "microfinance": ("microfinance loan", "micro finance loan", "jlg loan"),
    "credit_card": ("credit card agreement", "cardholder agreement"),
    "business": ("business loan", "working capital", "msme loan", "term loan to msme"),
    "personal": ("personal loan", "consumer loan"),
}
#: Lender classes, the specific before the generic.
LENDERS = (
    ("housing_finance_company", ("housing finance company", "housing finance limited")),
    ("nbfc_mfi", ("nbfc-mfi", "nbfc mfi", "micro finance institution")),
    ("nbfc", ("non-banking financial company", "non banking financial company", "nbfc")),
    ("small_finance_bank", ("small finance bank",)),
    ("regional_rural_bank", ("regional rural bank", "gramin bank")),
    ("cooperative_bank", ("co-operative bank", "cooperative bank", "urban co-op")),
    ("scheduled_commercial_bank", ("scheduled commercial bank", "banking regulation act, 1949")),
)
BUSINESS = ("private limited", "pvt. ltd", "pvt ltd", "llp", "partnership firm", "proprietorship", "msme", "udyam", "gstin")
INDIVIDUAL = ("an individual", "individual borrower", "co-borrower", "aadhaar", "mr.", "ms.", "mrs.", "shri", "smt")
_ACCOUNT = r"(?i)loan (?:account|a/c)(?:\s*no\.?|\s*number)?\s*:?\s*([A-Z0-9][A-Z0-9/\-]{5,40})"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def detect_kind(text: Column, hint: Column | None = None) -> Column:
    """The hint, else a circular by its reference or title in the first 700 characters, else
    the first title marker found there, else in the first 3,000. Amendments are loan
    agreements here; detect_amendment tells them apart."""
    head, more = F.lower(F.substring(text, 1, ZONE)), F.lower(F.substring(text, 1, KIND_ZONE))
    out = F.when(F.substring(text, 1, ZONE).rlike(_CIRCULAR), "rbi_circular")
    for zone in (head, more):
        for kind, marks in KINDS:
            out = out.when(_any(zone, marks), kind)
    out = out.otherwise("unknown")
    return out if hint is None else F.coalesce(F.when(hint != "unknown", hint), out)


def quoted_at(text: Column, position: Column) -> Column:
    """Whether a citation cue stands within 90 characters before a position (from 1)."""
    start = F.greatest(position - CUE_ZONE, F.lit(1))
    return F.substring(text, start, position - start).rlike(_QUOTED_CUE)


def occurrences(text: Column, word: str) -> Column:
    """Positions (from 1) of a word in a text."""
    parts = F.split(text, rf"\Q{word}\E")
    ends = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p, i: F.length(p))
    running = F.aggregate(ends, F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("n")), lambda s, x: F.struct(F.concat(s["a"], F.array(s["n"] + x + 1)).alias("a"), (s["n"] + x + len(word)).alias("n")), lambda s: s["a"])
    return running


def loan_type_scores(docs: DataFrame, key: str) -> DataFrame:
    """key, loan_type, n, in_title: unquoted mentions of each family."""
    low = docs.select(key, F.lower("text").alias("t"))
    each = F.array(*(F.struct(F.lit(k).alias("loan_type"), F.filter(occurrences(F.col("t"), w), lambda p: ~quoted_at(F.col("t"), p)).alias("at"), F.lit(len(w)).alias("size")) for k, ws in LOANS.items() for w in ws))
    rows = low.select(key, F.explode(each).alias("e")).select(key, "e.loan_type", F.size("e.at").alias("n"), F.size(F.filter("e.at", lambda p: p + F.col("e.size") <= ZONE + 1)).alias("z"))
    return rows.groupBy(key, "loan_type").agg(F.sum("n").alias("n"), F.sum("z").alias("in_title")).where("n > 0")


def dominant(scores: DataFrame, key: str, kind: str, n: str = "n", title: str | None = None) -> DataFrame:
    """key, kind: the only one in the title zone, else the only one at all, else the one
    with at least three times the runner-up's mentions; else none."""
    w = W.partitionBy(key)
    order = w.orderBy(F.col(n).desc(), kind)
    zone = F.col(title) if title else F.lit(0)
    rows = scores.withColumns({
        "_r": F.row_number().over(order), "_next": F.lead(n).over(order), "_many": F.count(F.lit(1)).over(w),
        "_zones": F.sum((zone > 0).cast("int")).over(w), "_zone": F.min(F.when(zone > 0, F.col(kind))).over(w),
    }).where("_r = 1")
    best = F.when(F.col("_zones") == 1, F.col("_zone")).when((F.col("_many") == 1) | (F.col(n) >= F.col("_next") * DOMINANCE), F.col(kind))
    return rows.select(key, best.alias(kind)).where(F.col(kind).isNotNull())


def detect_loan_type(docs: DataFrame, key: str) -> DataFrame:
    return dominant(loan_type_scores(docs, key), key, "loan_type", title="in_title")


def detect_lender_class(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, words in LENDERS:
        cond = _any(low, words)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def borrower_context(text: Column) -> Column:
    """What stands around the first 40 places of "borrower", each window cut at the nearest
    "lender"; the windows are joined by spaces."""
    low, n = F.lower(text), BORROWER_WINDOW

    def window(p: Column) -> Column:
        before = F.substring(low, F.greatest(p - n, F.lit(1)), p - F.greatest(p - n, F.lit(1)))
        after = F.substring(low, p, F.lit(n))
        return F.concat(F.element_at(F.split(before, "lender"), -1), F.element_at(F.split(after, "lender"), 1))

    return F.array_join(F.transform(F.slice(occurrences(low, "borrower"), 1, BORROWER_MOST), window), " ")


def borrower_type(text: Column) -> Column:
    """individual or business: the only one whose markers stand around "borrower", or the one
    with at least three times the other's; else null."""
    near = borrower_context(text)
    count = lambda words: sum((F.regexp_count(near, F.lit(rf"\Q{w}\E")) for w in words), F.lit(0))
    found = F.transform(F.array(F.struct(count(INDIVIDUAL).alias("a"), count(BUSINESS).alias("b"))), lambda x: (
        F.when((x["a"] > 0) & (x["a"] >= x["b"] * DOMINANCE), "individual").when((x["b"] > 0) & (x["b"] >= x["a"] * DOMINANCE), "business")
    ))
    return found.getItem(0)


def detect_borrower_type(docs: DataFrame, key: str) -> DataFrame:
    """key, borrower_type of the documents that have one."""
    return docs.select(key, borrower_type(F.col("text")).alias("borrower_type")).where("borrower_type IS NOT NULL")


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: Dates as they are written, in the order in which they are looked for, and which group is
#: the day, the month and the year.
DATES = (
    (r"\b([0-9]{1,2})[stndrh]{0,2}\s+([A-Za-z]{3,9})[,\s]+([0-9]{4})\b", (1, 2, 3)),
    (r"\b([A-Za-z]{3,9})\s+([0-9]{1,2})[stndrh]{0,2}[,\s]+([0-9]{4})\b", (2, 1, 3)),
    (r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\b", (1, 2, 3)),
)


def matches_at(text: Column, pattern: str) -> Column:
    """Array of (m, p): each match of a pattern and its position (from 1)."""
    found, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern)
    start = F.struct(F.array().cast("array<struct<m:string,p:int>>").alias("a"), F.lit(1).alias("n"))
    both = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("b")))

    def step(s: Column, x: Column) -> Column:
        at = s["n"] + x["b"]
        return F.struct(F.concat(s["a"], F.array(F.struct(x["m"].alias("m"), at.cast("int").alias("p")))).alias("a"), (at + F.length(x["m"])).cast("int").alias("n"))

    return F.aggregate(both, start, step, lambda s: s["a"])


def _written_date(written: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    day, month, year = (F.regexp_extract(written, pattern, g) for g in groups)
    named = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(month, 1, 3))).cast("string")
    number = F.when(month.rlike("^[0-9]"), month).otherwise(F.when(named != "0", named))
    return F.try_to_date(F.concat(year, F.lit("-"), F.lpad(number, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def first_date(zone: Column) -> Column:
    """First real date of a text that no citation cue stands before: those with a month's
    name first, the day before it or after it, then those in figures."""
    found = []
    for pattern, groups in DATES:
        free = F.filter(matches_at(zone, pattern), lambda x: ~quoted_at(zone, x["p"]))
        days = F.filter(F.transform(free, lambda x: _written_date(x["m"], pattern, groups)), lambda d: d.isNotNull())  # noqa: B023
        found.append(F.get(days, F.lit(0)))
    return F.coalesce(*found)


def detect_agreement_date(text: Column) -> Column:
    """First date not quoted from a regulation in the first 2,500 characters, else in the
    last 1,200 of a longer text."""
    tail = F.when(F.length(text) > DATE_ZONE, first_date(F.substring(text, -TAIL_ZONE, TAIL_ZONE)))
    return F.coalesce(first_date(F.substring(text, 1, DATE_ZONE)), tail)


# Cues of an amendment and the evidence they are, in order; what dates follow.
CUES = (
    ("carry-forward clause", r"(?i)save as (?:expressly |otherwise )?(?:revised|amended|varied)"),
    ("carry-forward clause", r"(?i)continue in full force"),
    ("carry-forward clause", r"(?i)(?:remain|continue)s? (?:unchanged|in effect|to apply)"),
    ("not restated", r"(?i)not restated in this document"),
    ("names a base agreement", r"(?i)\boriginal agreement\b"),
    ("revision summary", r"(?i)summary of revisions?"),
    ("per-clause revision", r"(?i)this revises clause\b"),
    ("version marker", r"(?i)\brevised\s*[-–—]?\s*version\s*[0-9]+"),
    ("stands revised", r"(?i)stands? revised\b"),
)
EFFECTIVE_FROM = (
    r"(?i)this revision effective\s*:?\s*([^\n|]{6,40})",
    r"(?i)with effect from\s+([^\n,.;|]{6,40})",
    r"(?i)effective\s+(?:from\s+)?([0-9]{1,2}\s+\w+\s+[0-9]{4})",
)
BASE_DATED = (
    r"(?i)original agreement dated\s*:?\s*([^\n|]{6,40})",
    r"(?i)agreement dated\s+([0-9]{1,2}\s+\w+\s+[0-9]{4})",
)


def amendment_evidence(text: Column) -> Column:
    """Distinct labels of the cues in the first 6,000 characters, in the cues' order."""
    zone = F.substring(text, 1, AMENDMENT_ZONE)
    return F.array_distinct(F.array_compact(F.array(*(F.when(zone.rlike(p), F.lit(label)) for label, p in CUES))))


def _first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    found = [F.regexp_extract(text, p, 1) for p in patterns]
    return F.coalesce(*(F.when(x != "", x) for x in found))


def detect_amendment(text: Column, kind: Column) -> Column:
    """Struct of account number, base and effective date and evidence, if the document is a
    loan agreement with two or more kinds of evidence; else null."""
    head = F.substring(text, 1, AMENDMENT_ZONE)
    found = amendment_evidence(text)
    account = _first_match(head, (_ACCOUNT,))
    target = F.struct(
        account.alias("loan_account_number"), detect_agreement_date(_first_match(head, BASE_DATED)).alias("base_dated"),
        detect_agreement_date(_first_match(head, EFFECTIVE_FROM)).alias("effective_from"), found.alias("evidence"),
    )
    return F.when((kind == "loan_agreement") & (F.size(found) >= EVIDENCE), target)


def document_key(text: Column, filename: Column) -> Column:
    """``loan-`` and the account number, or ``doc-`` and the file's stem, as a slug."""
    account = _first_match(text, (_ACCOUNT,))
    slug = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(account.isNotNull(), F.concat(F.lit("loan-"), slug(account))).otherwise(F.concat(F.lit("doc-"), F.lower(slug(F.regexp_replace(filename, r"\.[^.]*$", "")))))


def resolve_metadata(kind: Column, hint: Column, detected: Column) -> Column:
    """A hint wins; detectors say nothing about circulars."""
    return F.coalesce(hint, F.when(kind != "rbi_circular", detected))
