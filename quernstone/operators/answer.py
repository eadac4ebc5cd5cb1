"""Answers: extraction, verification sentence by sentence, claim filter, fallback, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Least support, its margin for matching figures, least common terms; passages
# in an answer, share of the best score, characters of a sentence; what answers and
# verification say; claims that an explanation without sources must not make, in order.
SUPPORT, BOOST, OVERLAP, LEAST_TERMS = 0.28, 0.05, 2, 3
BEST, KEEP_SHARE, CUT, SHORT = 4, 0.5, 400, 40
NOT_FOUND = "I could not find anything in your document that answers that."
HEAD = "Based on the clauses retrieved from your documents:"
FOOT = "Each point above is quoted from the source shown in brackets. Open the citations panel to read the clause in full."
REASONS = {
    "free": "no factual claim", "uncited": "no citation", "figures": "states a figure its source does not contain: ",
    "unsupported": "cited passage does not support the claim", "nothing": "citation points at nothing",
}
CLAIMS = (
    (
        "regulatory claim",
        r"(?i)\b(rbi|reserve bank|circular|direction|regulat\w*|regulator|law|legal|illegal|lawful|statut\w*|ombudsman rules?|guidelines?|mandat\w*|compliance|compliant)\b",
    ),
    (
        "claim about the borrower's document",
        r"(?i)\b(your (agreement|contract|loan|lender|bank|kfs|key facts|document|emi|rate|clause|schedule|tenure|policy)|this (agreement|contract|loan|clause|document)|"
        r"the agreement|the clause|clause [0-9]|schedule [ivx0-9]|in your case)\b",
    ),
    (
        "statement of obligation or permission",
        r"(?i)\b(must|shall|required|requires?|not allowed|allowed to|permitted|prohibit\w*|forbid\w*|entitled|cannot legally|is not legal|are obliged|obligated|have the right)\b",
    ),
    ("specific figure", r"[0-9]"),
)
_NO_CLAIM = r"(?i)^\s*(?:based on|here is|here are|in summary|to summarise|in short|each point|open the citations|the clauses? (?:retrieved|below)|this means|note that)\b"
_NOISE = r"(?i)^\s*(?:refer|see|as set out|as specified)\b"
#: Parts of words that a question may have, and what they mean in general.
GLOSSARY = (
    ("lock-in", "A lock-in period is generally a stretch of time at the start of a loan during which the borrower cannot repay it early."),
    ("prepay", "Prepayment usually means paying back some or all of a loan before its scheduled end, which reduces the interest paid over the remaining term."),
    ("foreclos", "Foreclosure, in Indian lending usage, generally means closing a loan entirely by repaying the whole outstanding amount early."),
    ("penal", "Penal charges are usually fees a lender applies when a payment is late or a loan condition is not met."),
    ("emi", "An EMI, or equated monthly instalment, is the fixed monthly payment that covers both interest and part of the principal."),
    ("apr", "The annual percentage rate generally expresses the yearly cost of a loan including fees, which makes offers easier to compare than the interest rate alone."),
    ("key facts", "A Key Facts Statement is a short summary a lender gives before signing, setting out the main costs and terms of a loan in a standard format."),
    ("floating", "A floating interest rate moves up or down with a benchmark rate, so the EMI or the tenure can change over the life of the loan."),
    ("tenure", "The tenure of a loan is the length of time over which it is repaid."),
    ("principal", "The principal is the amount actually borrowed, as distinct from the interest charged on it."),
    ("processing fee", "A processing fee is usually a one-time charge for assessing and setting up a loan."),
    ("insurance", "Credit life insurance on a loan generally pays off the outstanding balance if the borrower dies, and its premium is sometimes added to the amount borrowed."),
    ("collateral", "Collateral, or security, is an asset pledged against a loan that the lender can claim if the loan is not repaid."),
    ("mortgage", "A mortgage is a charge over property, usually a home, given as security for a loan."),
    ("interest", "Interest is the price of borrowing money, usually expressed as a yearly percentage of the amount owed."),
    ("tax", "How loan repayments are treated for tax depends on personal circumstances and is outside what a loan document covers."),
    ("refinanc", "Refinancing generally means taking a new loan, often from a different lender, to pay off an existing one on better terms."),
    ("co-borrower", "A co-borrower shares responsibility for repaying a loan alongside the main borrower."),
    ("moratorium", "A moratorium is a period during which repayments are paused or reduced, though interest may still accrue."),
)
TERMS_SAID = 3
ADVISOR = (
    "For a specific answer about your loan, speak to a qualified financial adviser or to your lender's grievance officer, and take your agreement and Key Facts Statement with you."
)
# texts of our own, as the given ones name a product
NO_TERM = "No general loan term in this question was recognised that could be explained without a source."
NOTICE = "No source found. Nothing in your document or in the corpus answers this question closely enough to rely on, so no specific answer is given."


def best_sentence(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, sentence, score: of each (key.., question, text) the sentence with the most of
    the question's terms; the first with score 0 if none is better. Cut to 400 characters."""
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    pieces = F.filter(F.transform(F.split(F.regexp_replace(flat, r"([.;])\s+", "$1\u0001"), "\u0001"), X.strip), lambda p: p != "")
    each = rows.select(*key, X.extract_terms(F.col("question")).alias("_q"), F.posexplode_outer(pieces).alias("_i", "_s"))
    common = F.size(F.array_intersect(X.extract_terms(F.col("_s")), "_q"))
    score = common + F.when(F.col("_s").rlike("[0-9]"), 0.5).otherwise(0.0) - F.when(F.length("_s") < SHORT, 0.5).otherwise(0.0)
    each = each.withColumn("_score", score.cast("double"))
    best = each.groupBy(*key).agg(F.max_by(F.struct("_s", "_score"), F.struct("_score", -F.col("_i"))).alias("b"), F.min_by("_s", "_i").alias("_first"))
    better = F.col("b._score") > 0
    return best.select(*key, F.substring(F.when(better, F.col("b._s")).otherwise(F.coalesce("_first", F.lit(""))), 1, CUT).alias("sentence"), F.when(better, F.col("b._score")).otherwise(0.0).alias("score"))


def source_label(number: Column, page: Column, reference: Column) -> Column:
    """Where a passage stands: in the circular of that reference, or in the user's document."""
    place = F.when(number.rlike(r"^[0-9]"), F.concat(F.lit("clause "), number)).otherwise(F.concat(F.lit("page "), page.cast("string")))
    return F.concat(F.coalesce(F.concat(F.lit("RBI "), reference), F.lit("Your agreement")), F.lit(", "), place)


def extract_answer(passages: DataFrame) -> DataFrame:
    """query_id, answer from (query_id, n, label, question, text): the best sentences of up
    to four passages that come to half the best one's score, each with its number; those
    that only point elsewhere don't count."""
    scored = best_sentence(passages, ["query_id", "n", "label"])
    usable = (F.col("sentence") != "") & ~F.col("sentence").rlike(_NOISE)
    rows = scored.withColumn("_usable", usable).withColumn("_score", F.when(usable, F.col("score")))
    top = F.max("_score").over(W.partitionBy("query_id"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("_score").desc_nulls_last(), "n"))
    rows = rows.withColumns({"_top": top, "_place": place})
    good = F.col("_usable") & (F.col("_top") > 0) & (F.col("_score") >= F.col("_top") * KEEP_SHARE) & (F.col("_place") <= BEST)
    line = F.concat(F.lit("- "), "label", F.lit(": "), "sentence", F.lit(" ["), F.col("n").cast("string"), F.lit("]"))
    per = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(good, F.struct("_place", line.alias("l"))))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["l"]), "\n")
    return per.select("query_id", F.when(F.size("ls") > 0, F.concat(F.lit(HEAD + "\n\n"), body, F.lit("\n\n" + FOOT))).otherwise(F.lit(NOT_FOUND)).alias("answer"))


def filter_claims(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, seq, sentence, label: label of the first kind of claim, null where it is kept."""
    label = None
    for name, pattern in CLAIMS:
        cond = F.col("sentence").rlike(pattern)
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return rows.select(key, F.posexplode(X.claim_sentences(F.col(text))).alias("seq", "sentence")).withColumn("label", label)


def glossary(questions: DataFrame, key: str = "query_id") -> DataFrame:
    """key, explanation: of the terms in a question, the first three in the glossary's order."""
    asked = F.lower("question")
    hits = F.array_compact(F.array(*(F.when(asked.contains(term), F.lit(says)) for term, says in GLOSSARY)))
    return questions.select(key, F.when(F.size(hits) > 0, F.array_join(F.slice(hits, 1, TERMS_SAID), " ")).otherwise(F.lit(NO_TERM)).alias("explanation"))


def fallback(questions: DataFrame, key: str = "query_id") -> DataFrame:
    """key, notice, explanation (its claims filtered), advisor."""
    said = filter_claims(glossary(questions, key), key, "explanation").where("label IS NULL")
    kept = said.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "sentence"))), lambda x: x["sentence"]), " ").alias("explanation"))
    return questions.select(key).join(kept, key, "left").select(key, F.lit(NOTICE).alias("notice"), F.coalesce("explanation", F.lit(NO_TERM)).alias("explanation"), F.lit(ADVISOR).alias("advisor"))


def verify(answers: DataFrame, passages: DataFrame, min_support: float = SUPPORT, blanks: bool = False) -> DataFrame:
    """Each sentence of answers (answer_id, question, text) held against the passages
    (answer_id, n, text) that it cites: answer_id, seq, sentence, kept, reason, support,
    citations (the passages that support it). Passages' terms and figures are made once
    each. With blanks, blank lines are kept rows of their own."""
    s = answers.select("answer_id", X.figures(F.col("question")).alias("_asked"), F.posexplode(X.answer_sentences(F.col("text"))).alias("seq", "sentence"))
    body = X.strip(F.regexp_replace("sentence", r"\[[0-9]+\]", ""))
    s = s.withColumns({"_b": body, "_t": X.terms(body), "_f": X.figures(body), "_m": F.array_distinct(F.transform(F.regexp_extract_all("sentence", F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.try_cast("int")))})
    if not blanks:
        s = s.where(F.length("sentence") > 0)
    p = passages.select("answer_id", "n", X.terms(F.col("text")).alias("_pt"), X.figures(F.col("text")).alias("_pf"))
    cited = s.select("answer_id", "seq", "_t", "_f", F.explode("_m").alias("n")).join(p, ["answer_id", "n"])
    common = F.size(F.array_intersect("_t", "_pt"))
    share = F.when(F.size("_t") > 0, common / F.size("_t")).otherwise(F.lit(0.0))
    all_there = (F.size("_f") > 0) & (F.size(F.array_except("_f", "_pf")) == 0) & (common >= OVERLAP)
    support = F.when(all_there, F.greatest(share, F.lit(min_support + BOOST))).otherwise(share)
    cited = cited.withColumn("_support", support.cast("double"))
    good = F.col("_support") >= min_support
    per = cited.groupBy("answer_id", "seq").agg(
        F.max("_support").alias("support"), F.collect_set(F.when(good, F.col("n"))).alias("_good"), F.array_distinct(F.flatten(F.collect_list(F.when(good, F.col("_pf"))))).alias("_said")
    )
    rows = s.join(per, ["answer_id", "seq"], "left")
    empty, none = F.array().cast("array<string>"), F.array().cast("array<int>")
    wild = F.array_sort(F.array_except("_f", F.array_union(F.coalesce("_said", empty), "_asked")))
    blank = F.length("sentence") == 0
    free = F.col("_b").rlike(_NO_CLAIM) | (F.size("_t") < LEAST_TERMS)
    sup, backing = F.coalesce("support", F.lit(0.0)), F.coalesce(F.col("_good").cast("array<int>"), none)
    reason = (
        F.when(blank, "").when(free, REASONS["free"]).when(F.size("_m") == 0, REASONS["uncited"])
        .when((F.size(backing) > 0) & (F.size(wild) > 0), F.concat(F.lit(REASONS["figures"]), F.array_join(wild, ", ")))
        .when((F.size(backing) == 0) & (sup > 0), REASONS["unsupported"]).when(F.size(backing) == 0, REASONS["nothing"]).otherwise("")
    )
    rows = rows.withColumn("reason", reason)
    kept = F.col("reason").isin("", REASONS["free"])
    cites = F.when(F.col("reason") == "", F.filter("_m", lambda n: F.array_contains(backing, n))).otherwise(none)
    return rows.select("answer_id", "seq", "sentence", kept.alias("kept"), "reason", F.when(blank | free, F.lit(1.0)).otherwise(sup).alias("support"), cites.alias("citations"))


def verified_answers(sentences: DataFrame) -> DataFrame:
    """answer_id, text of the sentences kept, number stripped, fully_grounded; two blank
    lines or more become one."""
    kept = F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("seq", "sentence"))))
    per = sentences.groupBy("answer_id").agg(kept.alias("k"), F.count_if(~F.col("kept")).alias("stripped"))
    text = F.regexp_replace(X.strip(F.array_join(F.transform("k", lambda x: x["sentence"]), "\n")), r"\n{3,}", "\n\n")
    return per.select("answer_id", text.alias("text"), "stripped", (F.col("stripped") == 0).alias("fully_grounded"))


def prompt(passages: DataFrame, summaries: DataFrame, rules: str) -> DataFrame:
    """query_id, prompt: the rules, the summary of the document if there is one (query_id,
    summary), then the passages (query_id, n, label, text) with their numbers."""
    block = F.format_string("[%d] %s\n%s", F.col("n").cast("int"), F.col("label"), X.strip(F.col("text")))
    per = passages.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))).alias("bs"))
    about = F.concat(F.lit("The document being discussed:\n"), "summary")
    body = F.concat(F.lit("Passages:\n\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n"))
    return per.join(summaries, "query_id", "left").select("query_id", F.concat_ws("\n\n", F.lit(rules), about, body).alias("prompt"))


def events(gated: DataFrame, coverage: DataFrame, citations: DataFrame, answers: DataFrame, fallbacks: DataFrame, degraded: DataFrame | None = None) -> DataFrame:
    """query_id, seq, event, payload: meta, then fallback and done, or coverage, citations,
    degraded, delta, verified and done. gated: (query_id, outcome, confidence, and considered
    if it is known); the others: (query_id, payload), answers also verified."""
    open_ = gated.where("outcome = 'answer'").select("query_id")
    shut = gated.where("outcome <> 'answer'").select("query_id")
    frame = lambda d, rank, name, payload: d.select("query_id", F.lit(rank).alias("_rank"), F.lit(name).alias("event"), payload.alias("payload"))
    told = ["outcome", F.round("confidence", 4).alias("confidence"), *(["considered"] if "considered" in gated.columns else [])]
    rows = frame(gated, 0, "meta", F.to_json(F.struct(*told))).unionByName(frame(fallbacks.join(shut, "query_id"), 1, "fallback", F.col("payload")))
    for rank, name, d in ((2, "coverage", coverage), (3, "citations", citations), (4, "degraded", degraded), (5, "delta", answers)):
        if d is not None:
            rows = rows.unionByName(frame(d.join(open_, "query_id"), rank, name, F.col("payload")))
    rows = rows.unionByName(frame(answers.join(open_, "query_id"), 6, "verified", F.col("verified")))
    rows = rows.unionByName(frame(gated, 7, "done", F.to_json(F.struct((F.col("outcome") == "answer").alias("grounded")))))
    order = W.partitionBy("query_id").orderBy("_rank", "payload")
    return rows.withColumn("seq", F.row_number().over(order)).select("query_id", "seq", "event", "payload")
