"""Segmentation: lines to clauses, running headers, headings, warnings.

Lines are rows (document_id, version, line_no, page, text, is_ocr, is_heading). Starts,
blocks and fallbacks are windows and aggregates; only heading promotion and the paragraph
fallback are order-dependent, and they fold over one document's bounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

DOC = ("document_id", "version")
# Lines at a page's edge, most characters of a running header, paragraph size,
# words of a heading, and how clauses start.
EDGE, CHROME_LENGTH, PARAGRAPH, HEADING_WORDS, LEAST_CLAUSES = 2, 120, 900, 12, 3
_NUMBERED = r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})[.)]?\s+([A-Za-z\"'(].*)$"
_STRUCTURAL = r"(?i)^((?:SCHEDULE|ANNEXURE|ANNEX|APPENDIX|PART|SECTION|ARTICLE|CLAUSE)(?:\s+[IVXLC0-9]+[A-Z]?)?)\b[:.\-\s]*(.*)$"


def strip_running_headers(lines: DataFrame, key: tuple[str, ...] = DOC) -> DataFrame:
    """Lines without running headers and footers: short texts that stand at a page's edge
    wherever they occur, on enough pages of a document of two or more."""
    page = W.partitionBy(*key, "page")
    trimmed = F.trim("text")
    filled = lines.withColumn("_t", trimmed).where(F.length("_t") > 0)
    first = F.row_number().over(page.orderBy("line_no"))
    last = F.row_number().over(page.orderBy(F.col("line_no").desc()))
    edges = filled.withColumn("_edge", (first <= EDGE) | (last <= EDGE))
    pages = lines.groupBy(*key).agg(F.countDistinct("page").alias("_pages"))
    seen = edges.groupBy(*key, "_t").agg(F.countDistinct("page").alias("_on"), F.bool_and("_edge").alias("_always")).join(pages, list(key))
    needed = F.when(F.col("_pages") <= 3, F.col("_pages")).otherwise(F.floor(F.col("_pages") * 0.6 + 0.5))
    chrome = seen.where((F.col("_pages") >= 2) & (F.col("_on") >= needed) & F.col("_always") & (F.length("_t") <= CHROME_LENGTH)).select(*key, "_t")
    return lines.withColumn("_t", trimmed).join(chrome, [*key, "_t"], "left_anti").select(*lines.columns)


def is_capitalised_heading(line: Column) -> Column:
    t = F.trim(line)
    letters, upper = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    words = F.size(F.split(t, r"\s+"))
    return F.length(t).between(3, 90) & ~t.endswith(".") & (words <= 12) & (letters >= 3) & (upper >= letters * 0.85)


def looks_like_heading(text: Column) -> Column:
    """Whether a lone line is only a title: no closing mark, few words beside its number, no
    figure, no ``label: value``."""
    t = X.strip(text)
    numbered, structural = F.regexp_extract(t, _NUMBERED, 2), F.regexp_extract(t, _STRUCTURAL, 1)
    rest = F.when(numbered != "", numbered).when(structural != "", F.regexp_extract(t, _STRUCTURAL, 2)).otherwise(t)
    return (F.length(t) > 0) & ~t.rlike(r"[.;:,]$") & (F.size(F.split(X.strip(rest), r"\s+")) <= HEADING_WORDS) & ~rest.rlike(r":\s*\S") & ~rest.rlike("[0-9]")


def find_starts(lines: DataFrame) -> DataFrame:
    """lines with is_start, number, start_heading and is_decimal (a number that was not
    declared a heading)."""
    t = X.strip(F.col("text"))
    decimal, word = F.regexp_extract(t, _NUMBERED, 1), F.regexp_extract(t, _STRUCTURAL, 1)
    declared = F.coalesce(F.col("is_heading"), F.lit(False)) & (F.length(t) > 0)
    structural = (word != "") & ((F.upper(t) == t) | (F.length(t) <= 90))
    capital = is_capitalised_heading(t)
    title = F.when(declared, t).when(decimal != "", F.when(looks_like_heading(t), X.strip(F.regexp_extract(t, _NUMBERED, 2)))).when(structural | capital, t)
    return lines.withColumns({
        "is_start": declared | (decimal != "") | structural | capital,
        "number": F.when(decimal != "", decimal).when(declared & (word != ""), word).when(structural, F.upper(word)),
        "start_heading": title,
        "is_decimal": ~declared & (decimal != ""),
        "is_declared": declared,
    })


def blocks(started: DataFrame, key: tuple[str, ...] = DOC) -> DataFrame:
    """One row a block: from a start to before the next; block 0 is what stands before.
    has_body: whether a line after the first has text."""
    order = W.partitionBy(*key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = started.withColumn("block", F.sum(F.col("is_start").cast("int")).over(order))
    first = lambda c: F.min_by(c, "line_no").alias(c)
    out = rows.groupBy(*key, "block").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("_l"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.bool_or("is_ocr").alias("is_ocr"), first("number"), first("start_heading"), first("is_decimal"), first("is_declared"),
    )
    text = X.strip(F.array_join(F.transform("_l", lambda x: x["text"]), "\n"))
    return out.withColumns({"text": text, "has_body": text.contains("\n")}).drop("_l").where(F.length("text") > 0)


def promote_headings(rows: DataFrame, key: tuple[str, ...] = DOC) -> DataFrame:
    """Folds blocks that are only a heading into the blocks after them. Consecutive ones
    join to a section, which holds for the blocks until the next; a structural block that
    isn't a number ends it."""
    w = W.partitionBy(*key).orderBy("block")
    heading_only = F.col("is_declared") | looks_like_heading(F.col("text"))
    bare = (F.col("block") > 0) & ~F.col("has_body") & heading_only & F.lead("block").over(w).isNotNull()
    rows = rows.withColumn("_bare", bare)
    after_bare = F.coalesce(F.lag("_bare").over(w), F.lit(False))
    reset = ~F.col("_bare") & ~after_bare & F.coalesce(~F.col("number").rlike("^[0-9]"), F.lit(False))
    change = F.col("_bare") & ~after_bare
    run = F.sum((change | reset).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_run", run)
    title = F.coalesce("start_heading", "text")
    titles = F.filter(F.collect_list(F.when(F.col("_bare"), title)).over(W.partitionBy(*key, "_run").orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), lambda x: x.isNotNull())
    rows = rows.withColumn("section", F.array_join(titles, " / "))
    kept = rows.where(~F.col("_bare"))
    heading = F.concat_ws(" / ", F.when(F.col("section") != "", F.col("section")), "start_heading")
    return kept.withColumn("heading", F.when(heading != "", heading)).drop("_bare", "_run", "section")


def paragraphs(lines: DataFrame, key: tuple[str, ...] = DOC, target: int = PARAGRAPH) -> DataFrame:
    """Fallback: non-blank lines gather until a blank line follows at target characters (line
    ends not counted)."""
    packed = lines.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("line_no", "text", "page", F.coalesce("is_ocr", F.lit(False)).alias("o")))).alias("l"))
    one = "struct<text:string,n:int,p:int,q:int,o:boolean>"
    kind = f"struct<done:array<{one}>,cur:{one}>"
    none = F.lit(None).cast(one)

    def step(s: Column, x: Column) -> Column:
        blank = F.length(X.strip(x["text"])) == 0
        cur = s["cur"]
        full = cur.isNotNull() & (cur["n"] >= target)
        grown = F.struct(
            F.when(cur.isNull(), x["text"]).otherwise(F.concat(cur["text"], F.lit("\n"), x["text"])).alias("text"),
            (F.coalesce(cur["n"], F.lit(0)) + F.length(x["text"])).cast("int").alias("n"), F.coalesce(cur["p"], x["page"]).cast("int").alias("p"), x["page"].cast("int").alias("q"), (F.coalesce(cur["o"], F.lit(False)) | x["o"]).alias("o"),
        )
        flushed = F.struct(F.concat(s["done"], F.array(cur)).alias("done"), none.alias("cur"))
        return F.when(blank & full, flushed.cast(kind)).when(blank, s).otherwise(F.struct(s["done"].alias("done"), grown.alias("cur")).cast(kind))

    start = F.struct(F.array().cast(f"array<{one}>").alias("done"), none.alias("cur")).cast(kind)
    end = lambda s: F.when(s["cur"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"])))
    parts = packed.select(*key, F.posexplode(F.aggregate("l", start, step, end)).alias("block", "x"))
    return parts.select(*key, "block", X.strip(F.col("x.text")).alias("text"), F.col("x.p").alias("page_start"), F.col("x.q").alias("page_end"), F.col("x.o").alias("is_ocr"))


def pages(lines: DataFrame, key: tuple[str, ...] = DOC) -> DataFrame:
    """Fallback: a clause a page."""
    out = lines.groupBy(*key, "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"), F.bool_or("is_ocr").alias("is_ocr"))
    text = X.strip(F.array_join(F.transform("l", lambda x: x["text"]), "\n"))
    return out.select(*key, F.col("page").alias("block"), text.alias("text"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "is_ocr").where(F.length("text") > 0)


def segment(lines: DataFrame, key: tuple[str, ...] = DOC) -> DataFrame:
    """Clauses of each document by the best strategy that gives three or more: clause
    numbering or headings, paragraphs, pages. Columns: key, strategy, notes, ordinal,
    number, heading, text, page_start, page_end, is_ocr."""
    started = find_starts(lines)
    numbered = started.groupBy(*key).agg((F.count_if("is_decimal") >= LEAST_CLAUSES).alias("_numbered"), F.bool_or("is_start").alias("_started"))
    structured = promote_headings(blocks(started, key), key).withColumn("heading", F.when(F.col("block") == 0, F.lit("Preamble")).otherwise(F.col("heading")))
    para, page = paragraphs(lines, key), pages(lines, key)
    count = lambda d, n: d.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    plan = numbered.join(count(structured, "_s"), list(key), "left").join(count(para, "_p"), list(key), "left")
    enough = F.col("_started") & (F.coalesce("_s", F.lit(0)) >= LEAST_CLAUSES)
    strategy = (
        F.when(enough & F.col("_numbered"), "clause_numbering")
        .when(enough, "headings")
        .when(F.coalesce("_p", F.lit(0)) >= LEAST_CLAUSES, "paragraphs")
        .otherwise("pages")
    )
    note = {"headings": "no clause numbers found: headings were used", "paragraphs": "no clause structure found: paragraphs were used", "pages": "no structure found: pages were used"}
    notes = F.array_compact(F.array(*(F.when(F.col("strategy") == s, F.lit(n)) for s, n in note.items())))
    plan = plan.withColumn("strategy", strategy).select(*key, "strategy").withColumn("notes", notes)
    cols = [*key, "block", "number", "heading", "text", "page_start", "page_end", "is_ocr"]
    none = lambda d: d.withColumns({"number": F.lit(None).cast("string"), "heading": F.lit(None).cast("string")}).select(*cols)
    s = structured.select(*cols).withColumn("_kind", F.lit("s"))
    rows = s.unionByName(none(para).withColumn("_kind", F.lit("p"))).unionByName(none(page).withColumn("_kind", F.lit("g")))
    wanted = F.when(F.col("strategy").isin("clause_numbering", "headings"), "s").when(F.col("strategy") == "paragraphs", "p").otherwise("g")
    rows = rows.join(plan, list(key)).where(F.col("_kind") == wanted)
    order = W.partitionBy(*key).orderBy("block")
    return rows.withColumn("ordinal", F.row_number().over(order) - 1).select(*key, "strategy", "notes", "ordinal", "number", "heading", "text", "page_start", "page_end", "is_ocr")


# Headings that identify nothing; lengths of a title.
DULL = (
    "preamble", "search", "notifications", "master circulars", "master directions", "annex", "annexure", "schedule",
    "more links :", "more links", "e-lms", "rss", "follow rbi",
)
TITLE = (6, 120)


def titles(clauses: DataFrame, names: DataFrame, key: tuple[str, ...] = DOC) -> DataFrame:
    """key, title: the first telling heading or first line of the first five clauses, else
    the file's name, else the document's id. names: key and filename."""
    line = X.strip(F.coalesce(F.when(F.col("heading") != "", F.col("heading")), F.element_at(F.split("text", "\n"), 1)))
    told = F.filter(F.transform(F.split(line, " / "), X.strip), lambda p: (p != "") & ~F.lower(p).isin(*DULL))
    rows = clauses.where("ordinal < 5").withColumn("_t", F.array_join(told, " / ")).where(F.length("_t").between(*TITLE))
    best = rows.groupBy(*key).agg(F.min_by("_t", "ordinal").alias("_t"))
    return names.join(best, list(key), "left").select(*key, F.coalesce("_t", F.when(F.col("filename") != "", F.col("filename")), F.col(key[0]).cast("string")).alias("title"))


FEW, OVERSIZED, GAP_FROM = 3, 4000, 5


def structural_warnings(clauses: DataFrame, key: tuple[str, ...] = DOC) -> DataFrame:
    """key, code, page, missing: few clauses, oversized clauses, gaps in the top numbers."""
    top = F.regexp_extract("number", r"^([0-9]+)", 1)
    per = clauses.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("page_start", F.struct("ordinal")).alias("_first"),
        F.min(F.when(F.length("text") > OVERSIZED, F.struct("ordinal", "page_start"))).alias("_big"),
        F.array_sort(F.collect_set(F.when(top != "", top.cast("int")))).alias("tops"),
    )
    missing = F.when(F.size("tops") >= GAP_FROM, F.array_sort(F.array_except(F.sequence(F.lit(1), F.array_max("tops")), "tops"))).otherwise(F.array().cast("array<int>"))
    per = per.withColumn("missing", missing)
    one = lambda cond, code, page: F.when(cond, F.struct(F.lit(code).alias("code"), page.cast("int").alias("page")))
    all_ = F.array_compact(F.array(
        one(F.col("n") < FEW, "few_clauses", F.lit(None)), one(F.col("_big").isNotNull(), "oversized_clause", F.col("_big.page_start")), one(F.size("missing") > 0, "numbering_gap", F.lit(None)),
    ))
    rows = per.select(*key, "missing", F.explode(all_).alias("w"))
    return rows.select(*key, F.col("w.code").alias("code"), F.col("w.page").alias("page"), F.when(F.col("w.code") == "numbering_gap", F.col("missing")).alias("missing"))
