"""Applicability: set-containment axes and validity intervals. Unknown widens, an empty
axis is unrestricted; a row is excluded only where both sides are stated and disagree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = (("loan_type", "loan_types"), ("borrower_type", "borrower_types"), ("lender_class", "lender_classes"))


def axis_allows(value: Column, allowed: Column) -> Column:
    return allowed.isNull() | (F.size(allowed) == 0) | value.isNull() | F.coalesce(F.array_contains(allowed, value), F.lit(False))


def in_force(as_of: Column, start: Column, end: Column) -> Column:
    """Inclusive interval; an unknown bound or date excludes nothing."""
    return F.coalesce(start <= as_of, F.lit(True)) & F.coalesce(as_of <= end, F.lit(True))


def applicable(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of queries (loan_type, borrower_type, lender_class, as_of) and rules
    (loan_types .. , effective_from, effective_to) that apply; other columns are kept."""
    fits = reduce(lambda a, b: a & b, [axis_allows(queries[q], rules[r]) for q, r in AXES if q in queries.columns and r in rules.columns], F.lit(True))
    return queries.join(rules, fits & in_force(queries["as_of"], rules["effective_from"], rules["effective_to"]))


def coverage_gaps(questions: DataFrame, repeals: DataFrame) -> DataFrame:
    """Questions (question, loan_date) about subjects whose rules were replaced after the
    loan: repeals (effective_from, subject_keywords, circulars, title)."""
    asked = F.lower(questions["question"])
    about = F.exists(repeals["subject_keywords"], lambda k: asked.contains(F.lower(k)))
    pairs = questions.join(repeals, (questions["loan_date"] < repeals["effective_from"]) & about)
    message = F.format_string("%s applies from %s; your loan of %s is under the rules before it.", F.col("title"), F.date_format("effective_from", "d MMMM yyyy"), F.date_format("loan_date", "d MMMM yyyy"))
    return pairs.withColumn("message", message)
