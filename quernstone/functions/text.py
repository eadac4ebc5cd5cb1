"""Text functions as Spark columns: normalisation, hashes, tokens, terms, figures, sentences.

Everything but NFKC is built-in expressions; NFKC has no built-in and runs as an Arrow
pandas function, which texts that are ASCII only never reach.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Glyphs that extraction leaves behind and what they stand for, the stop lists
# of retrieval, verification, embedding and extraction, and their token patterns.
GLYPHS = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"',
    "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00a0": " ", "\u200b": "", "\ufeff": "", "\ufffd": "",
}
RETRIEVAL_STOP = (
    "a an the and or of to in on for by with is are be as at from this that shall will may can what how do does i my me if it its their there any"
).split()
VERIFY_STOP = (
    "a an the and or of to in on for by with is are be as at from this that shall will may can your you their its it if any such other under has have had"
    " yes not but also there here which what when would could does did was were been being into onto about than then them they these those our out"
).split()
EMBEDDING_STOP = (
    "a an and or of to in on for by with the this that shall be is are as at from any such other under which it its their his her been being will may must not no"
    " borrower lender agreement clause loan"
).split()
EXTRACT_STOP = (
    "a an the and or of to in on for by with is are be as at from this that i my me what how do does can will shall if it its their there any would could"
).split()
RETRIEVAL_TOKEN = r"[a-z0-9]+(?:[.,][0-9]+)*%?"
EMBEDDING_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
EXTRACT_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*%?"

#: White space of any script, and without the line feed, for Java's and RE2's patterns.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BLANK = SPACE.replace(r"\t-\r", r"\t\x0b-\r")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


def nfkc(text: Column) -> Column:
    """NFKC form; ASCII texts are passed through without leaving the JVM's row."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfkc(text))


def glyphs(text: Column) -> Column:
    one = {k: v for k, v in GLYPHS.items() if v}
    gone = "".join(k for k, v in GLYPHS.items() if not v)
    return F.translate(text, "".join(one) + gone, "".join(one.values()))


def strip(text: Column) -> Column:
    """text without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def clean_extracted(text: Column, normalise: bool = True) -> Column:
    """Extracted text with glyphs replaced, hyphenated line ends rejoined and space evened;
    line ends stay."""
    t = glyphs(nfkc(text) if normalise else text)
    t = F.regexp_replace(t, rf"([\p{{L}}\p{{N}}_])-{SPACE}*\n{SPACE}*([\p{{L}}\p{{N}}_])", "$1$2")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, rf"{BLANK}+(\n|\z)", "$1"))


def hash_normal(text: Column, normalise: bool = True) -> Column:
    """The form that content hashes see: case, digits and punctuation stay."""
    t = glyphs(nfkc(text) if normalise else text)
    return F.trim(F.regexp_replace(t, rf"{SPACE}+", " "))


def content_hash(text: Column, normalise: bool = True) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(hash_normal(text, normalise).cast("binary"), 256))


def fingerprint(content: Column) -> Column:
    """First 16 hex digits of a file's sha256."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def tokens(text: Column) -> Column:
    """Retrieval tokens: lower case, stop words and single characters dropped."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({RETRIEVAL_TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*RETRIEVAL_STOP))


def extract_terms(text: Column) -> Column:
    """Distinct terms for choosing a sentence."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({EXTRACT_TOKEN})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*EXTRACT_STOP)))


# --- verification terms

# Suffixes (the first that leaves four letters goes), stems that mean the same,
# words after which a number is an address, abbreviations whose full stop ends nothing.
SUFFIXES = ("ments", "ment", "ings", "ing", "ions", "ion", "ed", "es", "er", "ly", "s")
SYNONYMS = {
    "prepa": "prepa", "forec": "prepa", "payof": "prepa", "repai": "prepa",
    "charg": "charg", "fee": "charg", "cost": "charg", "penal": "charg", "levi": "charg",
    "lende": "lende", "bank": "lende", "insti": "lende", "borro": "borro", "loan": "borro",
    "lock": "lock", "lockin": "lock",
}
ADDRESS = r"(?:clauses?|paragraphs?|para|sections?|schedule|annex(?:ure)?|part|item|page|circular|no\.?)"
FIGURE = r"[0-9][0-9,]*(?:\.[0-9]+)?"
ABBREVIATION = r"(?i)\b(Rs|No|Nos|Mr|Mrs|Ms|Dr|Smt|Shri|Cl|Para|viz|approx|p\.a|i\.e|e\.g|vs|etc|Ltd|Pvt)\."


def stem(token: Column) -> Column:
    """A token without a suffix, cut to five letters, synonyms folded."""
    cut = F.regexp_replace(token, f"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$", "$1")
    short = F.substring(cut, 1, 5)
    folds = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    return F.coalesce(F.try_element_at(folds, short), short)


def terms(text: Column) -> Column:
    """Distinct stemmed terms of a sentence or passage."""
    t = F.replace(F.replace(F.lower(text), F.lit("pay off"), F.lit("payoff")), F.lit("lock-in"), F.lit("lockin"))
    found = F.regexp_extract_all(t, F.lit(f"({RETRIEVAL_TOKEN})"), F.lit(1))
    kept = F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin(*VERIFY_STOP))
    return F.array_distinct(F.transform(kept, stem))


def figures(text: Column) -> Column:
    """Distinct amounts and numbers, without those that only address a place in a text."""
    t = F.regexp_replace(text, rf"(?i){ADDRESS}\s*(?:rs\.?\s*|₹\s*)?{FIGURE}", " ")
    found = F.regexp_extract_all(t, F.lit(f"({FIGURE})"), F.lit(1))
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"\.0+$|(\.[0-9]*?[1-9])0+$", "$1"))
    return F.array_distinct(plain)


# --- sentences

_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def claim_sentences(text: Column) -> Column:
    """Sentences for the claim filter: lines joined, marks of lists at their ends gone."""
    lines = F.filter(F.split(text, _LINES), lambda x: F.length(strip(x)) > 0)
    flat = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^[ *•-]+|[ *•-]+\z", "")), " ")
    parts = F.split(F.regexp_replace(flat, rf"([.!?]){SPACE}+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)


def answer_sentences(text: Column) -> Column:
    """Sentences of an answer: lines stay apart, a bullet line is one sentence, and full
    stops of abbreviations end nothing. A blank line is an empty sentence."""
    protect = lambda s: F.regexp_replace(s, ABBREVIATION, "$1\ue000")
    cut = lambda s: F.split(F.regexp_replace(protect(s), rf"([.!?]){SPACE}+(?=[A-Z\[(\"'])", "$1\u0001"), "\u0001")
    lines = F.transform(F.transform(F.split(text, "\n"), strip), lambda s: F.when(s.rlike(r"^[-*•] "), F.array(s)).otherwise(cut(s)))
    return F.transform(F.flatten(lines), lambda s: strip(F.replace(s, F.lit("\ue000"), F.lit("."))))
