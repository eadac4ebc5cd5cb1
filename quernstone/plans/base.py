"""How the given tables play the engine's roles, and SQL pieces that several queries share.

documents are chunks: a chunk's document is its source, its version 1 + doc_id % 2, its kind
``corpus`` for every fourth id, else ``user_document``. benchmark items are questions;
embeddings are vectors of the documents of the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 4 == 0, "corpus").otherwise("user_document")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), (F.col("doc_id") % 2 + 1).cast("int").alias("version"),
        "text", X.content_hash(F.col("text")).alias("content_hash"), kind.alias("source_kind"), "lang", "n_chars",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of a search: every row whose id is divisible by 20."""
    return vectors(spark, sf_dir).where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))


# The SQL states fixed values itself, so that it holds the operators to them.
_WORDS = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
STOP_SQL = _WORDS(
    "a an the and or of to in on for by with is are be as at from this that shall will may can what how do does i my me if it its their there any"
)
SPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BLANK_SQL = r"[\t\x0b-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[.,][0-9]+)*%?'), lambda tk: length(tk) > 1 AND NOT list_contains({STOP_SQL}, tk))"


VERIFY_STOP_SQL = _WORDS(
    "a an the and or of to in on for by with is are be as at from this that shall will may can your you their its it if any such other under has have had"
    " yes not but also there here which what when would could does did was were been being into onto about than then them they these those our out"
)
_SYNONYMS = "MAP {'prepa': 'prepa', 'forec': 'prepa', 'payof': 'prepa', 'repai': 'prepa', 'charg': 'charg', 'fee': 'charg', 'cost': 'charg', 'penal': 'charg', 'levi': 'charg', 'lende': 'lende', 'bank': 'lende', 'insti': 'lende', 'borro': 'borro', 'loan': 'borro', 'lock': 'lock', 'lockin': 'lock'}"


def terms_sql(text: str) -> str:
    found = f"regexp_extract_all(replace(replace(lower({text}), 'pay off', 'payoff'), 'lock-in', 'lockin'), '[a-z0-9]+(?:[.,][0-9]+)*%?')"
    short = r"substr(regexp_replace(x, '^(.{4,}?)(?:ments|ment|ings|ing|ions|ion|ed|es|er|ly|s)$', '\1'), 1, 5)"
    return f"list_distinct(list_transform(list_filter({found}, lambda x: length(x) > 2 AND NOT list_contains({VERIFY_STOP_SQL}, x)), lambda x: coalesce({_SYNONYMS}[{short}], {short})))"


def figures_sql(text: str) -> str:
    address = r"(?i)(?:clauses?|paragraphs?|para|sections?|schedule|annex(?:ure)?|part|item|page|circular|no\.?)\s*(?:rs\.?\s*|₹\s*)?[0-9][0-9,]*(?:\.[0-9]+)?"
    found = rf"regexp_extract_all(regexp_replace({text}, '{address}', ' ', 'g'), '[0-9][0-9,]*(?:\.[0-9]+)?')"
    return rf"list_distinct(list_transform({found}, lambda v: regexp_replace(replace(v, ',', ''), '\.0+$|(\.[0-9]*?[1-9])0+$', '\1')))"


def glyphs_sql(text: str) -> str:
    """The texts given are NFKC already, so SQL leaves that step out."""
    ascii_ = "'" + "''" * 3 + '"' * 3 + "---'"
    quotes = f"translate({text}, '‘’‚“”„–—−' || chr(160), {ascii_} || ' ')"
    return f"replace(replace(replace({quotes}, chr(8203), ''), chr(65279), ''), chr(65533), '')"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE_SQL}+|{SPACE_SQL}+\\z', '', 'g')"


def hash_sql(text: str) -> str:
    return f"'sha256:' || sha256(trim(regexp_replace({glyphs_sql(text)}, '{SPACE_SQL}+', ' ', 'g')))"


CHUNKS_SQL = f"""chunks AS (SELECT doc_id AS chunk_id, source AS document_id, (doc_id % 2 + 1)::INT AS version, text,
  {hash_sql('text')} AS content_hash, CASE WHEN doc_id % 4 = 0 THEN 'corpus' ELSE 'user_document' END AS source_kind, lang, n_chars FROM documents)"""
