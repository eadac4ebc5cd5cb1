"""A training-data pipeline over ``documents``: quality rules, near-duplicates, repeated
passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs; all but the last return the columns of documents.

Defined cases, for every stage: an empty table gives none; null text counts as empty; null ids,
languages and sources are values like others; repeated rows are rows of their own (but for
near_duplicates, which leaves one); very long texts are read whole; extra columns are given
back by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import mixing, pieces, quality, simhash, suffixes
from quernstone.llm.common import intermediates, materialize, table

#: Seeds of the near-duplicate stage's fingerprints. Of the pairs of different texts at sf0.1
#: whose similarity is 0.8 or more, one fingerprint within three bits finds 25 of 47, five
#: find 42, nine 45.
NEAR_SEEDS = tuple(range(42, 51))
#: Similarity on five-word shingles at which texts that the fingerprints propose are near copies.
NEAR = (7, 10)
#: Bytes of a string that goes where it comes twice: fifty words of four letters and a space.
PASSAGE = 250


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier estimates reject go; small groups take
    pooled estimates. Null and empty texts go, as they have no words."""
    return quality.kept_documents(docs, pooled=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays (a null id is the
    smallest; of several texts under that id the one of least hash). Texts are near copies if
    their fingerprints link and their shingles are alike; texts that share an id, or have
    none, are told apart; of repeated rows, and of texts without a word, one stays."""
    return simhash.one_of_each(docs, word_seeds=NEAR_SEEDS, groups=6, verify=True, alike_at=NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes that come twice or more go from all places, the first one
    included; no document goes. Null text becomes empty, n_chars is that of what is left;
    characters of which a part goes are left out."""
    return suffixes.deduped_documents(docs, PASSAGE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them: a row for each time, the
    last one cut after its last word taken. Texts without a word are never taken."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece ids and their digests, with the decoding's check; empty texts
    have no ids."""
    return pieces.digests(docs, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mix),
    ("pieces", tokens),
]

#: SQL can't express the estimates' iterations, the components or the piece encoder; the
#: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes for itself goes when its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with intermediates():
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
