"""Retrieval: dense and lexical scores, fusion, rerank, near-duplicates, top-k.

Questions are a table: every operator works for all query ids at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import materialize

# fixed values: BM25, fusion weights, near-duplicate threshold, reserved places
K1, B = 1.5, 0.75
DENSE_WEIGHT, LEXICAL_WEIGHT = 0.65, 0.35
NEAR_DUPLICATE = 0.92
#: Queries that are sent to all executors at once: 4 MB of 1,024 single floats each.
QUERY_BLOCK = 1000
RESERVED = 4

# Questions about money and about what is permitted, passages that state a
# figure or only point elsewhere, and what each is worth.
_MONEY = (
    r"(?i)\b(charge|charges|fee|fees|cost|costs|rate|penalty|penal|percent|%|rs|rupees|how much|amount|emi|premium|lock-?in|period|months?|years?)\b"
)
_REGULATORY = (
    r"(?i)\b(allowed|permitted|permissible|legal|lawful|is it legal|rbi|reserve bank|regulations?|rules?|compliant|complies|comply|entitled to charge|"
    r"are they allowed|supposed to)\b"
)
_HAS_FIGURE = r"(?i)(?:[0-9]+(?:\.[0-9]+)?\s*%|rs\.?\s*[0-9,]+|[0-9]+\s*(?:months?|days?|years?))"
_CROSS_REFERENCE = r"(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*\s+)?(?:refer|please refer|see|as (?:set out|specified|provided))\b"
OVERSIZED = 1200
BONUS = {"document": 0.06, "document_asked_rules": 0.03, "corpus_asked_rules": 0.10, "cross_reference": -0.08, "oversized": -0.05, "figure": 0.05, "numbered": 0.02, "topic": 0.12}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """A vector scaled to length one, in doubles; a zero vector stays."""
    d = v.cast("array<double>")
    size = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(size), lambda n: F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))).getItem(0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float vectors; 0 if either is zero."""
    return dot(unit(a), unit(b))


def dense_topk(queries: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, dense, rank. queries: (query_id, q); store: (chunk_id, v).

    Vectors of another dimension are skipped. The stated queries meet the store in blocks
    of about QUERY_BLOCK, each small enough to be sent to all executors, so the store is
    never shuffled; the window keeps k rows a query in each task before the shuffle.
    """
    # lengths are taken once a vector; a pair costs one product
    queries, store = queries.withColumn("q", unit(F.col("q"))), store.withColumn("v", unit(F.col("v")))
    blocks = max(1, -(-queries.agg(F.count(F.lit(1))).first()[0] // QUERY_BLOCK))
    out = []
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        pairs = store.join(F.broadcast(block), F.size("q") == F.size("v"))
        scored = pairs.select("query_id", "chunk_id", F.round(dot(F.col("q"), F.col("v")), 4).alias("dense"))
        order = W.partitionBy("query_id").orderBy(F.col("dense").desc(), "chunk_id")
        out.append(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return reduce(DataFrame.unionByName, out)


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", F.explode(X.tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def bm25(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, chunk_id, bm25 of candidates (query_id, chunk_id, text) for questions
    (query_id, question). N, document frequencies and the average length are those of
    each query's candidates; a term that a question repeats counts as often.

    Texts are cut into tokens once: what is kept of them, a row for each asked term in a
    text and one for the text itself, is a table that all sums are taken from."""
    docs = candidates.select("query_id", "chunk_id", X.tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    every = docs.select("query_id", "chunk_id", "len", F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    hits = every.join(_asked(questions), ["query_id", "term"], "left").where("qf IS NOT NULL OR term = ''")
    hits = materialize(hits.groupBy("query_id", "chunk_id", "len", "term", "qf").agg(F.count(F.lit(1)).alias("tf")), "bm25-hits")
    own, texts = hits.where("term <> ''"), hits.where("term = ''")
    per_query = texts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    df = own.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return _bm25_sum(own.join(df, ["query_id", "term"]).join(per_query, "query_id"))


def bm25_corpus(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """As bm25(), all queries sharing one candidate set (chunk_id, text). Only terms that
    some question asks are shuffled and kept."""
    docs = corpus.select("chunk_id", X.tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    asked = _asked(questions)
    wanted = asked.select("term").distinct().withColumn("_wanted", F.lit(True))
    every = docs.select("chunk_id", "len", F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    hits = every.join(wanted, "term", "left").where("_wanted OR term = ''")
    hits = materialize(hits.groupBy("chunk_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "bm25-hits")
    tf, whole = hits.where("term <> ''"), hits.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _bm25_sum(tf.join(df, "term").join(asked, "term").crossJoin(F.broadcast(whole)))


def _bm25_sum(hits: DataFrame) -> DataFrame:
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    ratio = F.when(F.col("avgdl") > 0, F.col("len") / F.col("avgdl")).otherwise(F.lit(1.0))
    part = F.col("qf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * ratio))
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 4).alias("bm25"))


def top(scored: DataFrame, score: str, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col(score).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_max(value: str, by: str = "query_id") -> Column:
    """Value scaled to 0..1 within the query; 0 if all are alike."""
    w = W.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < 1e-9, F.lit(0.0)).otherwise((F.col(value) - low) / (high - low))


def fuse(scored: DataFrame, dense_weight: float = DENSE_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """Adds fused: weighted min-max scores of dense and bm25 (null bm25: 0) and bonus if there."""
    rows = scored.withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    bonus = F.col("bonus") if "bonus" in scored.columns else F.lit(0.0)
    return rows.withColumn("fused", F.round(dense_weight * min_max("dense") + lexical_weight * min_max("bm25") + bonus, 6))


def wants_figure(question: Column) -> Column:
    return question.rlike(_MONEY)


def wants_regulation(question: Column) -> Column:
    return question.rlike(_REGULATORY)


def topic_overlap(question_tokens: Column, topic_tokens: Column) -> Column:
    """Share of the question's distinct tokens among the topics."""
    q = F.array_distinct(question_tokens)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, topic_tokens)) / F.size(q)).otherwise(F.lit(0.0))


def rerank_bonus(question: Column, text: Column, source_kind: Column, clause_number: Column, overlap: Column) -> Column:
    corpus = source_kind != "user_document"
    part = lambda cond, name: F.when(cond, F.lit(BONUS[name])).otherwise(F.lit(0.0))
    asked_rules = F.when(corpus, BONUS["corpus_asked_rules"]).otherwise(BONUS["document_asked_rules"])
    return (
        F.when(wants_regulation(question), asked_rules).otherwise(part(~corpus, "document"))
        + part(text.rlike(_CROSS_REFERENCE), "cross_reference")
        + part(F.length(text) > OVERSIZED, "oversized")
        + part(wants_figure(question) & text.rlike(_HAS_FIGURE), "figure")
        + part(F.coalesce(clause_number, F.lit("")) != "", "numbered")
        + F.when(corpus, overlap * BONUS["topic"]).otherwise(F.lit(0.0))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def drop_near_duplicates(ranked: DataFrame, limit: int, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Greedy suppression: in rank order a passage (query_id, rank, chunk_id, text) stays
    unless it is as near as threshold to one that stayed, until limit have stayed. A
    query's candidates are at most its top k, so the fold works on a bounded array."""
    packed = ranked.select("query_id", F.struct("rank", "chunk_id", F.array_distinct(X.tokens(F.col("text"))).alias("t")).alias("p"))
    lists = packed.groupBy("query_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    kind = "array<struct<rank:int,chunk_id:bigint,t:array<string>>>"

    def step(kept: Column, p: Column) -> Column:
        near = F.exists(kept, lambda k: jaccard(k["t"], p["t"]) >= threshold)
        return F.when((F.size(kept) >= limit) | near, kept).otherwise(F.concat(kept, F.array(p)))

    folded = lists.select("query_id", F.aggregate(F.col("ps").cast(kind), F.array().cast(kind), step).alias("kept"))
    return folded.select("query_id", F.posexplode("kept").alias("_i", "p")).select("query_id", (F.col("_i") + 1).alias("place"), F.col("p.chunk_id").alias("chunk_id"))


def reserved_merge(scored: DataFrame, top_n: int, reserved: int = RESERVED) -> DataFrame:
    """query_id, chunk_id, source_kind, fused, rank: the best `reserved` passages of the
    user's document are sure of a place; the rest compete by score."""
    best = W.partitionBy("query_id", "source_kind").orderBy(F.col("fused").desc(), "chunk_id")
    own = scored.withColumn("_sure", (F.col("source_kind") == "user_document") & (F.row_number().over(best) <= reserved))
    places = W.partitionBy("query_id").orderBy(F.col("_sure").desc(), F.col("fused").desc(), "chunk_id")
    kept = own.withColumn("_place", F.row_number().over(places)).where(F.col("_place") <= top_n)
    final = W.partitionBy("query_id").orderBy(F.col("fused").desc(), "chunk_id")
    return kept.withColumn("rank", F.row_number().over(final)).select("query_id", "chunk_id", "source_kind", "fused", "rank")


def gate(queries: DataFrame, passages: DataFrame, threshold: float = 0.72) -> DataFrame:
    """query_id, outcome, confidence. passages: (query_id, dense, source_kind), those
    returned; queries without any stay."""
    per = passages.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.coalesce("dense", F.lit(0.0))).alias("_c"), F.bool_or(F.col("source_kind") == "user_document").alias("_own")
    )
    rows = queries.select("query_id").join(per, "query_id", "left")
    c = F.coalesce("_c", F.lit(0.0))
    outcome = F.when(F.coalesce("_n", F.lit(0)) == 0, "nothing_retrieved").when(c < threshold, "insufficient_evidence").when(~F.col("_own"), "insufficient_evidence").otherwise("answer")
    return rows.select("query_id", outcome.alias("outcome"), c.alias("confidence"))
