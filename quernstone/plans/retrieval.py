"""Queries of retrieval: tokens, BM25, cosine, fusion, rerank, near-duplicates, merge, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieve as R
from ..scratch import materialize
from . import base as P

TOP_K, TOP_N = 32, 8


def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = P.table(spark, sf, "documents").select("lang", F.explode(X.tokens(F.col("text"))).alias("token"))
    return t.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    scored = R.bm25_corpus(P.questions(spark, sf), P.chunks(spark, sf).select("chunk_id", "text"))
    return R.top(scored, "bm25", TOP_N).select("query_id", "chunk_id", "bm25", F.col("rank").cast("bigint").alias("rank"))


BM25_SQL = f"""
d AS (SELECT doc_id AS chunk_id, {P.tokens_sql('text')} AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({P.tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT chunk_id, ln, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS ln, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, chunk_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * ln / avgdl))), 4) AS bm25
       FROM tf JOIN df USING (term) JOIN qt USING (term), n GROUP BY ALL)"""


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    out = R.dense_topk(P.vector_queries(spark, sf), P.vectors(spark, sf), TOP_N)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def _cosine_sql(k: int) -> str:
    return f"""
dn AS (SELECT q.vec_id AS query_id, s.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[]), 4) AS dense
       FROM embeddings q, embeddings s WHERE q.vec_id % 20 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS rank FROM dn QUALIFY rank <= {k})"""


def _vector_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of the vector queries: the text of the document of the same number."""
    ids = P.vector_queries(spark, sf).select("query_id")
    return ids.join(P.chunks(spark, sf), ids["query_id"] == F.col("chunk_id")).select("query_id", F.col("text").alias("question"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The dense candidates with their texts: top k rows a query, a table that all steps read."""
    dense = R.dense_topk(P.vector_queries(spark, sf), P.vectors(spark, sf), TOP_K)
    return materialize(dense.join(P.chunks(spark, sf), "chunk_id"), "candidates")


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The candidates, and their lexical scores."""
    c = _candidates(spark, sf)
    return c, R.bm25(_vector_questions(spark, sf), c.select("query_id", "chunk_id", "text"))


def bm25_over_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)[1]


CANDIDATES_SQL = _cosine_sql(TOP_K) + f""",
cand AS (SELECT query_id, chunk_id, dense, text, {P.tokens_sql('text')} AS t, CASE WHEN chunk_id % 4 = 0 THEN 'corpus' ELSE 'user_document' END AS source_kind, source AS document_id
         FROM top JOIN documents ON doc_id = chunk_id),
vq AS (SELECT vec_id AS query_id, text AS question FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0),
cn AS (SELECT query_id, count(*) AS n, avg(len(t)) AS avgdl FROM cand GROUP BY query_id),
cqt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({P.tokens_sql('question')}) AS term FROM vq) GROUP BY ALL),
ctf AS (SELECT query_id, chunk_id, ln, term, count(*) AS tf FROM (SELECT query_id, chunk_id, len(t) AS ln, unnest(t) AS term FROM cand) GROUP BY ALL),
cdf AS (SELECT query_id, term, count(*) AS df FROM ctf GROUP BY ALL),
cbm AS (SELECT query_id, chunk_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * CASE WHEN avgdl > 0 THEN ln / avgdl ELSE 1 END))), 4) AS bm25
        FROM ctf JOIN cdf USING (query_id, term) JOIN cqt USING (query_id, term) JOIN cn USING (query_id) GROUP BY ALL)"""


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    c, lexical = _scored(spark, sf)
    return R.fuse(c.join(lexical, ["query_id", "chunk_id"], "left"))


def minmax_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("query_id", "chunk_id", F.round("fused", 4).alias("fused"))


FUSED_SQL = CANDIDATES_SQL + f""",
f0 AS (SELECT cand.*, coalesce(bm25, 0) AS bm25 FROM cand LEFT JOIN cbm USING (query_id, chunk_id)),
f1 AS (SELECT *, max(dense) OVER w AS dh, min(dense) OVER w AS dl, max(bm25) OVER w AS bh, min(bm25) OVER w AS bl FROM f0 WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT *, round({R.DENSE_WEIGHT} * CASE WHEN dh - dl < 1e-9 THEN 0 ELSE (dense - dl) / (dh - dl) END
                       + {R.LEXICAL_WEIGHT} * CASE WHEN bh - bl < 1e-9 THEN 0 ELSE (bm25 - bl) / (bh - bl) END, 6) AS fused FROM f1)"""


#: What every document of the manifest declares as a topic beside its own words.
_DECLARED = "rate charge document"


def rerank_bonus(spark: SparkSession, sf: str) -> DataFrame:
    q, c = P.questions(spark, sf), P.chunks(spark, sf)
    hits = bm25_topk(spark, sf).select("query_id", "chunk_id").join(q, "query_id").join(c, "chunk_id")
    topics = F.array_distinct(X.tokens(F.concat_ws(" ", F.lit(_DECLARED), "text")))
    overlap = R.topic_overlap(X.tokens(F.col("question")), topics)
    bonus = R.rerank_bonus(F.col("question"), F.col("text"), F.col("source_kind"), F.when(F.col("chunk_id") % 3 == 0, "1.1"), overlap)
    return hits.select("query_id", "chunk_id", F.round(bonus, 4).alias("bonus"), F.round(overlap.cast("double"), 4).alias("overlap"))


def topic_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each question's tokens among the topics of each corpus document (a source,
    all its texts): questions' terms meet documents' terms, so no pair without one is made."""
    asked = P.questions(spark, sf).select("query_id", F.array_distinct(X.tokens(F.col("question"))).alias("t")).withColumn("n", F.size("t"))
    corpus = P.chunks(spark, sf).where("source_kind = 'corpus'")
    words = corpus.select("document_id", F.explode(F.array_distinct(X.tokens(F.concat_ws(" ", F.lit(_DECLARED), "text")))).alias("w")).distinct()
    met = asked.select("query_id", "n", F.explode("t").alias("w")).join(words, "w")
    return met.groupBy("query_id", "document_id").agg(F.round(F.count(F.lit(1)) / F.first("n"), 4).alias("overlap"))


def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of each conversation turn to the one after it."""
    c = P.table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(X.tokens(F.coalesce("text", F.lit("")))).alias("t"))
    after = F.lead("t").over(W.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("u", after).where("u IS NOT NULL").select("conv_id", "turn", F.round(R.jaccard(F.col("t"), F.col("u")).cast("double"), 4).alias("jaccard"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("fused").desc(), "chunk_id")
    return _fused(spark, sf).withColumn("rank", F.row_number().over(order))


def near_dup_greedy(spark: SparkSession, sf: str) -> DataFrame:
    kept = R.drop_near_duplicates(_ranked(spark, sf), TOP_N)
    return kept.select("query_id", F.col("place").cast("bigint").alias("place"), "chunk_id")


NEAR_SQL = FUSED_SQL + f""",
rk AS (SELECT *, list_distinct(t) AS ts, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS r FROM fused),
walk AS (SELECT query_id, 1::BIGINT AS r, [chunk_id] AS ids, [ts] AS sets FROM rk WHERE r = 1
  UNION ALL
  SELECT w.query_id, w.r + 1,
    CASE WHEN drop_ THEN ids ELSE list_append(ids, chunk_id) END, CASE WHEN drop_ THEN sets ELSE list_append(sets, ts) END
  FROM (SELECT w.*, rk.chunk_id, rk.ts, len(w.ids) >= {TOP_N} OR coalesce(list_bool_or(list_transform(w.sets, lambda s:
          len(s) > 0 AND len(rk.ts) > 0 AND len(list_intersect(s, rk.ts))::DOUBLE / (len(s) + len(rk.ts) - len(list_intersect(s, rk.ts))) >= {R.NEAR_DUPLICATE})), false) AS drop_
        FROM walk w JOIN rk ON rk.query_id = w.query_id AND rk.r = w.r + 1) w),
kept AS (SELECT query_id, arg_max(ids, r) AS ids FROM walk GROUP BY query_id)"""


def reserved_floor_merge(spark: SparkSession, sf: str) -> DataFrame:
    out = R.reserved_merge(_fused(spark, sf), TOP_N)
    return out.select("query_id", "chunk_id", "source_kind", F.round("fused", 4).alias("fused"), F.col("rank").cast("bigint").alias("rank"))


MERGE_SQL = FUSED_SQL + f""",
m1 AS (SELECT *, source_kind = 'user_document' AND row_number() OVER (PARTITION BY query_id, source_kind ORDER BY fused DESC, chunk_id) <= {R.RESERVED} AS sure FROM fused),
m2 AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sure DESC, fused DESC, chunk_id) <= {TOP_N}),
merged AS (SELECT query_id, chunk_id, source_kind, dense, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM m2)"""


def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    fused = materialize(_fused(spark, sf).select("query_id", "chunk_id", "source_kind", "dense", "fused"), "fused")
    passages = R.reserved_merge(fused, TOP_N).join(fused.select("query_id", "chunk_id", "dense"), ["query_id", "chunk_id"])
    everyone = P.vectors(spark, sf).select(F.col("chunk_id").alias("query_id"))
    return R.gate(everyone, passages)


def hybrid_answer(spark: SparkSession, sf: str) -> DataFrame:
    """The whole answer path: candidates, fusion, near-duplicates, reserved places."""
    ranked = materialize(_ranked(spark, sf).select("query_id", "chunk_id", "rank", "text", "source_kind", "fused"), "ranked")
    kept = R.drop_near_duplicates(ranked, TOP_N).select("query_id", "chunk_id")
    merged = R.reserved_merge(ranked.join(kept, ["query_id", "chunk_id"]), TOP_N)
    return merged.select("query_id", "chunk_id", "source_kind", F.round("fused", 4).alias("fused"), F.col("rank").cast("bigint").alias("rank"))


def eval_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each question's neighbours that have its label (the gold), and reciprocal rank."""
    gold = P.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    hits = cosine_topk(spark, sf).where("chunk_id <> query_id").join(gold, "chunk_id")
    own = gold.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("want"))
    right = F.col("label") == F.col("want")
    per = hits.join(own, "query_id").groupBy("query_id").agg(F.count_if(right).alias("found"), F.count(F.lit(1)).alias("shown"), F.min(F.when(right, F.col("rank"))).alias("first_rank"))
    return per.select("query_id", "found", "shown", F.coalesce("first_rank", F.lit(0)).cast("bigint").alias("first_rank"), F.round(F.col("found") / F.col("shown"), 4).alias("recall"))


QUERIES = {f.__name__: f for f in (tokenize_counts, bm25_topk, cosine_topk, bm25_over_candidates, minmax_fusion, rerank_bonus, topic_overlap, jaccard_pairs, near_dup_greedy, reserved_floor_merge, evidence_gate, hybrid_answer, eval_recall)}

_BM25_TOP = f"bt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM bm QUALIFY rank <= {TOP_N})"

SQL = {
    "tokenize_counts": f"SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({P.tokens_sql('text')}) AS token FROM documents) GROUP BY ALL",
    "bm25_topk": f"WITH {BM25_SQL}, {_BM25_TOP} SELECT query_id, chunk_id, bm25, rank FROM bt",
    "cosine_topk": f"WITH {_cosine_sql(TOP_N)} SELECT query_id, chunk_id, dense, rank FROM top",
    "bm25_over_candidates": f"WITH {CANDIDATES_SQL} SELECT * FROM cbm",
    "minmax_fusion": f"WITH {FUSED_SQL} SELECT query_id, chunk_id, round(fused, 4) AS fused FROM fused",
    "rerank_bonus": rf"""WITH {BM25_SQL}, {_BM25_TOP},
h AS (SELECT bt.query_id, bt.chunk_id, b.text AS question, d.text, bt.chunk_id % 4 = 0 AS corpus, {P.tokens_sql('b.text')} AS qt,
      list_distinct({P.tokens_sql("'rate charge document ' || d.text")}) AS tt
      FROM bt JOIN benchmark b ON b.item_id = bt.query_id JOIN documents d ON d.doc_id = bt.chunk_id),
o AS (SELECT *, CASE WHEN len(qt) > 0 THEN len(list_intersect(list_distinct(qt), tt))::DOUBLE / len(list_distinct(qt)) ELSE 0 END AS ov FROM h)
SELECT query_id, chunk_id, round(
  CASE WHEN regexp_matches(question, '(?i)\b(allowed|permitted|permissible|legal|lawful|is it legal|rbi|reserve bank|regulations?|rules?|compliant|complies|comply|entitled to charge|are they allowed|supposed to)\b')
    THEN CASE WHEN corpus THEN 0.10 ELSE 0.03 END ELSE CASE WHEN corpus THEN 0.0 ELSE 0.06 END END::DOUBLE
  + CASE WHEN regexp_matches(text, '(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*\s+)?(?:refer|please refer|see|as (?:set out|specified|provided))\b') THEN -0.08 ELSE 0 END::DOUBLE
  + CASE WHEN length(text) > 1200 THEN -0.05 ELSE 0 END::DOUBLE
  + CASE WHEN regexp_matches(question, '(?i)\b(charge|charges|fee|fees|cost|costs|rate|penalty|penal|percent|%|rs|rupees|how much|amount|emi|premium|lock-?in|period|months?|years?)\b')
      AND regexp_matches(text, '(?i)(?:[0-9]+(?:\.[0-9]+)?\s*%|rs\.?\s*[0-9,]+|[0-9]+\s*(?:months?|days?|years?))') THEN 0.05 ELSE 0 END::DOUBLE
  + CASE WHEN chunk_id % 3 = 0 THEN 0.02 ELSE 0 END::DOUBLE + CASE WHEN corpus THEN ov * 0.12 ELSE 0 END, 4) AS bonus, round(ov, 4) AS overlap FROM o""",
    "topic_overlap": f"""WITH t AS (SELECT DISTINCT document_id, w FROM (SELECT source AS document_id, unnest({P.tokens_sql("'rate charge document ' || text")}) AS w FROM documents WHERE doc_id % 4 = 0)),
q AS (SELECT item_id AS query_id, list_distinct({P.tokens_sql('text')}) AS qt FROM benchmark)
SELECT query_id, document_id, round(count(*)::DOUBLE / first(len(qt)), 4)::DOUBLE AS overlap FROM (SELECT query_id, qt, unnest(qt) AS w FROM q) JOIN t USING (w) GROUP BY ALL""",
    "jaccard_pairs": f"""WITH c AS (SELECT conv_id, turn, list_distinct({P.tokens_sql("coalesce(text, '')")}) AS t FROM conversations),
n AS (SELECT *, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM c)
SELECT conv_id, turn, round(CASE WHEN len(t) = 0 OR len(u) = 0 THEN 0 ELSE len(list_intersect(t, u))::DOUBLE / (len(t) + len(u) - len(list_intersect(t, u))) END, 4)::DOUBLE AS jaccard FROM n WHERE u IS NOT NULL""",
    "near_dup_greedy": f"WITH RECURSIVE {NEAR_SQL} SELECT query_id, unnest(range(1, len(ids) + 1)) AS place, unnest(ids) AS chunk_id FROM kept",
    "reserved_floor_merge": f"WITH {MERGE_SQL} SELECT query_id, chunk_id, source_kind, round(fused, 4) AS fused, rank FROM merged",
    "evidence_gate": f"""WITH {MERGE_SQL}, g AS (SELECT query_id, max(coalesce(dense, 0)) AS c, bool_or(source_kind = 'user_document') AS own FROM merged GROUP BY query_id)
SELECT e.vec_id AS query_id, CASE WHEN c IS NULL THEN 'nothing_retrieved' WHEN c < 0.72 THEN 'insufficient_evidence' WHEN NOT own THEN 'insufficient_evidence' ELSE 'answer' END AS outcome,
  coalesce(c, 0)::DOUBLE AS confidence FROM embeddings e LEFT JOIN g ON g.query_id = e.vec_id""",
    "hybrid_answer": f"""WITH RECURSIVE {NEAR_SQL}, ks AS (SELECT query_id, unnest(ids) AS chunk_id FROM kept), fk AS (SELECT fused.* FROM fused JOIN ks USING (query_id, chunk_id)),
h1 AS (SELECT *, source_kind = 'user_document' AND row_number() OVER (PARTITION BY query_id, source_kind ORDER BY fused DESC, chunk_id) <= {R.RESERVED} AS sure FROM fk),
h2 AS (SELECT * FROM h1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sure DESC, fused DESC, chunk_id) <= {TOP_N})
SELECT query_id, chunk_id, source_kind, round(fused, 4) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM h2""",
    "eval_recall": f"""WITH {_cosine_sql(TOP_N)}, p AS (SELECT top.query_id, count(*) FILTER (e.label = w.label) AS found, count(*) AS shown, coalesce(min(rank) FILTER (e.label = w.label), 0) AS first_rank
FROM top JOIN embeddings e ON e.vec_id = top.chunk_id JOIN embeddings w ON w.vec_id = top.query_id WHERE top.chunk_id <> top.query_id GROUP BY top.query_id)
SELECT *, round(found / shown, 4) AS recall FROM p""",
}
