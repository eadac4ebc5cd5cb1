"""Queries of answers: sentences, claims, verification, glossary, events, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answer as N
from ..operators import embed as E
from ..scratch import materialize
from ..sources import parse as G
from . import base as P
from . import retrieval as R


def hashing_embedding_norms(spark: SparkSession, sf: str) -> DataFrame:
    """With sha256 as the digest, which SQL has too; vectors are made with another one."""
    t = E.hashed_terms(P.chunks(spark, sf).select("chunk_id", "text"), "chunk_id", family="sha256").where(F.size("terms") > 0)
    square = F.aggregate("terms", F.lit(0.0), lambda a, x: a + x["value"] * x["value"])
    return t.select("chunk_id", F.size("terms").cast("bigint").alias("buckets"), F.round(F.sqrt(square), 4).alias("norm"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical top passages of each question with both texts."""
    hits = materialize(R.bm25_topk(spark, sf), "hits")
    return hits.join(P.questions(spark, sf), "query_id").join(P.chunks(spark, sf), "chunk_id")


def best_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return N.best_sentence(_hits(spark, sf), ["query_id", "chunk_id"])


def _turns(spark: SparkSession, sf: str, role: str) -> DataFrame:
    c = P.table(spark, sf, "conversations").where((F.col("role") == role) & F.col("text").isNotNull())
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", "text")


def claim_filter(spark: SparkSession, sf: str) -> DataFrame:
    out = N.filter_claims(_turns(spark, sf, "assistant"), "answer_id")
    return out.select("answer_id", F.col("seq").cast("bigint").alias("seq"), "sentence", "label")


def _cited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Assistant turns with a marker after each sentence, and the turns before as sources."""
    a = _turns(spark, sf, "assistant")
    marked = F.regexp_replace("text", r"([.!?])(\s+[A-Z]|$)", " [1][2]$1$2")
    answers = a.select("answer_id", F.lit("").alias("question"), marked.alias("text"))
    c = P.table(spark, sf, "conversations").where("text IS NOT NULL")
    w = W.partitionBy("conv_id").orderBy("turn")
    both = c.select("conv_id", "turn", "role", F.lag("text", 1).over(w).alias("p1"), F.lag("text", 2).over(w).alias("p2")).where("role = 'assistant'")
    each = both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.posexplode(F.array("p1", "p2")).alias("i", "text"))
    return answers, each.where("text IS NOT NULL").select("answer_id", (F.col("i") + 1).alias("n"), "text")


def verify_sentences(spark: SparkSession, sf: str) -> DataFrame:
    out = N.verify(*_cited(spark, sf))
    return out.select("answer_id", F.col("seq").cast("bigint").alias("seq"), "kept", "reason", F.round("support", 4).alias("support"))


def verified_answers(spark: SparkSession, sf: str) -> DataFrame:
    out = N.verified_answers(N.verify(*_cited(spark, sf), blanks=True))
    return out.select("answer_id", "stripped", "fully_grounded", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of each question with passages: rules, summary, numbered passages."""
    rows = _hits(spark, sf)
    label = N.source_label(F.lit(None).cast("string"), F.col("rank"), F.when(F.col("source_kind") == "corpus", F.col("document_id")))
    summary = P.questions(spark, sf).where("query_id % 2 = 0").select("query_id", F.lit("a loan").alias("summary"))
    out = N.prompt(rows.select("query_id", F.col("rank").alias("n"), label.alias("label"), "text"), summary, "Rules.")
    return out.select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def goldset_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Questions as cases: the sources of every third one's hits are wanted, a word is
    forbidden in every fifth, every seventh wants a refusal."""
    rows = _hits(spark, sf)
    q = F.col("query_id")
    cases = P.questions(spark, sf).select(
        q.alias("id"), F.when(q % 2 == 0, F.array(F.concat(F.lit("2."), (q % 9).cast("string")), F.lit("2.1"))).alias("expect_clauses"), F.when(q % 3 == 0, F.array(F.concat(F.lit("src"), (q % 20).cast("string")))).alias("expect_corpus"),
        F.when(q % 6 == 0, 3).alias("require_corpus_rank"), (q % 7 == 0).alias("expect_insufficient"), F.when(q % 5 == 0, F.array(F.lit("THE the"), F.lit("Zug"))).alias("must_not_contain"),
    )
    corpus = F.col("source_kind") == "corpus"
    passages = rows.select("query_id", "rank", F.when(~corpus, F.concat(F.lit("2."), (F.col("chunk_id") % 9).cast("string"))).alias("clause_number"), F.when(corpus, F.col("document_id")).alias("corpus_id"), "text")
    outcomes = passages.groupBy("query_id").agg((F.count(F.lit(1)) / 10).alias("confidence"))
    out = G.score_goldset(cases, passages, outcomes)
    return out.select("id", F.round("clause_recall", 4).alias("clause_recall"), "corpus_ok", "rank_ok", "refusal_ok", "forbidden", "passed")


def _glossary_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about the terms whose numbers divide the order's key."""
    ask = F.array(*(F.when(F.col("o_orderkey") % (k + 2) == 0, F.lit(t)) for k, (t, _) in enumerate(N.GLOSSARY)))
    return P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("What is "), F.array_join(ask, " and ")).alias("question"))


def glossary_top3(spark: SparkSession, sf: str) -> DataFrame:
    return N.glossary(_glossary_questions(spark, sf))


def fallback_answers(spark: SparkSession, sf: str) -> DataFrame:
    return N.fallback(_glossary_questions(spark, sf))


def extracted_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _hits(spark, sf)
    label = N.source_label(F.lit(None).cast("string"), F.col("rank"), F.when(F.col("source_kind") == "corpus", F.col("document_id")))
    out = N.extract_answer(rows.select("query_id", F.col("rank").alias("n"), label.alias("label"), "question", "text"))
    return out.select("query_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


def event_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The event rows of every question, gated on its best lexical score."""
    best = R.bm25_topk(spark, sf).groupBy("query_id").agg((F.max("bm25") / 40).alias("c"), F.count(F.lit(1)).alias("n"))
    q = P.questions(spark, sf)
    gated = q.join(best, "query_id", "left").select("query_id", F.when(F.col("c").isNull(), "nothing_retrieved").when(F.col("c") < 0.72, "insufficient_evidence").otherwise("answer").alias("outcome"), F.coalesce("c", F.lit(0.0)).alias("confidence"), F.coalesce("n", F.lit(0)).alias("n"))
    as_payload = lambda d, c: d.select("query_id", c.cast("string").alias("payload"))
    answers = gated.select("query_id", F.concat(F.lit("answer "), F.col("query_id").cast("string")).alias("payload"), F.lit("verified").alias("verified"))
    out = N.events(gated.select("query_id", "outcome", "confidence"), as_payload(gated.where("query_id % 2 = 0"), F.lit("gap")), as_payload(gated, F.col("n")), answers, as_payload(q, F.lit(N.NOTICE)))
    return out.select("query_id", F.col("seq").cast("bigint").alias("seq"), "event", F.when(~F.col("event").isin("meta", "done"), F.col("payload")).alias("payload"))


QUERIES = {f.__name__: f for f in (hashing_embedding_norms, best_sentence, claim_filter, verify_sentences, verified_answers, prompts, goldset_scores, glossary_top3, fallback_answers, extracted_answers, event_sequence)}

# fixed values, stated here apart from the operators
_EMBEDDING_STOP = P._WORDS(
    "a an and or of to in on for by with the this that shall be is are as at from any such other under which it its their his her been being will may must not no"
    " borrower lender agreement clause loan"
)
_EXTRACT_STOP = P._WORDS(
    "a an the and or of to in on for by with is are be as at from this that i my me what how do does can will shall if it its their there any would could"
)
_CLAIMS = (
    ("regulatory claim", r"(?i)\b(rbi|reserve bank|circular|direction|regulat\w*|regulator|law|legal|illegal|lawful|statut\w*|ombudsman rules?|guidelines?|mandat\w*|compliance|compliant)\b"),
    ("claim about the borrower's document", r"(?i)\b(your (agreement|contract|loan|lender|bank|kfs|key facts|document|emi|rate|clause|schedule|tenure|policy)|this (agreement|contract|loan|clause|document)|the agreement|the clause|clause [0-9]|schedule [ivx0-9]|in your case)\b"),
    ("statement of obligation or permission", r"(?i)\b(must|shall|required|requires?|not allowed|allowed to|permitted|prohibit\w*|forbid\w*|entitled|cannot legally|is not legal|are obliged|obligated|have the right)\b"),
    ("specific figure", "[0-9]"),
)
_MEANINGS = (
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
_ETOK = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)*'), lambda x: NOT list_contains({_EMBEDDING_STOP}, x))"
_XTOK = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+(?:\\.[0-9]+)*%?'), lambda x: length(x) > 2 AND NOT list_contains({_EXTRACT_STOP}, x)))"
_BM = f"WITH {R.BM25_SQL}, {R._BM25_TOP}"
_BEST = rf"""s0 AS (SELECT bt.query_id, bt.chunk_id, bt.rank, {_XTOK('b.text')} AS q, list_filter(list_transform(string_split(regexp_replace(replace(d.text, chr(10), ' '), '([.;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: {P.strip_sql('p')}), lambda p: p <> '') AS ps
  FROM bt JOIN benchmark b ON b.item_id = bt.query_id JOIN documents d ON d.doc_id = bt.chunk_id),
s1 AS (SELECT query_id, chunk_id, rank, q, unnest(range(0, len(ps))) AS i, unnest(ps) AS s FROM s0),
s2 AS (SELECT *, (len(list_intersect({_XTOK('s')}, q)) + CASE WHEN regexp_matches(s, '[0-9]') THEN 0.5 ELSE 0 END - CASE WHEN length(s) < 40 THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM s1),
s3 AS (SELECT query_id, chunk_id, rank, arg_max(s, (score, -i)) AS b, max(score) AS m, arg_min(s, i) AS f FROM s2 GROUP BY ALL),
best AS (SELECT query_id, chunk_id, rank, substr(CASE WHEN m > 0 THEN b ELSE f END, 1, 400) AS sentence, greatest(m, 0)::DOUBLE AS score FROM s3)"""
_q = lambda x: "'" + x.replace("'", "''") + "'"
_CLAIM = "CASE " + " ".join(f"WHEN regexp_matches(sentence, {_q(p)}) THEN {_q(n)}" for n, p in _CLAIMS) + " END"
_GLOSS = "(" + "list_filter([" + ", ".join(f"CASE WHEN contains(lower(question), '{t}') THEN {_q(s)} END" for t, s in _MEANINGS) + "], lambda x: x IS NOT NULL))"
_ASKED = "asked AS (SELECT o_orderkey AS query_id, 'What is ' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN o_orderkey % {k + 2} = 0 THEN '{t}' END" for k, (t, _) in enumerate(_MEANINGS)) + "], lambda x: x IS NOT NULL), ' and ') AS question FROM orders)"

_BODY = P.strip_sql(r"regexp_replace(sentence, '\[[0-9]+\]', '', 'g')")
_VERIFIED = rf"""a AS (SELECT conv_id * 1000 + turn AS answer_id, regexp_replace(text, '([.!?])(\s+[A-Z]|$)', ' [1][2]\1\2', 'g') AS x FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
l AS (SELECT answer_id, flatten(list_transform(list_transform(string_split(x, chr(10)), lambda s: {P.strip_sql('s')}), lambda s: CASE WHEN regexp_matches(s, '^[-*•] ') THEN [s]
  ELSE string_split(regexp_replace(regexp_replace(s, '(?i)\b(Rs|No|Nos|Mr|Mrs|Ms|Dr|Smt|Shri|Cl|Para|viz|approx|p\.a|i\.e|e\.g|vs|etc|Ltd|Pvt)\.', '\1' || chr(57344), 'g'), '([.!?]){P.SPACE_SQL}+([A-Z\[("''])', '\1' || chr(1) || '\2', 'g'), chr(1)) END)) AS ss FROM a),
s0 AS (SELECT answer_id, unnest(range(0, len(ss))) AS seq, {P.strip_sql("replace(unnest(ss), chr(57344), '.')")} AS sentence FROM l),
s1 AS (SELECT *, {_BODY} AS body FROM s0),
s AS (SELECT answer_id, seq, sentence, body, {P.terms_sql('body')} AS t, {P.figures_sql('body')} AS f, list_distinct(list_transform(regexp_extract_all(sentence, '\[([0-9]+)\]', 1), lambda y: try_cast(y AS INT))) AS m FROM s1),
pc AS (SELECT conv_id, turn, role, lag(text, 1) OVER w AS p1, lag(text, 2) OVER w AS p2 FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p0 AS (SELECT conv_id * 1000 + turn AS answer_id, unnest([1, 2]) AS n, unnest([p1, p2]) AS text FROM pc WHERE role = 'assistant'),
p AS (SELECT answer_id, n, {P.terms_sql('text')} AS pt, {P.figures_sql('text')} AS pf FROM p0 WHERE text IS NOT NULL),
c0 AS (SELECT answer_id, seq, t, f, unnest(m) AS n FROM s),
c1 AS (SELECT answer_id, seq, f, pf, len(list_intersect(t, pt)) AS common, CASE WHEN len(t) > 0 THEN len(list_intersect(t, pt))::DOUBLE / len(t) ELSE 0 END AS share FROM c0 JOIN p USING (answer_id, n)),
c2 AS (SELECT *, CASE WHEN len(f) > 0 AND len(list_filter(f, lambda y: NOT list_contains(pf, y))) = 0 AND common >= 2 THEN greatest(share, 0.33::DOUBLE) ELSE share END AS support FROM c1),
per AS (SELECT answer_id, seq, max(support) AS support, bool_or(support >= 0.28) AS good, coalesce(flatten(list(pf) FILTER (support >= 0.28)), []) AS said FROM c2 GROUP BY ALL),
v0 AS (SELECT s.*, coalesce(support, 0) AS sup, coalesce(good, false) AS good, list_sort(list_filter(f, lambda y: NOT list_contains(coalesce(said, []), y))) AS wild,
  regexp_matches(body, '(?i)^\s*(?:based on|here is|here are|in summary|to summarise|in short|each point|open the citations|the clauses? (?:retrieved|below)|this means|note that)\b') OR len(t) < 3 AS free
  FROM s LEFT JOIN per USING (answer_id, seq)),
v AS (SELECT *, CASE WHEN sentence = '' THEN '' WHEN free THEN 'no factual claim' WHEN len(m) = 0 THEN 'no citation' WHEN good AND len(wild) > 0 THEN 'states a figure its source does not contain: ' || array_to_string(wild, ', ')
  WHEN NOT good AND sup > 0 THEN 'cited passage does not support the claim' WHEN NOT good THEN 'citation points at nothing' ELSE '' END AS reason FROM v0)"""
_KEPT = "reason IN ('', 'no factual claim')"
_LABEL = "CASE WHEN chunk_id % 4 = 0 THEN 'RBI ' || source ELSE 'Your agreement' END || ', page ' || rank"

SQL = {
    "verify_sentences": f"WITH {_VERIFIED} SELECT answer_id, seq, {_KEPT} AS kept, reason, round(CASE WHEN free THEN 1 ELSE sup END, 4)::DOUBLE AS support FROM v WHERE sentence <> ''",
    "verified_answers": f"""WITH {_VERIFIED}, o AS (SELECT answer_id, count(*) FILTER (NOT {_KEPT}) AS stripped, string_agg(sentence, chr(10) ORDER BY seq) FILTER ({_KEPT}) AS x FROM v GROUP BY 1)
SELECT answer_id, stripped, stripped = 0 AS fully_grounded, md5(regexp_replace({P.strip_sql("coalesce(x, '')")}, '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text_md5 FROM o""",
    "prompts": f"""{_BM}, p AS (SELECT query_id, string_agg('[' || rank || '] ' || {_LABEL} || chr(10) || {P.strip_sql('text')}, chr(10) || chr(10) ORDER BY rank) AS x FROM bt JOIN documents ON doc_id = chunk_id GROUP BY 1)
SELECT query_id, md5('Rules.' || repeat(chr(10), 2) || CASE WHEN query_id % 2 = 0 THEN 'The document being discussed:' || chr(10) || 'a loan' || repeat(chr(10), 2) ELSE '' END || 'Passages:' || repeat(chr(10), 2) || x) AS prompt_md5 FROM p""",
    "goldset_scores": f"""{_BM}, p AS (SELECT query_id, list(DISTINCT '2.' || (chunk_id % 9)) FILTER (chunk_id % 4 <> 0) AS cl, coalesce(list(DISTINCT source) FILTER (chunk_id % 4 = 0), []) AS co,
  coalesce(list(DISTINCT source) FILTER (chunk_id % 4 = 0 AND rank <= 3), []) AS co3, bool_or(contains(lower(text), 'the the') OR contains(lower(text), 'zug')) AS bad, count(*) / 10 AS conf FROM bt JOIN documents ON doc_id = chunk_id GROUP BY 1),
c AS (SELECT item_id AS id, p.*, CASE WHEN item_id % 2 = 0 THEN list_distinct(['2.' || (item_id % 9), '2.1']) ELSE [] END AS ec, CASE WHEN item_id % 3 = 0 THEN ['src' || (item_id % 20)] ELSE [] END AS er FROM benchmark LEFT JOIN p ON query_id = item_id),
s AS (SELECT id, round(CASE WHEN len(ec) > 0 THEN len(list_intersect(ec, coalesce(cl, [])))::DOUBLE / len(ec) ELSE 1 END, 4)::DOUBLE AS clause_recall, list_has_all(coalesce(co, []), er) AS corpus_ok,
  id % 6 <> 0 OR conf IS NULL OR list_has_any(er, co3) AS rank_ok, id % 7 <> 0 OR coalesce(conf, 0) < 0.72 AS refusal_ok, id % 5 = 0 AND coalesce(bad, false) AS forbidden FROM c)
SELECT *, clause_recall >= 1 AND corpus_ok AND rank_ok AND refusal_ok AND NOT forbidden AS passed FROM s""",
    "hashing_embedding_norms": f"""WITH t AS (SELECT doc_id AS chunk_id, sha256(unnest({_ETOK})) AS h FROM documents),
b AS (SELECT chunk_id, ('0x' || substr(h, 1, 8))::BIGINT % 512 AS bucket, sum(CASE WHEN ('0x' || substr(h, 10, 1))::INT % 2 = 1 THEN 1 ELSE -1 END) AS v FROM t GROUP BY ALL),
n AS (SELECT chunk_id, sign(v) * ln(1 + abs(v)) AS x FROM b WHERE v <> 0) SELECT chunk_id, count(*) AS buckets, round(sqrt(sum(x * x)), 4) AS norm FROM n GROUP BY 1""",
    "best_sentence": f"{_BM}, {_BEST} SELECT query_id, chunk_id, sentence, score FROM best",
    "claim_filter": rf"""WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: {P.strip_sql('l')} <> ''),
  lambda l: regexp_replace(l, '^[ *•-]+|[ *•-]+\z', '', 'g')), ' ') AS x FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
s AS (SELECT answer_id, list_filter(list_transform(string_split(regexp_replace(x, '([.!?]){P.SPACE_SQL}+', '\1' || chr(1), 'g'), chr(1)), lambda p: {P.strip_sql('p')}), lambda p: length(p) > 0) AS ps FROM a),
e AS (SELECT answer_id, unnest(range(0, len(ps))) AS seq, unnest(ps) AS sentence FROM s) SELECT answer_id, seq, sentence, {_CLAIM} AS label FROM e""",
    "glossary_top3": f"WITH {_ASKED}, g AS (SELECT query_id, {_GLOSS} AS g FROM asked) SELECT query_id, CASE WHEN len(g) > 0 THEN array_to_string(g[1:3], ' ') ELSE {_q(N.NO_TERM)} END AS explanation FROM g",
    "fallback_answers": f"""WITH {_ASKED}, g AS (SELECT query_id, {_GLOSS} AS g FROM asked), e AS (SELECT query_id, string_split(regexp_replace(CASE WHEN len(g) > 0 THEN array_to_string(g[1:3], ' ') ELSE {_q(N.NO_TERM)} END, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM g),
k AS (SELECT query_id, list_filter(ps, lambda sentence: ({_CLAIM}) IS NULL) AS ks FROM e)
SELECT query_id, {_q(N.NOTICE)} AS notice, CASE WHEN len(ks) > 0 THEN array_to_string(ks, ' ') ELSE {_q(N.NO_TERM)} END AS explanation,
  'For a specific answer about your loan, speak to a qualified financial adviser or to your lender''s grievance officer, and take your agreement and Key Facts Statement with you.' AS advisor FROM k""",
    "extracted_answers": rf"""{_BM}, {_BEST}, u AS (SELECT *, sentence <> '' AND NOT regexp_matches(sentence, '(?i)^\s*(?:refer|see|as set out|as specified)\b') AS ok FROM best),
r AS (SELECT u.*, CASE WHEN ok THEN score END AS sc, max(CASE WHEN ok THEN score END) OVER (PARTITION BY query_id) AS top,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ok THEN score END DESC NULLS LAST, rank) AS place, {_LABEL} AS label FROM u JOIN documents ON doc_id = chunk_id),
k AS (SELECT query_id, string_agg('- ' || label || ': ' || sentence || ' [' || rank || ']', chr(10) ORDER BY place) FILTER (ok AND top > 0 AND sc >= top * 0.5 AND place <= 4) AS a FROM r GROUP BY 1)
SELECT query_id, md5(CASE WHEN a IS NULL THEN 'I could not find anything in your document that answers that.' ELSE 'Based on the clauses retrieved from your documents:' || repeat(chr(10), 2) || a || repeat(chr(10), 2)
  || 'Each point above is quoted from the source shown in brackets. Open the citations panel to read the clause in full.' END) AS answer_md5 FROM k""",
    "event_sequence": f"""{_BM}, c AS (SELECT query_id, max(bm25) / 40 AS c, count(*) AS n FROM bt GROUP BY 1),
g AS (SELECT item_id AS query_id, CASE WHEN c IS NULL THEN 'none' WHEN c < 0.72 THEN 'no' ELSE 'answer' END AS o, coalesce(n, 0) AS n FROM benchmark LEFT JOIN c ON query_id = item_id),
e AS (SELECT query_id, 0 AS k, 'meta' AS event, NULL AS payload FROM g UNION ALL SELECT query_id, 1, 'fallback', {_q(N.NOTICE)} FROM g WHERE o <> 'answer'
 UNION ALL SELECT query_id, 2, 'coverage', 'gap' FROM g WHERE o = 'answer' AND query_id % 2 = 0 UNION ALL SELECT query_id, 3, 'citations', n::VARCHAR FROM g WHERE o = 'answer'
 UNION ALL SELECT query_id, 4, 'delta', 'answer ' || query_id FROM g WHERE o = 'answer' UNION ALL SELECT query_id, 5, 'verified', 'verified' FROM g WHERE o = 'answer' UNION ALL SELECT query_id, 6, 'done', NULL FROM g)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS seq, event, payload FROM e""",
}
