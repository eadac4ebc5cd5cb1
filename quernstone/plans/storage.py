"""Queries of hashing, stores, versions, upload identity and applicability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import applicability as A
from ..operators import store as S
from ..operators import versions as V
from ..scratch import materialize
from . import base as P


def content_hash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return S.shared(P.chunks(spark, sf))


def shared_embedding_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.stats(P.chunks(spark, sf))


def embed_dedup_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Second version ingested after the first: what has to be embedded."""
    c = P.chunks(spark, sf)
    held = c.where("version = 1").select("content_hash").distinct()
    return S.new_hashes(c.where("version = 2"), held).select("chunk_id", "content_hash")


def reuse_ratio(spark: SparkSession, sf: str) -> DataFrame:
    c = P.chunks(spark, sf)
    held = c.where("version = 1").select("content_hash").distinct()
    second = c.where("version = 2")
    return S.reuse(second, S.new_hashes(second, held)).withColumn("reuse_ratio", F.round("reuse_ratio", 6))


def chunk_embedding_join(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each document's first version with a vector for each distinct text: a search
    scope is a document and a version, and all documents' scopes are asked at once."""
    c = P.chunks(spark, sf)
    v = P.vectors(spark, sf).withColumnRenamed("chunk_id", "vec_id")
    stored = v.join(c, F.col("vec_id") == F.col("chunk_id")).groupBy("content_hash").agg(F.min("vec_id").alias("vec_id"))
    scopes = S.versions_of(c).groupBy("document_id").agg(F.min("version").alias("version"))
    return S.scoped(c, stored, scopes).select("document_id", "chunk_id", "content_hash", "vec_id")


def any_chunk_for_hash(spark: SparkSession, sf: str) -> DataFrame:
    c = P.chunks(spark, sf)
    return S.any_chunk(c.select("content_hash").distinct(), c.where("source_kind = 'corpus'"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads: a document for each user of the events, a version for each event."""
    e = P.table(spark, sf, "events")
    return e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("version"), F.col("ts").alias("uploaded_at"), "event_type")


def version_list(spark: SparkSession, sf: str) -> DataFrame:
    return S.versions_of(P.chunks(spark, sf)).withColumn("version", F.col("version").cast("bigint"))


def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest(_documents(spark, sf)).select("document_id", "version", "event_type")


def latest_upload(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest_uploads(_documents(spark, sf)).select("document_id", "version")


def next_version(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    users = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"))
    return V.next_version(d, users)


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = P.chunks(spark, sf)
    return c.where("version = 1"), c.where("version = 2")


def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    return V.diff(*_versions(spark, sf), ["document_id"])


def version_diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = version_diff(spark, sf).groupBy("document_id")
    return d.agg(*(F.count_if(F.col("side") == s).alias(s) for s in ("added", "removed", "unchanged")))


def hash_set_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as an upload of its customer's, its lines' numbers as clauses: the first
    order of that customer with the same set."""
    line, order = P.table(spark, sf, "lineitem"), P.table(spark, sf, "orders")
    rows = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"), F.col("l_linenumber").cast("string").alias("content_hash"))
    return S.same_clauses(rows.withColumnRenamed("version", "upload_id"), rows)


def version_pointer_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's first version pointed to from its third."""
    c = P.chunks(spark, sf)
    cited = c.withColumn("chunk_id", F.format_string("%s-v%d-%d", "document_id", "version", "chunk_id")).withColumn("clause_id", F.lit(None).cast("string"))
    cited = cited.withColumn("citation", F.struct(F.col("chunk_id").alias("chunk_id"), F.col("document_id").alias("document_id"), F.col("version").alias("version")))
    pointers = c.select("document_id").distinct().select("document_id", F.lit(1).alias("version"), F.lit(3).alias("new_version"))
    out = S.point_to_versions(cited, pointers)
    return out.select("document_id", "chunk_id", F.col("version").cast("bigint").alias("version"), F.col("citation.chunk_id").alias("cited"), "content_hash")


def chunk_upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """English chunks are held; all chunks come again with a remark after their text."""
    c = P.chunks(spark, sf).withColumn("citation", F.col("lang")).select("chunk_id", "document_id", "version", "text", "content_hash", "citation", "source_kind")
    held = c.where("citation = 'en'")
    text = F.concat("text", F.lit(" (revised)"))
    new = c.withColumns({"text": text, "content_hash": X.content_hash(text), "source_kind": F.lit("changed")})
    out = S.upsert_chunks(held, new)
    return out.select("chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "content_hash", "citation", "source_kind")


def document_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads of even versions are held; all come again, later ones in place of them."""
    d = _documents(spark, sf)
    new = d.where("version % 3 = 0").withColumn("event_type", F.concat(F.lit("again "), "event_type"))
    return S.merge_documents(d.where("version % 2 = 0"), new).select("document_id", "version", "event_type")


def _agreements(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as agreements: lines as the clauses of a base and of an amendment to it, whose
    texts delete, carry forward, restate in part, replace, repeat and add."""
    line = P.table(spark, sf, "lineitem")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    number = F.when(n == 7, F.lit(None)).when(n == 6, "SCHEDULE").otherwise(F.concat(F.lit("2."), n.cast("string")))
    plain = F.concat(F.lit("Term "), (k % 3).cast("string"))
    said = (
        F.when(k % 7 == 0, plain).when(k % 7 == 1, "Clause 2.1 is hereby deleted").when(k % 7 == 2, "Clauses 2.3, 2.4 and 2.5 stand superseded; the rest follows.")
        .when(k % 7 == 3, "All other provisions of this section remain unchanged.").when(k % 7 == 4, F.concat(F.lit("Only the rows changed are shown: "), k.cast("string")))
        .when(k % 7 == 5, "Clause 2.2 is deleted and replaced as follows: no charge.").otherwise(F.concat(F.lit("New term "), k.cast("string")))
    )
    rows = line.select(F.col("l_orderkey").cast("string").alias("document_id"), place.alias("ordinal"), number.alias("number"), plain.alias("plain"), said.alias("said"), k.alias("k"), F.col("l_suppkey").alias("s"))

    def version(v: int, of: DataFrame, text: str) -> DataFrame:
        return of.select("document_id", F.lit(v).alias("version"), "ordinal", "number", F.col(text).alias("text"), F.concat(F.lit("h:"), F.col(text)).alias("content_hash"))

    return version(1, rows.where("k % 5 <> 0"), "plain"), version(2, rows.where("s % 3 = 0"), "said")


def amendment_resolve(spark: SparkSession, sf: str) -> DataFrame:
    base, change = _agreements(spark, sf)
    out = V.resolve_amendment(base, change)
    return out.select("document_id", "number", "operation", "content_hash", "previous_hash", F.col("ordinal").cast("bigint").alias("ordinal"), "clause_id")


def amendment_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Per agreement: hashes that the resolved version reuses, and that need a vector."""
    base, change = _agreements(spark, sf)
    out = materialize(V.resolve_amendment(base, change), "resolved")
    count = lambda d, n: d.groupBy("document_id").agg(F.count(F.lit(1)).alias(n))
    both = count(V.reused(out), "reused").join(count(V.embedding_required(out), "required"), "document_id", "full_outer")
    return both.select("document_id", F.coalesce("reused", F.lit(0)).alias("reused"), F.coalesce("required", F.lit(0)).alias("required"))


def amendment_notes(spark: SparkSession, sf: str) -> DataFrame:
    return V.partial_notes(_agreements(spark, sf)[1]).select("document_id", F.array_join("numbers", ",").alias("numbers"))


def standalone_resolve(spark: SparkSession, sf: str) -> DataFrame:
    out = V.resolve_standalone(V.require_base(_agreements(spark, sf)[0], P.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"))))
    return out.select("document_id", "number", "operation", F.col("ordinal").cast("bigint").alias("ordinal"), "clause_id")


def renumbered_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as clauses numbered quantity.linenumber, in clause order."""
    line = P.table(spark, sf, "lineitem").where("l_quantity IS NOT NULL")
    n = F.concat_ws(".", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"))
    c = line.select(F.col("l_orderkey").cast("string").alias("document_id"), F.lit(1).alias("version"), F.when(F.col("l_linenumber") % 3 != 0, n).alias("number"), F.col("l_linenumber").alias("ordinal"), n.alias("content_hash"))
    return V.renumber(c).select("document_id", "number", F.col("ordinal").cast("bigint").alias("ordinal"), "clause_id", "content_hash")


def _loans(spark: SparkSession, sf: str) -> DataFrame:
    o = P.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("loan_type"), F.col("o_orderdate").cast("date").alias("as_of"))


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for each brand: priorities of its nation of rules, valid while its parts ship."""
    p, li, o = (P.table(spark, sf, t) for t in ("part", "lineitem", "orders"))
    rows = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    some = F.when((F.col("p_size") == 1) & (F.col("l_linenumber") == 1), F.col("o_orderpriority"))
    return rows.groupBy(F.col("p_brand").alias("rule_id")).agg(
        F.array_sort(F.collect_set(some)).alias("loan_types"), F.min("l_shipdate").cast("date").alias("effective_from"),
        F.max(F.when(F.col("l_linenumber") == 1, F.col("l_shipdate"))).cast("date").alias("effective_to"),
    )


def applicability_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Number of loans to which each rule applies, by loan type."""
    pairs = A.applicable(_loans(spark, sf), _rules(spark, sf))
    return pairs.groupBy("rule_id", "loan_type").agg(F.count(F.lit(1)).alias("n"))


def in_force_as_of(spark: SparkSession, sf: str) -> DataFrame:
    rules = _rules(spark, sf)
    days = _loans(spark, sf).select("as_of").distinct()
    pairs = days.join(rules, A.in_force(F.col("as_of"), F.col("effective_from"), F.col("effective_to")))
    return pairs.groupBy(F.col("as_of").cast("string").alias("as_of")).agg(F.count(F.lit(1)).alias("rules"))


def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about parts under loans of a size in months, held against a manifest of
    repeals: one a nation, about two of the parts' words."""
    n = P.table(spark, sf, "nation")
    words = F.array(*map(F.lit, ("ring", "widget", "red", "small", "bolt", "blue", "large", "gear")))
    word = lambda k: F.get(words, (F.col("n_nationkey") * k % 8).cast("int"))
    repeals = n.select(F.col("n_name").alias("title"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("n_nationkey") * 40).alias("effective_from"), F.array(word(1), word(3)).alias("subject_keywords"), F.array("n_name").alias("circulars"))
    asked = P.table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Is a charge for the "), F.upper("p_name"), F.lit(" allowed?")).alias("question"), F.add_months(F.lit("1994-01-01").cast("date"), F.col("p_size")).alias("loan_date"))
    return A.coverage_gaps(asked, repeals).select("query_id", "title", "message")


QUERIES = {f.__name__: f for f in (content_hash_groups, shared_embedding_stats, embed_dedup_antijoin, reuse_ratio, chunk_embedding_join, any_chunk_for_hash, version_list, latest_version, latest_upload, next_version, version_diff, version_diff_counts, hash_set_equality, version_pointer_copy, chunk_upsert_merge, document_upsert, amendment_resolve, amendment_hashes, amendment_notes, standalone_resolve, renumbered_clauses, applicability_filter, in_force_as_of, coverage_gaps)}

_RULES = """rules AS (SELECT p_brand AS rule_id, list_sort(list_distinct(list(o_orderpriority) FILTER (p_size = 1 AND l_linenumber = 1))) AS loan_types, min(l_shipdate)::DATE AS effective_from,
  max(l_shipdate) FILTER (l_linenumber = 1)::DATE AS effective_to FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY p_brand),
loans AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS loan_type, o_orderdate::DATE AS as_of FROM orders)"""
_INTERVAL = "coalesce(effective_from <= as_of, true) AND coalesce(as_of <= effective_to, true)"
_DIFF = f"""{P.CHUNKS_SQL}, a AS (SELECT DISTINCT document_id, content_hash FROM chunks WHERE version = 1), b AS (SELECT DISTINCT document_id, content_hash FROM chunks WHERE version = 2),
d AS (SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.content_hash, b.content_hash) AS content_hash,
  CASE WHEN a.content_hash IS NULL THEN 'added' WHEN b.content_hash IS NULL THEN 'removed' ELSE 'unchanged' END AS side FROM a FULL JOIN b ON a.document_id = b.document_id AND a.content_hash = b.content_hash)"""
_NEW = f"""{P.CHUNKS_SQL}, second AS (SELECT * FROM chunks WHERE version = 2), needed AS (SELECT min(chunk_id) AS chunk_id, content_hash FROM second
  WHERE content_hash NOT IN (SELECT content_hash FROM chunks WHERE version = 1) GROUP BY content_hash)"""

_AGREEMENTS = r"""line AS (SELECT l_orderkey::VARCHAR AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal,
  CASE WHEN l_linenumber = 6 THEN 'SCHEDULE' WHEN l_linenumber <> 7 THEN '2.' || l_linenumber END AS number, l_partkey AS k, l_suppkey AS s, 'Term ' || (l_partkey % 3) AS plain,
  CASE l_partkey % 7 WHEN 0 THEN 'Term ' || (l_partkey % 3) WHEN 1 THEN 'Clause 2.1 is hereby deleted' WHEN 2 THEN 'Clauses 2.3, 2.4 and 2.5 stand superseded; the rest follows.' WHEN 3 THEN 'All other provisions of this section remain unchanged.'
    WHEN 4 THEN 'Only the rows changed are shown: ' || l_partkey WHEN 5 THEN 'Clause 2.2 is deleted and replaced as follows: no charge.' ELSE 'New term ' || l_partkey END AS said FROM lineitem),
base AS (SELECT document_id, ordinal, number, plain AS text, 'h:' || plain AS h FROM line WHERE k % 5 <> 0), chg AS (SELECT document_id, ordinal, number, said AS text, 'h:' || said AS h FROM line WHERE s % 3 = 0)"""
_RESOLVED = _AGREEMENTS + r""",
known AS (SELECT * FROM base WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, number ORDER BY ordinal) = 1),
txt AS (SELECT document_id, string_split(regexp_replace(string_agg(text, chr(10) ORDER BY ordinal, text), '([.;])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM chg GROUP BY 1),
dsent AS (SELECT document_id, unnest(list_filter(ss, lambda x: regexp_matches(x, '(?i)\b(?:is|are|stand|stands)\s+(?:hereby\s+)?(?:deleted|superseded|withdrawn|of no further effect)\b'))) AS x FROM txt),
dref AS (SELECT document_id, unnest(regexp_extract_all(x, '(?i)clauses?\s+([0-9]{1,2}(?:\.[0-9]{1,2})*(?:\s*(?:,|and|&)\s*[0-9]{1,2}(?:\.[0-9]{1,2})*)*)', 1)) AS x FROM dsent),
del AS (SELECT DISTINCT document_id, unnest(regexp_extract_all(x, '[0-9]{1,2}(?:\.[0-9]{1,2})*')) AS number FROM dref),
st0 AS (SELECT c.*, del.number IS NOT NULL AS named, k.h AS bh, k.ordinal AS bo, regexp_matches(c.text, '(?i)all other\b[^.]{0,200}?\b(?:remain|continue)s?\b[^.]{0,40}?(?:unchanged|in full force|in effect|to apply)') AS car,
  regexp_matches(c.text, '(?i)only\s+(?:the\s+)?(?:rows?|items?|entries|charges)\s+(?:changed|revised|amended|shown)') AS par, contains(lower(c.text), 'replaced as follows') OR contains(lower(c.text), 'substituted') AS rep
  FROM chg c LEFT JOIN del USING (document_id, number) LEFT JOIN known k USING (document_id, number)),
st AS (SELECT *, CASE WHEN named AND NOT rep THEN 'deletes' WHEN number IS NOT NULL AND car THEN 'carries' WHEN bh IS NOT NULL THEN CASE WHEN bh = h THEN 'same' ELSE 'replaces' END ELSE 'adds' END AS way FROM st0),
live AS (SELECT document_id, number, 1 AS src, CASE way WHEN 'replaces' THEN 'replaced' WHEN 'adds' THEN 'added' ELSE 'carried_forward' END AS operation, CASE WHEN way = 'carries' THEN bh ELSE h END AS h,
    CASE WHEN way = 'replaces' THEN bh END AS ph, CASE WHEN way = 'carries' THEN bo ELSE ordinal END AS o FROM st WHERE way IN ('replaces', 'same', 'adds') OR (way = 'carries' AND bh IS NOT NULL)
  UNION ALL SELECT document_id, number, 2, 'carried_forward', h, NULL, ordinal FROM base b WHERE document_id IN (SELECT document_id FROM chg)
    AND NOT EXISTS (SELECT 1 FROM chg c WHERE c.document_id = b.document_id AND c.number = b.number) AND NOT EXISTS (SELECT 1 FROM del d WHERE d.document_id = b.document_id AND d.number = b.number)
  UNION ALL SELECT DISTINCT document_id, number, 3, 'carried_forward', bh, NULL, bo FROM st WHERE bh IS NOT NULL AND (par OR car) AND NOT EXISTS (SELECT 1 FROM st c WHERE c.document_id = st.document_id AND c.number = st.number AND c.way = 'carries')),
placed AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN regexp_matches(number, '^[0-9]') THEN 0 ELSE 1 END, CASE WHEN regexp_matches(number, '^[0-9]') THEN list_transform(string_split(number, '.'), lambda x: x::INT) END NULLS FIRST, o, src, h) - 1 AS place FROM live),
gone AS (SELECT document_id, number, bh FROM st WHERE way = 'deletes' AND bh IS NOT NULL UNION ALL SELECT d.document_id, d.number, k.h FROM del d JOIN known k USING (document_id, number)
  WHERE NOT EXISTS (SELECT 1 FROM chg c WHERE c.document_id = d.document_id AND c.number = d.number)),
resolved AS (SELECT document_id, number, operation, h AS content_hash, ph AS previous_hash, place AS ordinal, format('{}-v2-c{:04d}', document_id, place) AS clause_id FROM placed
  UNION ALL SELECT document_id, number, 'deleted', NULL, bh, NULL, NULL FROM gone)"""

SQL = {
    "document_upsert": "SELECT user_id AS document_id, event_id AS version, CASE WHEN event_id % 3 = 0 THEN 'again ' ELSE '' END || event_type AS event_type FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0",
    "amendment_resolve": f"WITH {_RESOLVED} SELECT * FROM resolved",
    "amendment_hashes": f"WITH {_RESOLVED} SELECT document_id, count(DISTINCT content_hash) FILTER (operation = 'carried_forward') AS reused, count(DISTINCT content_hash) FILTER (operation IN ('replaced', 'added')) AS required FROM resolved WHERE operation <> 'deleted' GROUP BY 1",
    "amendment_notes": f"WITH {_RESOLVED} SELECT document_id, string_agg(number, ',' ORDER BY ordinal) AS numbers FROM st WHERE number IS NOT NULL AND (par OR car) GROUP BY 1",
    "standalone_resolve": f"""WITH {_AGREEMENTS}, p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN regexp_matches(number, '^[0-9]') THEN 0 ELSE 1 END,
  CASE WHEN regexp_matches(number, '^[0-9]') THEN list_transform(string_split(number, '.'), lambda x: x::INT) END NULLS FIRST, ordinal) - 1 AS place FROM base)
SELECT document_id, number, 'added' AS operation, place AS ordinal, format('{{}}-v1-c{{:04d}}', document_id, place) AS clause_id FROM p""",
    "content_hash_groups": f"WITH {P.CHUNKS_SQL} SELECT content_hash, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "shared_embedding_stats": f"WITH {P.CHUNKS_SQL}, g AS (SELECT count(*) AS n FROM chunks GROUP BY content_hash) SELECT sum(n)::BIGINT AS chunks, count(*) AS embeddings, count(*) FILTER (n > 1) AS shared_embeddings FROM g",
    "embed_dedup_antijoin": f"WITH {_NEW} SELECT chunk_id, content_hash FROM needed",
    "reuse_ratio": f"WITH {_NEW}, t AS (SELECT (SELECT count(*) FROM second) AS total, (SELECT count(*) FROM needed) AS embedded) SELECT total, embedded, total - embedded AS reused, round((total - embedded) / total, 6) AS reuse_ratio FROM t",
    "chunk_embedding_join": f"WITH {P.CHUNKS_SQL}, s AS (SELECT content_hash, min(vec_id) AS vec_id FROM embeddings JOIN chunks ON chunk_id = vec_id GROUP BY 1), f AS (SELECT document_id, min(version) AS version FROM chunks GROUP BY 1) SELECT document_id, chunk_id, content_hash, vec_id FROM chunks JOIN f USING (document_id, version) JOIN s USING (content_hash)",
    "any_chunk_for_hash": f"WITH {P.CHUNKS_SQL} SELECT content_hash, coalesce(CAST(min(chunk_id) FILTER (source_kind = 'corpus') AS VARCHAR), '') AS chunk_id FROM chunks GROUP BY 1",
    "version_list": f"WITH {P.CHUNKS_SQL} SELECT DISTINCT document_id, version::BIGINT AS version FROM chunks",
    "latest_version": "SELECT user_id AS document_id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "latest_upload": "SELECT user_id AS document_id, event_id AS version FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "next_version": "SELECT c_custkey AS document_id, coalesce(max(event_id), 0) + 1 AS next_version FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1",
    "version_diff": f"WITH {_DIFF} SELECT * FROM d",
    "version_diff_counts": f"WITH {_DIFF} SELECT document_id, count(*) FILTER (side = 'added') AS added, count(*) FILTER (side = 'removed') AS removed, count(*) FILTER (side = 'unchanged') AS unchanged FROM d GROUP BY 1",
    "hash_set_equality": "WITH s AS (SELECT o_custkey AS c, o_orderkey AS o, list_sort(list(DISTINCT l_linenumber::VARCHAR)) AS ls FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o AS upload_id, c AS document_id, min(o) OVER (PARTITION BY c, ls) AS version FROM s",
    "version_pointer_copy": f"WITH {P.CHUNKS_SQL}, c AS (SELECT document_id, document_id || '-v3-' || document_id || '-v1-' || chunk_id AS id, content_hash FROM chunks WHERE version = 1) SELECT document_id, id AS chunk_id, 3::BIGINT AS version, id AS cited, content_hash FROM c",
    "chunk_upsert_merge": f"SELECT doc_id AS chunk_id, md5(text || ' (revised)') AS text_md5, {P.hash_sql("text || ' (revised)'")} AS content_hash, lang AS citation, CASE WHEN lang = 'en' THEN CASE WHEN doc_id % 4 = 0 THEN 'corpus' ELSE 'user_document' END ELSE 'changed' END AS source_kind FROM documents",
    "renumbered_clauses": """WITH c AS (SELECT l_orderkey::VARCHAR AS document_id, l_quantity::INT || '.' || l_linenumber AS h, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity::INT || '.' || l_linenumber END AS number, l_quantity::INT AS q, l_linenumber AS l FROM lineitem WHERE l_quantity IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY number IS NULL, CASE WHEN number IS NOT NULL THEN q END, CASE WHEN number IS NOT NULL THEN l END, l, h) - 1 AS ordinal FROM c)
SELECT document_id, number, ordinal, format('{}-v1-c{:04d}', document_id, ordinal) AS clause_id, h AS content_hash FROM r""",
    "applicability_filter": f"WITH {_RULES} SELECT rule_id, loan_type, count(*) AS n FROM loans JOIN rules ON (loan_types IS NULL OR len(loan_types) = 0 OR loan_type IS NULL OR list_contains(loan_types, loan_type)) AND {_INTERVAL} GROUP BY ALL",
    "in_force_as_of": f"WITH {_RULES}, days AS (SELECT DISTINCT as_of FROM loans) SELECT as_of::VARCHAR AS as_of, count(*) AS rules FROM days JOIN rules ON {_INTERVAL} GROUP BY 1",
    "coverage_gaps": """WITH w AS (SELECT ['ring', 'widget', 'red', 'small', 'bolt', 'blue', 'large', 'gear'] AS ws), r AS (SELECT n_name AS title, DATE '1995-01-01' + n_nationkey * 40 AS f, [ws[n_nationkey % 8 + 1], ws[n_nationkey * 3 % 8 + 1]] AS ks FROM nation, w),
q AS (SELECT p_partkey AS query_id, 'Is a charge for the ' || upper(p_name) || ' allowed?' AS question, (DATE '1994-01-01' + to_months(p_size))::DATE AS loan_date FROM part)
SELECT query_id, title, title || ' applies from ' || strftime(f, '%-d %B %Y') || '; your loan of ' || strftime(loan_date, '%-d %B %Y') || ' is under the rules before it.' AS message
FROM q, r WHERE loan_date < f AND list_bool_or(list_transform(ks, lambda x: contains(lower(question), x)))""",
}
