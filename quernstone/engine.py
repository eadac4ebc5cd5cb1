"""The engine: ingestion into Parquet stores, retrieval and answers for tables of questions.

A table is a folder of numbered generations, each a folder of numbered parts. New rows are
appended as a part; a merge that changes rows writes the next generation. Only complete
parts are read, so a reader never sees half a write. Questions are rows (query_id, question,
document_id, version, loan_type, borrower_type, lender_class, as_of); a null version is the
document's latest, other nulls take what is known of the document or else widen the scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as X
from .operators import answer as N
from .operators import applicability as A
from .operators import chunk as C
from .operators import embed as E
from .operators import retrieve as R
from .operators import store as S
from .operators import versions as V
from .scratch import materialize
from .sources import parse as P

APPLICABILITY = "struct<loan_types:array<string>,borrower_types:array<string>,lender_classes:array<string>,purposes:array<string>,effective_from:date,effective_to:date>"
CITATION = "struct<chunk_id:string,source_kind:string,document_id:string,version:int,page:int,clause_number:string,title:string,circular_id:string,source_url:string>"
REPEALS = "struct<effective_from:date,circulars:array<string>,note:string,subject_keywords:array<string>>"
TABLES = {
    "chunks": f"chunk_id string, document_id string, version int, clause_id string, ordinal int, text string, content_hash string, source_kind string, applicability {APPLICABILITY}, citation {CITATION}",
    "embeddings": "content_hash string, vector array<float>",
    "documents": "document_id string, version int, title string, filename string, kind string, loan_type string, borrower_type string, lender_class string, agreement_date date, n_clauses bigint, summary string, uploaded_at timestamp",
    "clauses": "document_id string, version int, ordinal int, clause_id string, number string, text string, content_hash string, operation string, previous_hash string",
    "corpus": f"document_id string, title string, reference string, applicability {APPLICABILITY}, topics array<string>, repeals {REPEALS}",
}
KEY = ["document_id", "version"]
RULES = (
    "Answer from the numbered passages only. Put the passage's number in square brackets after every sentence that states a fact. State no figure that no passage states."
    " Tell what the agreement says apart from what the rules require. Use plain language and give no advice."
)


class Engine:
    def __init__(self, spark: SparkSession, root: str, provider: str | Callable[[DataFrame, str], DataFrame] = "hashing", threshold: float = 0.72):
        """provider: a name in embed.PROVIDERS, or a function from a DataFrame (key, text) to
        (key, vector), as embed.provided makes."""
        self.spark, self.root, self.threshold = spark, root.rstrip("/"), threshold
        self.embed = E.PROVIDERS[provider] if isinstance(provider, str) else provider

    # --- tables

    def _folders(self, path: str) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _complete(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path, "_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _current(self, name: str) -> int:
        """The newest generation whose first part is complete; 0 if there is none."""
        return next((g for g in reversed(self._folders(f"{self.root}/{name}")) if self._complete(f"{self.root}/{name}/{g}/0")), 0)

    def schema(self, name: str):
        return self.spark.createDataFrame([], TABLES[name]).schema

    def table(self, name: str) -> DataFrame:
        at = f"{self.root}/{name}/{self._current(name)}"
        parts = [p for k in self._folders(at) if self._complete(p := f"{at}/{k}")]
        return self.spark.read.schema(self.schema(name)).parquet(*parts) if parts else self.spark.createDataFrame([], TABLES[name])

    def append(self, name: str, rows: DataFrame) -> None:
        now = self._current(name)
        part = max(self._folders(f"{self.root}/{name}/{now}"), default=-1) + 1 if now else 0
        self._write(name, rows, now or self._next(name), part)

    def rewrite(self, name: str, rows: DataFrame) -> None:
        """The table's next generation, which also joins its parts."""
        self._write(name, rows, self._next(name), 0)

    def _next(self, name: str) -> int:
        return max(self._folders(f"{self.root}/{name}"), default=0) + 1

    def _write(self, name: str, rows: DataFrame, generation: int, part: int) -> None:
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema(name))).write.mode("overwrite").parquet(f"{self.root}/{name}/{generation}/{part}")

    def _merge(self, name: str, incoming: DataFrame, key: list[str], merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Append rows whose keys are new; a key that is there makes the next generation."""
        held = self.table(name)
        if held.join(incoming.select(*key), key, "left_semi").isEmpty():
            self.append(name, incoming)
        else:
            self.rewrite(name, merged(held, incoming))

    # --- ingestion

    def ingest(self, clauses: DataFrame, documents: DataFrame, amendment: bool | None = None) -> DataFrame:
        """Ingest one version of each document. clauses: (document_id, version, ordinal,
        number, text, content_hash, page_start); documents: (document_id, version, title) and
        whatever else parse() tells. Documents of kind ``amendment`` (all, or none, if
        `amendment` says so) are resolved against their latest version; one without a version
        held is an error. Returns total, embedded, reused, reuse_ratio."""
        cols = ["document_id", "version", "ordinal", "number", "text", "content_hash"]
        kind = F.lit(amendment) if amendment is not None else (F.col("kind") == "amendment" if "kind" in documents.columns else F.lit(False))
        revised = documents.where(F.coalesce(kind, F.lit(False))).select(*KEY).distinct()
        own = clauses.select(*cols)
        resolved = V.resolve_standalone(own.join(revised, KEY, "left_anti")).withColumn("previous_hash", F.lit(None).cast("string"))
        if not revised.isEmpty():
            held = self.table("clauses").where("operation <> 'deleted'").join(revised.withColumnRenamed("version", "_new"), "document_id").where("version < _new").drop("_new")
            base = held.join(held.groupBy("document_id").agg(F.max("version").alias("version")), KEY).select(*cols)
            change = V.require_base(own.join(revised, KEY, "left_semi"), base)
            resolved = resolved.unionByName(V.resolve_amendment(base, change).select(*resolved.columns))
        resolved = materialize(resolved, "resolved")
        self._merge("clauses", resolved, KEY, lambda a, b: a.join(b.select(*KEY).distinct(), KEY, "left_anti").unionByName(b.select(*a.columns)))
        live = resolved.where("operation <> 'deleted'")
        page = clauses.groupBy("document_id", "content_hash").agg(F.min("page_start").cast("int").alias("_page"))
        chunks = C.chunk_clauses(live).join(page, ["document_id", "content_hash"], "left").join(documents.select(*KEY, "title"), KEY, "left")
        none = F.lit(None)
        cite = F.struct("chunk_id", "source_kind", "document_id", F.col("version").cast("int").alias("version"), F.col("_page").alias("page"), F.col("number").alias("clause_number"), "title", none.cast("string").alias("circular_id"), none.cast("string").alias("source_url"))
        counted = documents.drop("n_clauses").join(live.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_clauses")), KEY, "left")
        return self._store(chunks.withColumns({"citation": cite.cast(CITATION), "applicability": none.cast(APPLICABILITY)}), counted.withColumn("n_clauses", F.coalesce("n_clauses", F.lit(0))))

    def upload(self, documents: DataFrame, clauses: DataFrame) -> DataFrame:
        """Ingest what parse() made of uploaded files: the document is the one of its key, its
        version the next one, and a file whose clauses equal those of a version held is not
        ingested again. Returns upload_id, document_id, version, status (stored or held)."""
        files = materialize(documents.withColumnsRenamed({"document_id": "upload_id", "document_key": "document_id"}).drop("version"), "uploads")
        texts = clauses.withColumnRenamed("document_id", "upload_id").drop("version", "clause_id").join(files.select("upload_id", "document_id"), "upload_id")
        known = self.table("clauses").where("operation <> 'deleted'")
        same = S.same_clauses(texts.select("upload_id", "document_id", "content_hash"), known).select("upload_id", F.col("version").alias("_held"))
        last = known.groupBy("document_id").agg(F.max("version").alias("_last"))
        order = W.partitionBy("document_id", F.col("_held").isNull()).orderBy("upload_id")
        rows = files.join(same, "upload_id", "left").join(last, "document_id", "left")
        rows = rows.withColumn("version", F.coalesce("_held", F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("int")).drop("_last")
        rows = materialize(rows, "uploads-versions")
        new = rows.where("_held IS NULL").drop("_held")
        if not new.isEmpty():
            self.ingest(texts.join(new.select("upload_id", "version"), "upload_id").drop("upload_id"), new)
        return rows.select("upload_id", "document_id", "version", F.when(F.col("_held").isNull(), "stored").otherwise("held").alias("status"))

    def ingest_corpus(self, clauses: DataFrame, manifest: DataFrame) -> DataFrame:
        """Ingest reference documents (document_id = manifest id): their chunks with the
        entry's applicability, and the entry itself with its topics and repeals."""
        chunks = C.chunk_corpus(clauses.drop("version"), manifest)
        cite = F.struct("chunk_id", "source_kind", "document_id", F.col("version").cast("int").alias("version"), F.lit(None).cast("int").alias("page"), F.col("number").alias("clause_number"), "title", "circular_id", "source_url")
        has = lambda c, kind: (F.col(c) if c in manifest.columns else F.lit(None)).cast(kind).alias(c)
        entries = manifest.select(F.col("id").alias("document_id"), "title", "reference", F.col("applicability").cast(APPLICABILITY).alias("applicability"), has("topics", "array<string>"), has("repeals", REPEALS))
        self._merge("corpus", entries, ["document_id"], lambda a, b: a.join(b.select("document_id"), "document_id", "left_anti").unionByName(b.select(*a.columns)))
        titles = entries.select("document_id", F.lit(1).alias("version"), "title", F.lit("rbi_circular").alias("kind"))
        return self._store(chunks.withColumns({"citation": cite.cast(CITATION), "applicability": F.col("applicability").cast(APPLICABILITY)}), titles)

    def _store(self, chunks: DataFrame, documents: DataFrame) -> DataFrame:
        chunks = materialize(chunks.select(*self.schema("chunks").names), "chunks")
        held = self.table("embeddings")
        needed = materialize(S.new_hashes(chunks, held), "new-hashes")
        report = S.reuse(chunks, needed).collect()
        vectors = self.embed(needed.select("content_hash", "text"), "content_hash")
        if not needed.isEmpty():
            self.append("embeddings", S.insert_embeddings(held, vectors))
        self._merge("chunks", chunks, ["chunk_id"], S.upsert_chunks)
        schema = self.schema("documents")
        known = documents.join(C.pinned_summary(documents), KEY).withColumn("uploaded_at", F.current_timestamp())
        rows = known.select(*((F.col(f.name) if f.name in known.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        self._merge("documents", rows, KEY, S.merge_documents)
        return self.spark.createDataFrame(report)

    # --- views

    def list_documents(self) -> DataFrame:
        """The latest version of each document with all its versions."""
        d = self.table("documents")
        versions = d.groupBy("document_id").agg(F.array_sort(F.collect_set("version")).alias("versions"))
        return S.latest(d).select("document_id", "version", "title", "filename", "kind", "n_clauses").join(versions, "document_id")

    def list_clauses(self, document_id: str, version: int | None = None) -> DataFrame:
        """Clauses in force in a version, or in the latest one, in order."""
        rows = self.table("clauses").where((F.col("document_id") == document_id) & (F.col("operation") != "deleted"))
        rows = P.newest(rows) if version is None else rows.where(F.col("version") == version)
        return rows.select("clause_id", "number", "text", "version").orderBy("clause_id")

    # --- retrieval

    def scoped(self, queries: DataFrame) -> DataFrame:
        """queries with what they leave open taken from their document: its latest version,
        and that version's loan type, borrower type, lender class and date."""
        d = self.table("documents").where("kind IS NULL OR kind <> 'rbi_circular'")
        last = d.groupBy("document_id").agg(F.max("version").alias("_last"))
        facts = d.select(*KEY, F.col("loan_type").alias("_loan"), F.col("borrower_type").alias("_borrower"), F.col("lender_class").alias("_lender"), F.col("agreement_date").alias("_date"))
        rows = queries.join(last, "document_id", "left").withColumn("version", F.coalesce("version", "_last")).drop("_last").join(facts, KEY, "left")
        for column, fact in (("loan_type", "_loan"), ("borrower_type", "_borrower"), ("lender_class", "_lender"), ("as_of", "_date")):
            rows = rows.withColumn(column, F.coalesce(column, fact)).drop(fact)
        return rows.select(*queries.columns)

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, _q): the questions' vectors, scaled to length one."""
        v = self.embed(queries.select("query_id", F.col("question").alias("text")), "query_id")
        return materialize(v.select("query_id", R.unit(F.col("vector")).alias("_q")), "asked")

    def _vectors(self) -> DataFrame:
        return self.table("embeddings").select("content_hash", R.unit(F.col("vector")).alias("_v"))

    def _branch(self, queries: DataFrame, pairs: DataFrame, top_k: int, weights: tuple[float, float]) -> DataFrame:
        """Ranked candidates from pairs (query_id, chunk_id, dense): ids and scores decide the
        top k; only these get their texts. Adds considered, the number of candidates."""
        order = W.partitionBy("query_id").orderBy(F.col("dense").desc(), "chunk_id")
        best = pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k).drop("_r")
        cand = materialize(best.join(self.table("chunks"), "chunk_id").join(queries.select("query_id", "question"), "query_id"), "candidates")
        lexical = R.bm25(queries, cand.select("query_id", "chunk_id", "text"))
        topics = self.table("corpus").where("size(topics) > 0").select("document_id", F.array_distinct(X.tokens(F.array_join("topics", " "))).alias("_topics"))
        joined = cand.join(lexical, ["query_id", "chunk_id"], "left").join(topics, "document_id", "left")
        overlap = R.topic_overlap(X.tokens(F.col("question")), F.coalesce("_topics", F.array().cast("array<string>")))
        bonus = R.rerank_bonus(F.col("question"), F.col("text"), F.col("source_kind"), F.col("citation.clause_number"), overlap)
        fused = R.fuse(joined.withColumn("bonus", bonus).drop("_topics"), *weights)
        by = W.partitionBy("query_id")
        ranked = fused.withColumns({"rank": F.row_number().over(by.orderBy(F.col("fused").desc(), "chunk_id")), "considered": F.count(F.lit(1)).over(by)})
        return materialize(ranked, "ranked")

    def _finish(self, ranked: DataFrame, top_n: int) -> DataFrame:
        """The first top_n that are no near-duplicates, rank their place; filtered_out counts
        those set aside."""
        kept = R.drop_near_duplicates(ranked.select("query_id", "rank", F.col("rank").cast("bigint").alias("chunk_id"), "text"), top_n)
        kept = kept.select("query_id", F.col("chunk_id").cast("int").alias("rank"), "place")
        rows = ranked.join(kept, ["query_id", "rank"])
        by = W.partitionBy("query_id")
        full = F.max("place").over(by) >= top_n
        seen = F.when(full, F.max("rank").over(by)).otherwise(F.col("considered"))
        return rows.withColumn("filtered_out", seen - F.max("place").over(by)).drop("rank").withColumnRenamed("place", "rank")

    def _scores(self, scope: DataFrame, asked: DataFrame) -> DataFrame:
        """(query_id, chunk_id, dense) of a scope (query_id, chunk_id, content_hash). Vectors of
        another dimension than the question's are left out."""
        pairs = scope.join(self._vectors(), "content_hash").join(asked, "query_id").where(F.size("_q") == F.size("_v"))
        return pairs.select("query_id", "chunk_id", F.round(R.dot(F.col("_q"), F.col("_v")), 6).alias("dense"))

    def _mine(self, queries: DataFrame, asked: DataFrame, kinds: tuple[str, ...] = ("user_document", "corpus")) -> DataFrame:
        """Pairs of each query and the chunks of its document's version."""
        chunks = self.table("chunks").where(F.col("source_kind").isin(*kinds)).select("chunk_id", *KEY, "content_hash")
        return self._scores(queries.where("document_id IS NOT NULL").select("query_id", *KEY).join(chunks, KEY), asked)

    def _theirs(self, queries: DataFrame, asked: DataFrame) -> DataFrame:
        """Pairs of each query and the corpus chunks that apply: the manifest's rows are held
        against the query first, then their chunks follow by document."""
        rules = self.table("corpus").select("document_id", *(F.col(f"applicability.{r}").alias(r) for _, r in A.AXES), "applicability.effective_from", "applicability.effective_to")
        apply = A.applicable(queries.drop(*KEY), rules).select("query_id", "document_id")
        chunks = self.table("chunks").where("source_kind = 'corpus'").select("chunk_id", "document_id", "content_hash")
        return self._scores(apply.join(chunks, "document_id").select("query_id", "chunk_id", "content_hash"), asked)

    def retrieve(self, queries: DataFrame, top_k: int = 24, top_n: int = 8, weights: tuple[float, float] = (R.DENSE_WEIGHT, R.LEXICAL_WEIGHT)) -> DataFrame:
        """The best passages in each query's scope, near-duplicates suppressed: a document's
        version, or, for a query without a document, every chunk."""
        queries = materialize(self.scoped(queries), "queries")
        asked = self._asked(queries)
        pairs = self._mine(queries, asked)
        free = asked.join(queries.where("document_id IS NULL").select("query_id"), "query_id")
        if not free.isEmpty():
            store = self.table("chunks").select("chunk_id", "content_hash").join(self._vectors(), "content_hash").select("chunk_id", F.col("_v").alias("v"))
            pairs = pairs.unionByName(R.dense_topk(free.withColumnRenamed("_q", "q"), store, top_k).drop("rank"))
        return self._finish(self._branch(queries, pairs, top_k, weights), top_n)

    def retrieve_for_answer(self, queries: DataFrame, top_k: int = 32, top_n: int = 8, weights: tuple[float, float] = (R.DENSE_WEIGHT, R.LEXICAL_WEIGHT)) -> DataFrame:
        """Passages of the user's document and of the corpus rules that apply, with places
        reserved for the former; considered and filtered_out are those of both searches."""
        queries = materialize(self.scoped(queries), "queries")
        asked = self._asked(queries)
        branches = (self._mine(queries, asked, ("user_document",)), self._theirs(queries, asked))
        parts = [self._finish(self._branch(queries, b, top_k, weights), top_n) for b in branches]
        both = materialize(parts[0].drop("rank").unionByName(parts[1].drop("rank")), "both")
        counts = both.groupBy("query_id", "source_kind").agg(F.max("considered").alias("c"), F.max("filtered_out").alias("f")).groupBy("query_id").agg(F.sum("c").alias("considered"), F.sum("f").alias("filtered_out"))
        merged = R.reserved_merge(both, top_n).select("query_id", "chunk_id", "rank")
        return both.drop("considered", "filtered_out").join(merged, ["query_id", "chunk_id"]).join(counts, "query_id")

    def answer(self, queries: DataFrame, writer: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
        """outcomes, passages, coverage, sentences, answers, fallbacks and events of all questions.

        writer: a function from (query_id, prompt) to (query_id, text), such as a hosted
        model's; what it leaves without a text is put together from quoted passages instead."""
        queries = materialize(self.scoped(queries), "queries")
        passages = materialize(self.retrieve_for_answer(queries), "passages")
        gated = R.gate(queries, passages, self.threshold)
        counts = passages.groupBy("query_id").agg(F.max("considered").alias("considered"), F.max("filtered_out").alias("filtered_out"))
        outcomes = materialize(gated.join(counts, "query_id", "left").na.fill(0, ["considered", "filtered_out"]), "outcomes")
        open_ = outcomes.where("outcome = 'answer'").select("query_id")
        reference = F.when(F.col("source_kind") == "corpus", F.coalesce("citation.circular_id", "document_id"))
        label = N.source_label(F.col("citation.clause_number"), F.coalesce("citation.page", F.lit(1)), reference)
        shown = passages.join(open_, "query_id").select("query_id", F.col("rank").alias("n"), label.alias("label"), "question", "text", "chunk_id", "citation", "dense", "fused")
        quoted = N.extract_answer(shown)
        written, degraded = quoted, None
        if writer is not None:
            about = self.table("documents").join(queries.select("query_id", *KEY), KEY).select("query_id", "summary")
            drafts = materialize(writer(N.prompt(shown, about, RULES)).select("query_id", F.col("text").alias("_draft")), "drafts")
            both = quoted.join(drafts, "query_id", "left")
            degraded = both.where("_draft IS NULL").select("query_id", F.lit("the writer gave no answer; this one was put together from quoted passages").alias("payload"))
            written = both.select("query_id", F.coalesce("_draft", "answer").alias("answer"))
        answers = materialize(written, "answers")
        rows = answers.join(queries.select("query_id", "question"), "query_id").select(F.col("query_id").alias("answer_id"), "question", F.col("answer").alias("text"))
        sentences = materialize(N.verify(rows, shown.select(F.col("query_id").alias("answer_id"), "n", "text"), blanks=True), "sentences")
        verified = N.verified_answers(sentences)
        back = N.fallback(queries.join(open_, "query_id", "left_anti"))
        coverage = self.coverage(queries)
        cites = shown.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n", "chunk_id", "citation", F.round("fused", 4).alias("score"), F.round("dense", 4).alias("confidence"))))).alias("payload"))
        texts = answers.join(verified.select(F.col("answer_id").alias("query_id"), F.col("text").alias("verified")), "query_id", "left").select("query_id", F.col("answer").alias("payload"), "verified")
        events = N.events(outcomes, coverage, cites, texts, back.select("query_id", F.to_json(F.struct("notice", "explanation", "advisor")).alias("payload")), degraded)
        return {"outcomes": outcomes, "passages": passages, "coverage": coverage, "sentences": sentences.where("sentence <> ''"), "answers": verified, "fallbacks": back, "events": events}

    def coverage(self, queries: DataFrame) -> DataFrame:
        """query_id, payload: what was repealed after the loan of a question on its subject."""
        c = F.col("repeals")
        repeals = self.table("corpus").where(c.isNotNull()).select("title", "reference", c["effective_from"].alias("effective_from"), c["circulars"].alias("circulars"), c["subject_keywords"].alias("subject_keywords"))
        gaps = A.coverage_gaps(queries.select("query_id", "question", F.col("as_of").alias("loan_date")), repeals)
        each = F.struct(F.col("effective_from"), F.col("reference").alias("superseded_by"), F.col("circulars").alias("missing_circulars"), "message")
        return gaps.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(each))).alias("payload"))

    # --- evaluation

    def evaluate(self, cases: DataFrame, top_k: int = 32, top_n: int = 8) -> DataFrame:
        """mode, cases, clause_recall, corpus_found, refusals, passed: a goldset (as
        parse.GOLDSET; the case's document, version and facts are its scope) scored with
        dense scores alone and with both."""
        queries = materialize(cases.select(
            F.col("id").alias("query_id"), "question", "document_id", "version", *((F.col(c) if c in cases.columns else F.lit(None)).cast(k).alias(c) for c, k in (("loan_type", "string"), ("borrower_type", "string"), ("lender_class", "string"), ("as_of", "date")))
        ), "cases")
        out = []
        for mode, weights in (("dense-only", (1.0, 0.0)), ("hybrid", (R.DENSE_WEIGHT, R.LEXICAL_WEIGHT))):
            found = materialize(self.retrieve_for_answer(queries, top_k, top_n, weights), "found")
            own = F.col("source_kind") == "user_document"
            passages = found.select("query_id", "rank", F.when(own, F.col("citation.clause_number")).alias("clause_number"), F.when(~own, F.col("document_id")).alias("corpus_id"), "text")
            outcomes = found.groupBy("query_id").agg(F.max("dense").alias("confidence"))
            scored = P.score_goldset(cases, passages, outcomes, self.threshold).join(cases.select("id", F.coalesce("expect_insufficient", F.lit(False)).alias("_no")), "id")
            out.append(P.summarize_goldset(scored).select(F.lit(mode).alias("mode"), "*"))
        return out[0].unionByName(out[1])


def prompt(passages: DataFrame, rules: str = RULES, summaries: DataFrame | None = None) -> DataFrame:
    """query_id, prompt; summaries: (query_id, summary)."""
    none = passages.select("query_id").where("false").withColumn("summary", F.lit(""))
    return N.prompt(passages, none if summaries is None else summaries, rules)


def human_summary(documents: DataFrame, clauses: DataFrame) -> DataFrame:
    """document_id, version, summary: a parsed document for people to read; its facts and a
    line for each clause."""
    head: Column = F.format_string("[%s] %s", F.coalesce("number", F.lit("-")), F.coalesce("heading", F.substring("text", 1, 60)))
    per = clauses.groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", head.alias("l")))), lambda x: x["l"]), "\n").alias("_lines"))
    return C.pinned_summary(documents).join(per, KEY, "left").select(*KEY, F.concat_ws("\n", "summary", "_lines").alias("summary"))
