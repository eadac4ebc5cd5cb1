import datetime as dt

import pytest
from pyspark.sql import functions as F

from quernstone.engine import Engine, prompt
from quernstone.functions import text as X
from quernstone.operators import segment as G
from quernstone.sources import parse as P

CLAUSES = "document_id string, version int, ordinal int, number string, text string, page_start int"
V1 = [("1.1", "The loan is repaid in sixty equal monthly instalments by bank transfer."), ("2.1", "A prepayment penalty of 4 percent applies to floating rate loans repaid early."), ("3.1", "The borrower insures the mortgaged property at own expense.")]
V2 = [("2.1", "A prepayment penalty of 2 percent applies to floating rate loans repaid early.")]
QUERY = "query_id int, question string, document_id string, version int, loan_type string, borrower_type string, lender_class string, as_of date"


def clauses(spark, version, rows, doc="loan"):
    df = spark.createDataFrame([(doc, version, k, n, t, 1) for k, (n, t) in enumerate(rows)], CLAUSES)
    return df.withColumn("content_hash", X.content_hash(F.col("text")))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), threshold=0.3)
    title = lambda v: spark.createDataFrame([("loan", v, "Home Loan Agreement")], "document_id string, version int, title string")
    e.first = e.ingest(clauses(spark, 1, V1), title(1)).first()
    e.second = e.ingest(clauses(spark, 2, V2), title(2), amendment=True).first()
    e.again = e.ingest(clauses(spark, 2, V2), title(2), amendment=True).first()
    rule = clauses(spark, 1, [("4", "No prepayment penalty may be charged on floating rate loans to individuals.")], "rule-a").unionByName(clauses(spark, 1, [("5", "Prepayment penalty rules for co-operative banks lending to members.")], "rule-b"))
    app = lambda lender, start: ([], [], lender, [], start, None)
    manifest = spark.createDataFrame(
        [("rule-a", "Prepayment rules", "R/1", None, app([], dt.date(2026, 1, 1))), ("rule-b", "Bank rules", "R/2", None, app(["cooperative_bank"], None))],
        "id string, title string, reference string, source_url string, applicability struct<loan_types:array<string>,borrower_types:array<string>,lender_classes:array<string>,purposes:array<string>,effective_from:date,effective_to:date>",
    )
    e.ingest_corpus(rule, manifest)
    return e


def ask(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], QUERY)


Q = "What prepayment penalty applies to floating rate loans?"


def test_amended_versions_share_vectors(engine):
    assert (engine.first["total"], engine.first["embedded"]) == (3, 3)
    assert (engine.second["total"], engine.second["embedded"], engine.second["reused"]) == (3, 1, 2)
    assert engine.again["embedded"] == 0 and engine.table("chunks").where("document_id = 'loan'").count() == 6


def test_version_scope(spark, engine):
    got = engine.retrieve(ask(spark, (Q, "loan", 2, None, None, None, None), (Q, "loan", 1, None, None, None, None))).collect()
    assert {(r["query_id"], r["version"]) for r in got} == {(0, 2), (1, 1)}
    assert not any("4 percent" in r["text"] for r in got if r["query_id"] == 0)


def test_applicability_and_reserved_places(spark, engine):
    scope = [("housing_finance_company", dt.date(2026, 2, 1)), ("housing_finance_company", dt.date(2025, 2, 1)), (None, None)]
    got = engine.retrieve_for_answer(ask(spark, *((Q, "loan", 2, None, None, lender, day) for lender, day in scope))).collect()
    corpus = lambda k: {r["document_id"] for r in got if r["query_id"] == k and r["source_kind"] == "corpus"}
    assert (corpus(0), corpus(1), corpus(2)) == ({"rule-a"}, set(), {"rule-a", "rule-b"})
    assert all(any(r["source_kind"] == "user_document" for r in got if r["query_id"] == k) for k in range(3))


def test_answers(spark, engine):
    out = engine.answer(ask(spark, (Q, "loan", 2, None, None, None, dt.date(2026, 2, 1)), ("Who won the football match?", "none", 1, None, None, "bank", dt.date(2020, 1, 1))))
    assert {r["query_id"]: r["outcome"] for r in out["outcomes"].collect()} == {0: "answer", 1: "nothing_retrieved"}
    text = out["answers"].first()["text"]
    assert "2 percent" in text and "4 percent" not in text
    names = lambda k: [r["event"] for r in out["events"].where(f"query_id = {k}").orderBy("seq").collect()]
    assert names(0) == ["meta", "citations", "delta", "verified", "done"] and names(1) == ["meta", "fallback", "done"]


def test_prompt(spark):
    df = spark.createDataFrame([(1, 2, "b", "two"), (1, 1, "a", "one")], "query_id int, n int, label string, text string")
    assert prompt(df, "R").first()["prompt"] == "R\n\nPassages:\n\n[1] a\none\n\n[2] b\ntwo"
    about = spark.createDataFrame([(1, "Type: loan")], "query_id int, summary string")
    assert prompt(df, "R", about).first()["prompt"].startswith("R\n\nThe document being discussed:\nType: loan\n\nPassages:\n\n[1] a")


def test_parse(spark):
    texts = ["HOME LOAN AGREEMENT", "between Alpha Housing Finance Limited (the lender) and Asha, an individual (the borrower), dated 3 March 2024.", "1.1 The borrower pays monthly.", "1.2 The rate is nine percent.", "1.3 Early payment is free."]
    lines = spark.createDataFrame([("d", 1, k, 1, t, False, False) for k, t in enumerate(texts)], "document_id string, version int, line_no int, page int, text string, is_ocr boolean, is_heading boolean")
    files = spark.createDataFrame([("d", 1, "a.pdf"), ("e", 1, "empty.pdf")], "document_id string, version int, filename string")
    documents, parsed, _ = P.parse(lines, files)
    got = {r["document_id"]: r for r in documents.collect()}
    d = got["d"]
    assert (d["kind"], d["lender_class"], d["borrower_type"], d["loan_type"], d["agreement_date"]) == ("loan_agreement", "housing_finance_company", "individual", "home", dt.date(2024, 3, 3))
    assert got["e"]["n_clauses"] == 0 and got["e"]["title"] == "empty.pdf"
    text = " ".join(r["text"] for r in parsed.orderBy("ordinal").collect())
    assert all(t.split()[-1] in text for t in texts[1:]) and G.DOC[0] in parsed.columns
    assert '"clauses":[{"ordinal":0' in P.as_json(documents.where("document_id = 'd'"), parsed).first()["json"]


def test_goldset(spark, tmp_path):
    import json

    cases = [{"id": "a", "expect_clauses": ["2.1"], "expect_corpus": ["R/1"], "require_corpus_rank": 2}, {"id": "b", "expect_insufficient": True}, {"id": "c", "must_not_contain": ["4 percent"]}]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, cases)))
    p = spark.createDataFrame([("a", 1, "2.1", None, "x"), ("a", 2, None, "R/1", "y"), ("c", 1, "2.1", None, "is 4 percent")], "query_id string, rank int, clause_number string, corpus_id string, text string")
    o = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.9)], "query_id string, confidence double")
    scored = P.score_goldset(P.read_goldset(spark, str(tmp_path / "g.jsonl")), p, o)
    assert {r["id"]: r["passed"] for r in scored.collect()} == {"a": True, "b": True, "c": False}
    whole = P.summarize_goldset(scored.withColumn("_no", F.col("id") == "b")).first()
    assert (whole["cases"], whole["answerable"], whole["corpus_found"], whole["unanswerable"], whole["refusals"], whole["passed"]) == (3, 2, 2, 1, 1, 2)


def test_latest_version_is_the_default(spark, engine):
    got = engine.retrieve(ask(spark, (Q, "loan", None, None, None, None, None))).collect()
    assert {r["version"] for r in got} == {2} and not any("4 percent" in r["text"] for r in got)
    assert got[0]["considered"] == 3 and got[0]["filtered_out"] == 0
    listed = engine.list_documents().where("document_id = 'loan'").first()
    assert (listed["version"], listed["versions"], listed["n_clauses"]) == (2, [1, 2], 3)
    assert [r["number"] for r in engine.list_clauses("loan").collect()] == ["1.1", "2.1", "3.1"] and engine.list_clauses("loan", 1).first()["version"] == 1


def test_whole_index_without_a_document(spark, engine):
    got = engine.retrieve(ask(spark, (Q, None, None, None, None, None, None))).collect()
    assert {r["document_id"] for r in got} >= {"loan", "rule-a"}


def test_vectors_of_another_dimension_are_skipped(spark, engine):
    from pyspark.sql import functions as F

    short = Engine(spark, engine.root, provider=lambda rows, key: rows.select(key, F.array(F.lit(1.0).cast("float")).alias("vector")))
    assert short.retrieve(ask(spark, (Q, "loan", 2, None, None, None, None))).count() == 0


def test_topics_and_coverage_come_from_the_manifest(spark, tmp_path):
    e = Engine(spark, str(tmp_path), threshold=0.1)
    e.ingest(clauses(spark, 1, V1), spark.createDataFrame([("loan", 1, "Loan", dt.date(2025, 3, 1))], "document_id string, version int, title string, agreement_date date"))
    app = ([], [], [], [], None, None)
    repeal = (dt.date(2026, 1, 1), ["old"], None, ["prepayment"])
    manifest = spark.createDataFrame(
        [("r1", "One", "R/1", None, app, ["lock in of deposits"], repeal), ("r2", "Two", "R/2", None, app, ["prepayment penalty of floating loans"], None)],
        "id string, title string, reference string, source_url string, applicability struct<loan_types:array<string>,borrower_types:array<string>,lender_classes:array<string>,purposes:array<string>,effective_from:date,effective_to:date>,"
        " topics array<string>, repeals struct<effective_from:date,circulars:array<string>,note:string,subject_keywords:array<string>>",
    )
    body = "The same words about a prepayment penalty stand in this rule."
    e.ingest_corpus(clauses(spark, 1, [("1", body)], "r1").unionByName(clauses(spark, 1, [("1", body + " Then")], "r2")), manifest)
    q = ask(spark, ("What prepayment penalty is allowed?", "loan", None, None, None, None, None), ("Who insures the mortgaged property at own expense?", "loan", None, None, None, None, None))
    rows = {r["document_id"]: r["bonus"] for r in e.retrieve_for_answer(q).where("query_id = 0 AND source_kind = 'corpus'").collect()}
    assert rows["r2"] > rows["r1"]
    out = e.answer(q, writer=lambda p: p.select("query_id", F.when(F.col("query_id") == 1, "A prepayment penalty of 99 percent applies to floating loans [1].").alias("text")))
    events = {k: [r["event"] for r in out["events"].where(f"query_id = {k}").orderBy("seq").collect()] for k in (0, 1)}
    assert events[0] == ["meta", "coverage", "citations", "degraded", "delta", "verified", "done"]
    assert events[1] == ["meta", "citations", "delta", "verified", "done"]
    assert "2026-01-01" in out["coverage"].first()["payload"]
    assert out["answers"].where("answer_id = 1").first()["stripped"] == 1


def test_uploads(spark, tmp_path):
    """A file held is not stored again, an amendment is resolved against the document's
    latest version, and one without a base is refused."""
    base = ["LOAN AGREEMENT", "Loan account no. AB-1234/9.", "1.1 The borrower repays in sixty instalments by transfer.", "1.2 The rate is nine percent for the whole of the term.", "1.3 A lock-in of twelve months applies to the loan."]
    change = ["LOAN AGREEMENT, REVISED - VERSION 2", "Loan account no. AB-1234/9, under the original agreement.", "1.2 The rate is eight percent for the whole of the term.", "1.4 Clause 1.3 is hereby deleted.", "1.5 All other provisions of the agreement remain unchanged."]
    e = Engine(spark, str(tmp_path))

    def upload(name, texts):
        lines = spark.createDataFrame([(name, 1, k, 1, t, False, False) for k, t in enumerate(texts)], "document_id string, version int, line_no int, page int, text string, is_ocr boolean, is_heading boolean")
        documents, parsed, warnings = P.parse(lines, spark.createDataFrame([(name, 1, name + ".pdf")], "document_id string, version int, filename string"))
        return [(r["document_id"], r["version"], r["status"]) for r in e.upload(documents, parsed.withColumn("page_start", F.lit(1))).collect()], {w["code"] for w in warnings.collect()}

    with pytest.raises(Exception, match="without a base"):
        upload("b", change)
    assert upload("a", base)[0] == [("loan-AB-1234-9", 1, "stored")]
    done, codes = upload("b", change)
    assert done == [("loan-AB-1234-9", 2, "stored")] and "amendment_detected" in codes
    assert upload("again", base)[0] == [("loan-AB-1234-9", 1, "held")]
    texts = [r["text"] for r in e.list_clauses("loan-AB-1234-9").collect()]
    assert any("eight" in t for t in texts) and any("sixty" in t for t in texts) and not any("lock-in" in t or "nine" in t for t in texts)
    latest = e.list_documents().first()
    assert (latest["kind"], latest["versions"]) == ("amendment", [1, 2])


def test_evaluate(spark, engine):
    cases = spark.createDataFrame([("x", Q, "loan", 2, ["2.1"], None, None, None, None), ("y", "Who won the football match?", "loan", 2, None, None, None, True, None)], "id string, question string, document_id string, version int, expect_clauses array<string>, expect_corpus array<string>, require_corpus_rank int, expect_insufficient boolean, must_not_contain array<string>")
    got = {r["mode"]: r for r in engine.evaluate(cases).collect()}
    assert set(got) == {"dense-only", "hybrid"} and all(r["clause_recall"] == 1 and r["refusals"] == 1 and r["passed"] == 2 for r in got.values())


def test_human_summary(spark):
    from quernstone.engine import human_summary

    d = spark.createDataFrame([("d", 1, "Loan", "loan_agreement")], "document_id string, version int, title string, kind string")
    c = spark.createDataFrame([("d", 1, 1, None, None, "text of one"), ("d", 1, 0, "1.1", "Rates", "x")], "document_id string, version int, ordinal int, number string, heading string, text string")
    assert human_summary(d, c).first()["summary"] == "Document: Loan\nType: loan agreement\nVersion: 1\n[1.1] Rates\n[-] text of one"


def test_files_to_versions(spark, tmp_path):
    """From DOCX files to the clauses in force: an agreement, its amendment, and a question."""
    from quernstone.sources import files, sample

    e = Engine(spark, str(tmp_path / "store"), threshold=0.05)
    statuses = []
    for name, blocks in (("a", sample.agreement_blocks()), ("b", sample.amendment_blocks())):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.docx").write_bytes(sample.docx_bytes(blocks))
        found = files.read_files(spark, str(tmp_path / name))
        lines, warnings = files.parse_docx(found)
        assert warnings.isEmpty()
        documents, parsed, _ = P.parse(lines, found.select("document_id", F.lit(1).alias("version"), "filename"))
        kind = documents.first()["kind"]
        statuses.append((kind, *e.upload(documents, parsed).select("document_id", "version", "status").first()))
    assert statuses == [("loan_agreement", "loan-SMP-HL-0001234", 1, "stored"), ("amendment", "loan-SMP-HL-0001234", 2, "stored")]
    v1, v2 = ({r["number"]: r["text"] for r in e.list_clauses("loan-SMP-HL-0001234", v).collect() if r["number"]} for v in (1, 2))
    assert {"11.2", "11.4", "11.5"} <= set(v1) and not {"11.2", "11.4", "11.5"} & set(v2)
    assert "8.60%" in v2["3.1"] and "1.5%" in v2["9.1"] and "No charge" in v2["11.3"]
    assert all(v1[n] == v2[n] for n in ("3.2", "6.1", "6.2", "6.3", "7.1", "7.2", "9.2", "12.1"))
    chunks = e.table("chunks")
    shared = chunks.where("version = 1").select("content_hash").intersect(chunks.where("version = 2").select("content_hash")).count()
    assert shared > 0.7 * chunks.where("version = 2").count()
    out = e.answer(ask(spark, ("What is the penal charge on overdue amounts?", "loan-SMP-HL-0001234", None, None, None, None, None)))
    text = out["answers"].first()["text"]
    assert "1.5%" in text and "2% a month" not in text
