import pytest
from pyspark.sql import functions as F

from quernstone.operators import answer as N
from quernstone.operators import embed as E
from quernstone.operators import retrieve as R


def test_cosine_and_dimensions(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<float>")
    s = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0])], "chunk_id bigint, v array<float>")
    assert [(r["chunk_id"], r["dense"]) for r in R.dense_topk(q, s, 5).orderBy("rank").collect()] == [(1, 1.0), (4, 0.7071), (2, 0.0)]


def test_bm25_of_candidates(spark):
    import math

    q = spark.createDataFrame([(1, "charge charge penalty")], "query_id int, question string")
    c = spark.createDataFrame([(1, 1, "charge applies"), (1, 2, "penalty charge charge"), (1, 3, "nothing here now")], "query_id int, chunk_id bigint, text string")
    got = {r["chunk_id"]: r["bm25"] for r in R.bm25(q, c).collect()}
    idf = lambda n: math.log(1 + (3 - n + 0.5) / (n + 0.5))
    part = lambda tf, n, dl: idf(n) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (8 / 3)))
    assert got == {1: pytest.approx(2 * part(1, 2, 2), abs=1e-4), 2: pytest.approx(2 * part(2, 2, 3) + part(1, 1, 3), abs=1e-4)}


def test_greedy_is_against_what_was_kept(spark):
    """A~B and B~C but not A~C: B goes, C stays."""
    words = [f"w{k}" for k in range(60)]
    a, b, c = words[:50], words[2:52], words[4:54]
    rows = [(1, k + 1, k, " ".join(t)) for k, t in enumerate((a, b, c))]
    df = spark.createDataFrame(rows, "query_id int, rank int, chunk_id bigint, text string")
    assert [r["chunk_id"] for r in R.drop_near_duplicates(df, 8).orderBy("place").collect()] == [0, 2]
    assert R.drop_near_duplicates(df, 1).count() == 1


def test_reserved_places(spark):
    rows = [(1, k, "corpus", 1.0 - k / 100) for k in range(10)] + [(1, 100 + k, "user_document", 0.1 - k / 100) for k in range(6)]
    got = [r["chunk_id"] for r in R.reserved_merge(spark.createDataFrame(rows, "query_id int, chunk_id bigint, source_kind string, fused double"), 8).orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 100, 101, 102, 103]


@pytest.mark.parametrize(("passages", "outcome"), [([(0.81, "user_document")], "answer"), ([(0.7199, "user_document")], "insufficient_evidence"), ([(0.72, "user_document")], "answer"), ([], "nothing_retrieved"), ([(0.85, "corpus")], "insufficient_evidence")])
def test_gate(spark, passages, outcome):
    q = spark.createDataFrame([(1,)], "query_id int")
    p = spark.createDataFrame([(1, *x) for x in passages], "query_id int, dense double, source_kind string")
    assert R.gate(q, p).first()["outcome"] == outcome


def test_scopes_reach_the_scan(spark, tmp_path):
    """The version is a predicate of the scan, and only the columns needed are read."""
    from quernstone.operators import store as S

    rows = [("a", "d", 1, "h", "t", "x"), ("b", "d", 2, "h", "t", "x")]
    spark.createDataFrame(rows, "chunk_id string, document_id string, version int, content_hash string, text string, source_kind string").write.parquet(str(tmp_path / "c"))
    e = spark.createDataFrame([("h", 1)], "content_hash string, v int")
    out = S.search_scope(spark.read.parquet(str(tmp_path / "c")), e, "d", 2).select("chunk_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(version,2)" in plan and "text" not in plan.split("ReadSchema")[1] and [r[0] for r in out.collect()] == ["b"]


def test_scoring_has_no_python(spark):
    from quernstone.plans import retrieval

    plan = retrieval.hybrid_answer(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("ArrowEvalPython", "Python") or "nfkc" in plan


def test_hashing_embedding(spark):
    df = spark.createDataFrame([(1, "penal charges on loan"), (2, "penal charges on loan"), (3, "the of")], "id int, text string")
    got = {r["id"]: r["vector"] for r in E.hashing_embedding(df, "id", 64).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and not any(got[3])
    with pytest.raises(E.ProviderUnavailable):
        E.PROVIDERS["local"](df, "id")


# --- answers


def check(spark, text, question=""):
    passages = [(1, 1, "A prepayment penalty of 12 percent applies to the outstanding principal for floating rate loans."), (1, 2, "The borrower shall insure the mortgaged property at own expense.")]
    a = spark.createDataFrame([(1, question, text)], "answer_id int, question string, text string")
    p = spark.createDataFrame(passages, "answer_id int, n int, text string")
    r = N.verify(a, p).first()
    return r["kept"], r["reason"]


def test_verification(spark):
    good = "A prepayment penalty of 12 percent applies to floating rate loans [1]."
    assert check(spark, good) == (True, "")
    assert check(spark, good.replace("12", "18")) == (False, "states a figure its source does not contain: 18")
    assert check(spark, good.replace("12", "18"), "Is it 18 percent?")[0]
    assert check(spark, good.replace(" [1]", "")) == (False, "no citation")
    assert check(spark, good.replace("[1]", "[99]")) == (False, "citation points at nothing")
    assert not check(spark, good.replace("[1]", "[2]"))[0]
    assert check(spark, "In short, a lender decides upon everything without citation.")[0]


def test_claims(spark):
    said = {"A loan is money lent.": None, "The RBI caps it.": "regulatory claim", "Your loan costs more.": "claim about the borrower's document", "Lenders must tell you.": "statement of obligation or permission", "It is 3 percent.": "specific figure"}
    df = spark.createDataFrame([(1, " ".join(said))], "id int, text string")
    assert {r["sentence"]: r["label"] for r in N.filter_claims(df, "id").collect()} == said


def test_glossary_passes_its_own_filter(spark):
    df = spark.createDataFrame([(1, " ".join(says for _, says in N.GLOSSARY))], "id int, text string")
    assert N.filter_claims(df, "id").where("label IS NOT NULL").count() == 0
    q = spark.createDataFrame([(1, "What is principal, tenure, default and collateral?"), (2, "?")], "query_id int, question string")
    got = {r["query_id"]: r for r in N.fallback(q).collect()}
    assert got[1]["explanation"].count(".") == 3 and got[2]["explanation"] == N.NO_TERM


def test_event_order(spark):
    g = spark.createDataFrame([(1, "answer", 0.8), (2, "insufficient_evidence", 0.1)], "query_id int, outcome string, confidence double")
    p = lambda t: spark.createDataFrame([(1, t), (2, t)], "query_id int, payload string")
    rows = N.events(g, p("gap"), p("cites"), p("text").withColumn("verified", F.lit("v")), p("fall")).orderBy("query_id", "seq").collect()
    assert [r["event"] for r in rows if r["query_id"] == 1] == ["meta", "coverage", "citations", "delta", "verified", "done"]
    assert [r["event"] for r in rows if r["query_id"] == 2] == ["meta", "fallback", "done"]
