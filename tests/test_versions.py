import pytest
from pyspark.sql import functions as F

from quernstone.operators import applicability as A
from quernstone.operators import store as S
from quernstone.operators import versions as V

CLAUSE = "document_id string, version int, ordinal int, number string, text string, content_hash string"


def clauses(spark, version, *rows):
    return spark.createDataFrame([("d", version, k, n, t, "h:" + t) for k, (n, t) in enumerate(rows)], CLAUSE)


def resolved(spark):
    base = clauses(spark, 1, ("3.1", "rate nine"), ("6.1", "six"), ("9.2", "the ninth"), ("11.2", "eleven two"), ("11.4", "eleven four"), ("11.5", "eleven five"), ("11.10", "eleven ten"), (None, "annex"))
    change = clauses(
        spark, 2, ("3.1", "rate ten"), ("9.2", "All other terms remain unchanged."), ("11.2", "Clause 11.2 is deleted."), ("11.3", "New rule. Clauses 11.4 and 11.5 stand deleted; they are superseded."), ("12.1", "twelve"),
    )
    return base, V.resolve_amendment(base, change)


def test_amendment(spark):
    _, out = resolved(spark)
    rows = out.collect()
    live = sorted((r["ordinal"], r["number"], r["operation"]) for r in rows if r["operation"] != "deleted")
    assert [(n, o) for _, n, o in live] == [
        ("3.1", "replaced"), ("6.1", "carried_forward"), ("9.2", "carried_forward"), ("11.3", "added"), ("11.10", "carried_forward"), ("12.1", "added"), (None, "carried_forward"),
    ]
    assert sorted(r["number"] for r in rows if r["operation"] == "deleted") == ["11.2", "11.4", "11.5"]
    kept = {r["number"]: r for r in rows if r["ordinal"] is not None}
    assert kept["9.2"]["text"] == "the ninth" and kept["3.1"]["previous_hash"] == "h:rate nine" and kept["3.1"]["clause_id"] == "d-v2-c0000"
    assert {r["content_hash"] for r in V.embedding_required(out).collect()} == {"h:rate ten", "h:twelve", "h:New rule. Clauses 11.4 and 11.5 stand deleted; they are superseded."}


def test_partial_restatement_keeps_the_original(spark):
    base = clauses(spark, 1, ("5", "whole fee table"), ("6", "six"))
    out = V.resolve_amendment(base, clauses(spark, 2, ("5", "Only the rows changed are shown: fee 3."))).where("operation <> 'deleted'")
    assert sorted((r["number"], r["operation"]) for r in out.collect()) == [("5", "carried_forward"), ("5", "replaced"), ("6", "carried_forward")]


def test_what_the_amendment_says_as_a_whole(spark):
    """A deletion that another clause names holds for a clause that is reprinted."""
    base = clauses(spark, 1, ("3.1", "rate nine"), ("4", "four"), ("9", "nine"))
    change = clauses(spark, 2, ("3.1", "rate nine, as it was"), ("9", "Clause 3.1 is deleted."), ("4", "Clause 4 is hereby deleted and replaced as follows: new four."), ("7", "All other terms remain unchanged."))
    out = V.resolve_amendment(base, change).collect()
    assert {(r["number"], r["operation"], r["previous_hash"]) for r in out if r["operation"] in ("deleted", "replaced")} == {
        ("3.1", "deleted", "h:rate nine"), ("9", "replaced", "h:nine"), ("4", "replaced", "h:four"),
    }
    assert not [r for r in out if r["number"] == "7"] and [r["content_hash"] for r in out if r["operation"] == "deleted"] == [None]
    assert [r["numbers"] for r in V.partial_notes(change).collect()] == [["7"]]
    assert V.reused(V.resolve_amendment(base, change)).count() == 0


def test_chain(spark):
    base = clauses(spark, 1, ("1", "one"), ("2", "two"))
    out = V.resolve_chain(base, [clauses(spark, 2, ("2", "two b")), clauses(spark, 3, ("1", "Clause 1 is deleted."), ("3", "three"))], lambda d: d.checkpoint())
    assert sorted((r["number"], r["text"], r["version"]) for r in out.where("operation <> 'deleted'").collect()) == [("2", "two b", 3), ("3", "three", 3)]


def test_diff(spark):
    a, b = clauses(spark, 1, ("1", "x"), ("2", "y")), clauses(spark, 2, ("1", "x"), ("2", "z"))
    assert {(r["content_hash"], r["side"]) for r in V.diff(a, b, ["document_id"]).collect()} == {("h:x", "unchanged"), ("h:y", "removed"), ("h:z", "added")}
    assert V.diff(a, a, ["document_id"]).where("side <> 'unchanged'").count() == 0


def test_next_version_and_guard(spark):
    held = clauses(spark, 4, ("1", "x"))
    new = spark.createDataFrame([("d",), ("e",)], "document_id string")
    assert {r["document_id"]: r["next_version"] for r in V.next_version(held, new).collect()} == {"d": 5, "e": 1}
    assert V.require_base(held, held).count() == 1
    with pytest.raises(Exception, match="without a base"):
        V.require_base(new, held).collect()


CHUNK = "chunk_id string, document_id string, version int, clause_id string, text string, content_hash string, citation struct<chunk_id:string,document_id:string,version:int>, source_kind string"


def chunk(i, h, text="t", kind="user_document"):
    return (i, "d", 1, i, text, h, (i, "d", 1), kind)


def test_stores(spark):
    c = spark.createDataFrame([chunk("a", "h1"), chunk("b", "h1"), chunk("c", "h2")], CHUNK)
    e = spark.createDataFrame([("h2", [1.0])], "content_hash string, vector array<float>")
    need = S.new_hashes(c, e)
    assert [(r["chunk_id"], r["content_hash"]) for r in need.collect()] == [("a", "h1")]
    assert tuple(S.reuse(c, need).first())[:3] == (3, 1, 2)
    assert tuple(S.stats(c).first()) == (3, 2, 1)
    v = spark.createDataFrame([("h1", [1.0]), ("h1", [1.0]), ("h2", [2.0]), ("h3", None)], "content_hash string, vector array<float>")
    assert [r["content_hash"] for r in S.insert_embeddings(e, v).collect()] == ["h1"]


def test_upsert_changes_only_what_may_change(spark):
    c = spark.createDataFrame([chunk("a", "h1", "old")], CHUNK)
    n = spark.createDataFrame([chunk("a", "h9", "new", "corpus"), chunk("b", "h2", "b", "corpus")], CHUNK)
    got = {r["chunk_id"]: (r["text"], r["content_hash"], r["source_kind"]) for r in S.upsert_chunks(c, n).collect()}
    assert got == {"a": ("new", "h9", "user_document"), "b": ("b", "h2", "corpus")}
    assert S.upsert_chunks(c, n, refresh=True).where("chunk_id = 'a'").first()["source_kind"] == "corpus"


def test_pointer_is_idempotent(spark):
    c = spark.createDataFrame([chunk("a", "h1")], CHUNK)
    p = S.point_to_version(c, "d", 2)
    assert tuple(p.first()["citation"]) == ("d-v2-a", "d", 2)
    assert S.point_to_version(c.unionByName(p), "d", 2, ["a"]).count() == 0


def test_documents(spark):
    d = spark.createDataFrame([("d", 1, "x", 3), ("d", 2, "y", 2), ("e", 1, "z", 1)], "document_id string, version int, title string, uploaded_at int")
    assert {r["document_id"]: r["title"] for r in S.latest(d).collect()} == {"d": "y", "e": "z"}
    assert [r["title"] for r in S.latest_uploads(d).collect()] == ["x", "z"]
    n = spark.createDataFrame([("d", 1, "new", 9)], d.schema)
    assert sorted(r["title"] for r in S.merge_documents(d, n).collect()) == ["new", "y", "z"]


def test_same_clauses(spark):
    up = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "a")], "upload_id string, content_hash string")
    held = spark.createDataFrame([("d", 1, "b"), ("d", 1, "a"), ("d", 1, "a"), ("d", 2, "a"), ("d", 2, "c")], "document_id string, version int, content_hash string")
    assert [tuple(r) for r in S.same_clauses(up, held).collect()] == [("u", "d", 1)]


@pytest.mark.parametrize(("value", "axis", "fits"), [("x", ["x"], True), ("x", ["y"], False), (None, ["y"], True), ("x", [], True), ("x", None, True)])
def test_axis(spark, value, axis, fits):
    df = spark.createDataFrame([(value, axis)], "v string, a array<string>")
    assert df.select(A.axis_allows(F.col("v"), F.col("a"))).first()[0] is fits


def test_interval_bounds(spark):
    df = spark.sql("SELECT * FROM VALUES ('2025-12-31'), ('2026-01-01'), ('2026-06-30'), ('2026-07-01'), (NULL) AS t(d)")
    got = [r[0] for r in df.select(A.in_force(F.col("d").cast("date"), F.lit("2026-01-01").cast("date"), F.lit("2026-06-30").cast("date"))).collect()]
    assert got == [False, True, True, False, True]


def test_coverage_is_strict(spark):
    q = spark.sql("SELECT * FROM VALUES (1, 'On PREPAYMENT charges', DATE'2025-11-18'), (2, 'prepayment', DATE'2026-01-01'), (3, 'prepayment', NULL), (4, 'rates', DATE'2025-01-01') AS t(query_id, question, loan_date)")
    r = spark.sql("SELECT DATE'2026-01-01' AS effective_from, array('prepayment') AS subject_keywords, 'New rules' AS title")
    rows = A.coverage_gaps(q, r).collect()
    assert [x["query_id"] for x in rows] == [1] and "1 January 2026" in rows[0]["message"]
