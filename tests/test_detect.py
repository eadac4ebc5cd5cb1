import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quernstone.operators import detect as D
from quernstone.operators import versions as V
from quernstone.sources import files, manifest
from quernstone.streaming import ingest


def one(spark, text, make):
    return spark.createDataFrame([(1, text)], "id int, text string").select(make(F.col("text"))).first()[0]


def test_kind(spark):
    assert one(spark, "LOAN AGREEMENT between", D.detect_kind) == "loan_agreement"
    assert one(spark, "Notification about a loan agreement", D.detect_kind) == "rbi_circular"
    assert one(spark, "Ref. RBI/2025-26/64 of the bank", D.detect_kind) == "rbi_circular"
    assert one(spark, "x" * 800 + " key fact statement", D.detect_kind) == "key_facts_statement"
    assert one(spark, "x" * 800 + " RBI/2025-26/64 loan agreement", D.detect_kind) == "loan_agreement"
    assert one(spark, "no marks", D.detect_kind) == "unknown"
    assert one(spark, "loan agreement", lambda t: D.detect_kind(t, F.lit("unknown"))) == "loan_agreement"
    assert one(spark, "loan agreement", lambda t: D.detect_kind(t, F.lit("hinted"))) == "hinted"


def kinds(spark, text, detect, column):
    r = detect(spark.createDataFrame([(1, text)], "id int, text string"), "id").first()
    return r and r[column]


def test_loan_type(spark):
    loan = lambda t: kinds(spark, t, D.detect_loan_type, "loan_type")
    assert loan("A personal loan and a home loan.") is None
    assert loan("home loan " * 4 + "x" * 700 + " personal loan") == "home"
    assert loan("x" * 800 + " home loan home loan home loan; car loan") == "home"
    assert loan("as the circular on the home loan says") is None


def test_lender_and_borrower(spark):
    text = "Alpha Housing Finance Limited, a private limited company (the lender) lends to Asha, an individual (the borrower)."
    assert one(spark, text, D.detect_lender_class) == "housing_finance_company"
    assert kinds(spark, text, D.detect_borrower_type, "borrower_type") == "individual"
    classes = {"an NBFC-MFI": "nbfc_mfi", "the NBFC": "nbfc", "Small Finance Bank, an nbfc": "nbfc", "Gramin Bank": "regional_rural_bank", "a plain bank": None}
    assert [one(spark, t, D.detect_lender_class) for t in classes] == list(classes.values())
    who = {"Mr. Rao, the co-borrower": "individual", "XYZ LLP with GSTIN (the Borrower)": "business", "Shri Rao of Rao Pvt Ltd (the borrower)": None, "Shri Rao": None}
    assert [kinds(spark, t, D.detect_borrower_type, "borrower_type") for t in who] == list(who.values())


@pytest.mark.parametrize(("text", "day"), [("dated 3rd March 2024", dt.date(2024, 3, 3)), ("March 3, 2024", dt.date(2024, 3, 3)), ("on 03/04/2024", dt.date(2024, 4, 3)), ("31/02/2024", None), ("under the circular of 1 May 2020, and " + "as both sides say " * 6 + "agreed on 2 June 2021", dt.date(2021, 6, 2)), ("none", None),
    ("the circular of 2 May 2020, " + "as both sides say " * 6 + "the day being 2 May 2020", dt.date(2020, 5, 2)), ("on 07/08/2021 or 3 May 2020", dt.date(2020, 5, 3)), ("x" * 2600 + " 1 May 2020" + "y" * 1300, None), ("x" * 2600 + " 1 May 2020", dt.date(2020, 5, 1))])
def test_agreement_date(spark, text, day):
    assert one(spark, text, D.detect_agreement_date) == day


def test_amendment(spark):
    text = "Amendment agreement. Loan account no. AB-1234/9. The original agreement dated 1 January 2023 stands revised with effect from 5 May 2024."
    got = one(spark, text, lambda t: D.detect_amendment(t, F.lit("loan_agreement")))
    assert (got["loan_account_number"], got["base_dated"], got["effective_from"]) == ("AB-1234/9", dt.date(2023, 1, 1), dt.date(2024, 5, 5))
    assert got["evidence"] == ["names a base agreement", "stands revised"]
    assert one(spark, text, lambda t: D.detect_amendment(t, F.lit("rbi_circular"))) is None
    assert one(spark, "First of all, the second floor.", D.amendment_evidence) == []
    assert one(spark, "the original agreement and the Original Agreement", lambda t: D.detect_amendment(t, F.lit("loan_agreement"))) is None
    cues = {
        "Save as expressly revised": "carry-forward clause", "all terms continue in full force": "carry-forward clause", "terms remain unchanged": "carry-forward clause",
        "are not restated in this document": "not restated", "summary of revision": "revision summary", "This revises clause 4": "per-clause revision", "REVISED - VERSION 2": "version marker", "clause 9 stands revised": "stands revised",
    }
    assert [one(spark, t, D.amendment_evidence) for t in cues] == [[v] for v in cues.values()]
    assert one(spark, text, lambda t: D.document_key(t, F.lit("x.pdf"))) == "loan-AB-1234-9"
    assert one(spark, "none", lambda t: D.document_key(t, F.lit("My File.v2.pdf"))) == "doc-my-file-v2"


def test_deleted_numbers(spark):
    assert one(spark, "Clauses 11.4, 11.5 and 12 stand deleted. Clause 3 stays.", V.deleted_numbers) == ["11.4", "11.5", "12"]
    said = {"Clause 2 is hereby superseded": ["2"], "clauses 3 & 4.1 are of no further effect; clause 5 is not": ["3", "4.1"], "Clause 6 shall be deleted.": [], "Clause 7 stands withdrawn": ["7"]}
    assert [one(spark, t, V.deleted_numbers) for t in said] == list(said.values())
    assert one(spark, "All other provisions of Clause 9 remain unchanged.", V.is_carry_forward) and not one(spark, "The rest remains in force.", V.is_carry_forward)
    assert one(spark, "Only the rows revised appear.", V.is_partial_restatement) and not one(spark, "Only the following rows change.", V.is_partial_restatement)
    assert one(spark, "deleted and replaced as follows: none", V.replaces_as_well) and not one(spark, "is replaced", V.replaces_as_well)


# --- sources


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    p = lambda t, s="": f'<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Title", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + p("one") + '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + f"<w:tbl><w:tr>{cell('a')}{cell('a')}{cell('b')}</w:tr></w:tbl>" + p("end")
    (tmp_path / "good.docx").write_bytes(docx(body))
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    found = files.read_files(spark, str(tmp_path))
    assert {r["media_type"] for r in found.select("media_type").collect()} == {files.DOCX}
    lines, warnings = files.parse_docx(found)
    assert [(r["page"], r["text"], r["is_heading"]) for r in lines.orderBy("line_no").collect()] == [(1, "Title", True), (1, "one", False), (1, "", False), (2, "a | b", False), (2, "", False), (2, "end", False)]
    assert [r["code"] for r in warnings.collect()] == ["unreadable_document"]


def test_parser_choice(spark):
    df = spark.createDataFrame([("application/pdf", "x"), ("x", "a.DOCX")], "m string, f string")
    assert [r[0] for r in df.select(files.select_parser(F.col("m"), F.col("f"))).collect()] == ["pdf", "docx"]
    with pytest.raises(Exception, match="no parser for"):
        spark.createDataFrame([("x", "a.txt")], "m string, f string").select(files.select_parser(F.col("m"), F.col("f"))).collect()


def test_pages_and_ocr(spark):
    rows = [("d", 1, 1, "a page with enough text on it to be taken\nas it is", None), ("d", 1, 2, "thin", None), ("d", 1, 3, None, "broken")]
    pages = spark.createDataFrame(rows, "document_id string, version int, page int, text string, error string")
    lines, warnings = files.page_lines(pages)
    assert [r["text"] for r in lines.orderBy("line_no").collect()] == ["a page with enough text on it to be taken", "as it is", "", "thin", ""]
    assert sorted(r["code"] for r in warnings.collect()) == ["ocr_disabled", "page_unreadable"]
    lines, warnings = files.page_lines(pages, lambda d: d.withColumn("text", F.lit("read by ocr")))
    assert [r["is_ocr"] for r in lines.where("page = 2").collect()] == [True, True]
    assert [r["code"] for r in files.page_lines(pages, lambda d: d.withColumn("text", F.lit(" ")))[1].where("page = 2").collect()] == ["ocr_empty"]


def test_manifest(spark, tmp_path):
    import json

    good = {"id": "a", "file": "a.pdf", "title": "A", "source_url_status": "not found", "applicability": {"loan_types": ["home"], "effective_from": "2024-04-01"}}
    write = lambda *ds: (tmp_path / "m.json").write_text(json.dumps({"documents": ds}))
    write(good)
    assert manifest.read_manifest(spark, str(tmp_path / "m.json")).first()["applicability"]["effective_from"] == dt.date(2024, 4, 1)
    for bad in ({"source_url": "http://x"}, {"source_url_status": None}, {"applicability": {"effective_from": "2024-04-01", "effective_to": "2024-01-01"}}):
        write(good | bad)
        with pytest.raises(Exception, match="manifest entry a"):
            manifest.read_manifest(spark, str(tmp_path / "m.json")).collect()
    write(good, good | {"file": "b.pdf"})
    with pytest.raises(Exception, match="not unique"):
        manifest.read_manifest(spark, str(tmp_path / "m.json")).collect()


def test_uploads_refused(spark):
    rows = [(b"", "a.pdf"), (None, "a.pdf"), (b"x", "a.txt"), (b"x", "A.DOCX"), (b"x", None), (b"x" * (20 * 1024 * 1024 + 1), "a.txt")]
    df = spark.createDataFrame(rows, "c binary, f string")
    assert [r[0] for r in df.select(files.upload_status(F.col("c"), F.col("f"))).collect()] == [400, 400, 415, 200, 415, 413]


def test_amended_by(spark):
    rows = [("a", None, "c"), ("b", "a", None), ("c", "a", None), ("d", "z", None)]
    df = spark.createDataFrame(rows, "id string, amends string, amended_by string")
    assert sorted(map(tuple, manifest.amendments(df).collect())) == [("a", "b"), ("a", "c")]


def test_ingest_twice_changes_nothing(spark, tmp_path):
    schema = "chunk_id string, content_hash string, text string"
    spark.createDataFrame([("a", "h1", "one"), ("b", "h1", "one"), ("c", "h2", "two")], schema).write.parquet(str(tmp_path / "in"))
    for turn in "12":
        ingest.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / f"ck{turn}"))
        assert tuple(ingest.stats(spark, str(tmp_path / "out")).first()) == (3, 2)
