from pyspark.sql import functions as F

from quernstone.operators import chunk as C
from quernstone.operators import segment as G
from quernstone.plans import documents

LINES = "document_id string, version int, line_no int, page int, text string, is_ocr boolean, is_heading boolean"


def lines(spark, *texts, page=lambda k: 1, doc="d"):
    return spark.createDataFrame([(doc, 1, k, page(k), t, False, False) for k, t in enumerate(texts)], LINES)


def clauses(df):
    return [(r["number"], r["heading"], r["text"]) for r in G.segment(df).orderBy("ordinal").collect()]


def test_titles_become_headings_of_their_clauses(spark):
    df = lines(spark, "1. REPAYMENT", "1.1 The borrower repays in instalments.", "1.2 Instalments are due monthly.", "2. CHARGES", "2.1 A charge of 2% applies.")
    got = clauses(df)
    assert [(n, h) for n, h, _ in got] == [("1.1", "REPAYMENT"), ("1.2", "REPAYMENT"), ("2.1", "CHARGES")]
    assert G.segment(df).first()["strategy"] == "clause_numbering"


def test_one_line_clauses_and_labels_stay(spark):
    got = clauses(lines(spark, "1. The loan is secured by property.", "2. Rate: 9 percent", "3. Fee: 500", "4. The lender may assign."))
    assert [n for n, _, _ in got] == ["1", "2", "3", "4"]


def test_bare_headings_in_a_row_join(spark):
    got = clauses(lines(spark, "1. GENERAL", "2. PAYMENT", "2.1 Pay monthly by transfer.", "2.2 Pay at the branch.", "2.3 Pay early if you like."))
    assert got[0][1] == "GENERAL / PAYMENT" and len(got) == 3


def test_preamble_and_bodies_are_kept(spark):
    got = clauses(lines(spark, "This agreement is made today.", "1. First clause runs on", "over two lines.", "2. Second clause text.", "3. Third clause text."))
    assert got[0][1:] == ("Preamble", "This agreement is made today.") and got[1][2] == "1. First clause runs on\nover two lines."


def test_fallbacks(spark):
    para = ["word " * 200, ""] * 4
    assert G.segment(lines(spark, *para)).first()["strategy"] == "paragraphs"
    df = lines(spark, "some plain text here.", "", "more of it on page two.", page=lambda k: 1 + k // 2)
    rows = G.segment(df).collect()
    assert {r["strategy"] for r in rows} == {"pages"} and len(rows) == 2 and rows[0]["notes"]


def test_running_headers(spark):
    texts = [t for p in range(3) for t in ("Alpha Finance", f"body {p} a", "shared middle", f"body {p} b", f"end {p} x", "Page footer")]
    df = lines(spark, *texts, page=lambda k: 1 + k // 6)
    left = [r["text"] for r in G.strip_running_headers(df).collect()]
    assert "Alpha Finance" not in left and "Page footer" not in left and left.count("shared middle") == 3
    one = lines(spark, "Alpha", "x")
    assert G.strip_running_headers(one).count() == 2


def test_warnings(spark):
    rows = [("d", 1, k, str(n), "x" * (5000 if k == 1 else 10), 2) for k, n in enumerate([1, 2, 3, 5, 8])]
    df = spark.createDataFrame(rows, "document_id string, version int, ordinal int, number string, text string, page_start int")
    got = {r["code"]: (r["page"], r["missing"]) for r in G.structural_warnings(df).collect()}
    assert got == {"oversized_clause": (2, None), "numbering_gap": (None, [4, 6, 7])}


def test_titles(spark):
    c = spark.createDataFrame([("d", 1, 0, "Preamble", "x"), ("d", 1, 1, None, "Home Loan Agreement\nmore"), ("e", 1, 0, "Index", "y")], "document_id string, version int, ordinal int, heading string, text string")
    n = spark.createDataFrame([("d", 1, "a.pdf"), ("e", 1, "b.pdf")], "document_id string, version int, filename string")
    assert {r["document_id"]: r["title"] for r in G.titles(c, n).collect()} == {"d": "Home Loan Agreement", "e": "b.pdf"}


def split(text):
    """split_text from its description."""
    import re

    if len(text) <= C.MOST:
        return [text]
    pieces = []
    for s in re.sub(r"([.;:])\s+", "\\1\x01", text).split("\x01"):
        while len(s) > C.MOST:
            k = next((k for k in range(C.MOST - 1, 0, -1) if s[k : k + 1].isspace()), C.MOST)
            pieces.append(s[:k])
            s = s[k:].lstrip() if k < C.MOST else s[k:]
        if s or not pieces:
            pieces.append(s)
    parts, cur = [], ""
    for p in pieces:
        if not cur or len(cur) + len(p) + 1 <= C.MOST:
            cur = f"{cur} {p}" if cur else p
        else:
            parts.append(cur)
            cur = cur[-C.OVERLAP :] + " " + p
    return [*parts, cur] if cur else parts


def test_split_text(spark):
    import random

    rng = random.Random(1)
    texts = [" ".join("w" * rng.randint(1, 12) + rng.choice(["", "", "", ".", ";"]) for _ in range(n)) for n in (5, 300, 700, 1500)] + ["x" * 4000, "long words " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", C.split_text(F.col("t")).alias("p")).collect():
        assert r["p"] == split(r["t"])


def test_chunks(spark):
    body = "A clause of enough length to be kept."
    rows = [("d", 1, 0, "d-v1-c0000", body, "h0"), ("d", 1, 1, "d-v1-c0001", "too short", "h1"), ("d", 1, 2, "d-v1-c0002", "Home | About us | Sitemap and more", "h2"), ("d", 1, 3, "d-v1-c0003", (body + " ") * 80, "h3")]
    df = spark.createDataFrame(rows, "document_id string, version int, ordinal int, clause_id string, text string, content_hash string")
    got = C.chunk_clauses(df).orderBy("ordinal").collect()
    assert got[0]["chunk_id"] == "d-v1-c0000" and got[0]["content_hash"] == "h0"
    assert [r["chunk_id"] for r in got[1:]] == ["d-v1-c0003-p0", "d-v1-c0003-p1"] and [r["ordinal"] for r in got] == [0, 1, 2] and got[1]["content_hash"].startswith("sha256:")
    assert tuple(C.report(df).first()) == (3, 1, 1, 1)


def test_pinned_summary_skips_what_is_unknown(spark):
    df = spark.createDataFrame([("d", 2, "Loan", None)], "document_id string, version int, title string, loan_type string")
    assert C.pinned_summary(df).first()["summary"] == "Document: Loan\nVersion: 2"


def test_paragraph_clauses_have_all_turns(spark):
    sf, want, turns = "/root/testdata/sf0.001", {}, {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").where("text IS NOT NULL").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    for conv, lines_ in turns.items():
        done, cur = [], None
        for _, t in sorted(lines_):
            if t.strip():
                cur = [*(cur or []), t]
            if cur and sum(map(len, cur)) >= G.PARAGRAPH:
                done, cur = [*done, cur], None
        done += [cur] if cur else []
        if done:
            want[conv] = (len(done), sum(len("\n".join(x).strip()) for x in done))
    assert {r["document_id"]: (r["clauses"], r["chars"]) for r in documents.paragraph_clauses(spark, sf).collect()} == want


def starts(spark, *texts):
    return [(r["is_start"], r["number"], r["start_heading"]) for r in G.find_starts(lines(spark, *texts)).orderBy("line_no").collect()]


def test_clause_starts(spark):
    got = starts(spark, "SCHEDULE OF CHARGES", "ANNEX II", "Part 3: Fees", "  12.3.1) Rate of interest", "7.5% per annum", "1,00,000 is due", "Section 21 of the Act " + "is long " * 15, "article 5", "4. FEES", "plain text")
    assert got == [
        (True, "SCHEDULE", "SCHEDULE OF CHARGES"), (True, "ANNEX II", "ANNEX II"), (True, "PART 3", "Part 3: Fees"), (True, "12.3.1", "Rate of interest"), (False, None, None), (False, None, None),
        (False, None, None), (True, "ARTICLE 5", "article 5"), (True, "4", "FEES"), (False, None, None),
    ]


def test_looks_like_heading(spark):
    said = {"7. DEFAULT": True, "SCHEDULE II": True, "3.1 Rate: 9": False, "Fees and charges": True, "ends here.": False, "Rate 9": False, "label: value": False, "label:": False, "": False, "one " * 13: False}
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(G.looks_like_heading(F.col("t"))).collect()] == list(said.values())


def walk(texts):
    """(strategy, numbers, headings, texts) of one page's lines, one after another."""
    import re

    number = re.compile(r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})[.)]?\s+([A-Za-z\"'(].*)$")
    word = re.compile(r"^((?:SCHEDULE|ANNEXURE|ANNEX|APPENDIX|PART|SECTION|ARTICLE|CLAUSE)(?:\s+[IVXLC0-9]+[A-Z]?)?)\b[:.\-\s]*(.*)$", re.I)

    def only_title(t):
        m, w = number.match(t), word.match(t)
        rest = m[2] if m else w[2] if w else t
        return bool(t) and t[-1] not in ".;:," and len(rest.split()) <= 12 and not re.search(r":\s*\S", rest) and not re.search("[0-9]", rest)

    parts, decimals = [[None, None, []]], 0
    for line in texts:
        t = line.strip()
        m, w = number.match(t), word.match(t)
        caps = 3 <= len(t) <= 90 and t[-1:] != "." and len(t.split()) <= 12 and sum(map(str.isalpha, t)) >= 3 and sum(map(str.isupper, t)) >= 0.85 * sum(map(str.isalpha, t))
        if m:
            decimals += 1
            parts.append([m[1], m[2].strip() if only_title(t) else None, []])
        elif w and (t.isupper() or len(t) <= 90):
            parts.append([w[1].upper(), t, []])
        elif caps:
            parts.append([None, t, []])
        parts[-1][2].append(line)
    front, body = parts[0], parts[1:]
    found, pending, section = [], [], None
    for k, (n, h, ls) in enumerate(body):
        if not any(x.strip() for x in ls[1:]) and k + 1 < len(body) and only_title(ls[0].strip()):
            pending.append(h or ls[0].strip())
            continue
        if pending:
            section, pending = " / ".join(pending), []
        elif n and not n[0].isdigit():
            section = None
        found.append((n, " / ".join(x for x in (section, h) if x) or None, "\n".join(ls).strip()))
    if any(x.strip() for x in front[2]):
        found.insert(0, (None, "Preamble", "\n".join(front[2]).strip()))
    if body and len(found) >= 3:
        return ("clause_numbering" if decimals >= 3 else "headings"), found
    done, cur = [], []
    for line in texts:
        if line.strip():
            cur.append(line)
        elif sum(map(len, cur)) >= 900:
            done, cur = [*done, cur], []
    done = [(None, None, "\n".join(c).strip()) for c in [*done, cur] if c]
    if len(done) >= 3:
        return "paragraphs", done
    whole = "\n".join(texts).strip()
    return "pages", [(None, None, whole)] * bool(whole)


def test_segmentation_against_a_walk_over_the_lines(spark):
    import random

    rng = random.Random(31)
    pool = ["1. DEFINITIONS", "1.1 The loan is a loan.", "2. INTEREST AND FEES", "2.1 Rate: 9 percent", "2.2 Early payment", "SCHEDULE OF CHARGES", "PART A", "Part b of a sentence that is lower case", "ANNEX II", "some text", "", "  ", "more text here.", "OTHER TERMS", "CHARGES.", "3) Fees", "Section 21 of the Act"]
    docs = {f"d{k}": [rng.choice(pool) for _ in range(rng.randint(0, 14))] for k in range(150)}
    docs |= {f"p{k}": [rng.choice(["word " * rng.randint(20, 90), "", "tail words here"]) for _ in range(40)] for k in range(20)}
    rows = [(d, 1, k, 1, t, False, False) for d, ts in docs.items() for k, t in enumerate(ts)]
    got = {}
    for r in G.segment(spark.createDataFrame(rows, LINES)).orderBy("document_id", "ordinal").collect():
        got.setdefault(r["document_id"], (r["strategy"], []))[1].append((r["number"], r["heading"], r["text"]))
    want = {d: w for d, ts in docs.items() if (w := walk(ts))[1]}
    assert got == want
