"""Sample documents: an agreement and an amendment to it, as blocks and as DOCX bytes."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

#: A block is (style, text): heading, line, or row (cells parted by " | ").
Block = tuple[str, str]

_NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def agreement_blocks(account: str = "SMP/HL/0001234", dated: str = "3 March 2024") -> list[Block]:
    """A home loan agreement of numbered clauses and a schedule of charges."""
    sections = (
        ("1. PARTIES", ("Sample Housing Finance Limited, the Lender, lends to Asha, an individual, the Borrower.", "The home loan is secured by a mortgage of the house.")),
        ("2. LOAN", ("The amount is paid out to the builder in four parts.", "The term is two hundred and forty months.")),
        ("3. INTEREST", ("The floating rate of interest is 9.10% a year, reset every quarter.", "The Lender tells the Borrower of each reset in writing.")),
        ("4. REPAYMENT", ("Instalments are due on the fifth day of each month by bank transfer.", "An instalment covers the interest first and the principal after it.")),
        ("6. SECURITY", ("The Borrower pledges the house and its land.", "The Borrower keeps the house in good repair.", "No other loan may be secured by the house.")),
        ("7. INSURANCE", ("The Borrower insures the house against fire and flood.", "The premium may be financed with the loan.")),
        ("9. LATE PAYMENT", ("A penal charge of 2% a month is due on amounts that are overdue.", "Penal charges are not added to the principal.")),
        ("11. EARLY REPAYMENT", ("The Borrower may repay a part of the loan at any time after notice.", "A lock-in of twelve months holds from the first payment.", "A charge of 3% is due on what is repaid early from borrowed money.", "Notice of early repayment is given thirty days before.", "Documents are returned within sixty days of the last payment.")),
        ("12. GENERAL", ("The courts of the place of the house decide disputes.", "Changes of this agreement are made in writing.")),
    )
    out: list[Block] = [("heading", "HOME LOAN AGREEMENT"), ("line", f"Loan account no. {account}, agreement dated {dated} between the two parties named below.")]
    for title, clauses in sections:
        out.append(("heading", title))
        number = title.partition(".")[0]
        out += [("line", f"{number}.{k} {text}") for k, text in enumerate(clauses, 1)]
    rows = ("Processing fee | 0.5% of the amount", "Statement of account | free of charge", "Copy of documents | Rs. 500")
    return [*out, ("heading", "SCHEDULE OF CHARGES"), *(("row", r) for r in rows)]


def amendment_blocks(account: str = "SMP/HL/0001234", dated: str = "3 March 2024") -> list[Block]:
    """A revision that replaces two clauses, deletes three, and lets the rest stand."""
    return [
        ("heading", "HOME LOAN AGREEMENT, REVISED - VERSION 2"),
        ("line", f"Loan account no. {account}. The original agreement dated {dated} stands revised with effect from 1 June 2025; save as expressly revised it continues in full force."),
        ("heading", "3. INTEREST"), ("line", "3.1 The floating rate of interest is 8.60% a year, reset every quarter."), ("line", "3.2 All other provisions of clause 3 remain unchanged."),
        ("heading", "9. LATE PAYMENT"), ("line", "9.1 A penal charge of 1.5% a month is due on amounts that are overdue."), ("line", "9.2 All other provisions of clause 9 remain unchanged."),
        ("heading", "11. EARLY REPAYMENT"), ("line", "11.2 Clause 11.2 on the lock-in is hereby deleted in its entirety."),
        ("line", "11.3 No charge is due on what is repaid early. Clauses 11.4 and 11.5 of the original stand superseded and are of no further effect."),
    ]


def docx_bytes(blocks: list[Block]) -> bytes:
    """A DOCX file of blocks; rows that follow each other are one table."""
    paragraph = lambda text, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'
    heading = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body, table = [], []
    for style, text in [*blocks, ("end", "")]:
        if style == "row":
            table.append("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in text.split(" | ")) + "</w:tr>")
            continue
        if table:
            body.append("<w:tbl>" + "".join(table) + "</w:tbl>")
            table = []
        if style != "end":
            body.append(paragraph(text, heading if style == "heading" else ""))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_NAMESPACE}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()
