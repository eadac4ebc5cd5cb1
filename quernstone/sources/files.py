"""File sources: binary scan, parser routing, DOCX and page-text parsers.

PDF decoding and OCR need engines that aren't installed: pages come in already extracted,
and OCR is a function that the caller gives.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MEDIA = {".pdf": "application/pdf", ".docx": DOCX}
OCTETS = "application/octet-stream"
FEW_CHARACTERS = 40
_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

LINES = "document_id string, version int, line_no int, page int, text string, is_ocr boolean, is_heading boolean"


def media_type(path: Column) -> Column:
    out = F.lit(OCTETS)
    for suffix, kind in MEDIA.items():
        out = F.when(F.lower(path).endswith(suffix), kind).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, filename, media_type, content, document_id (from the content's hash)."""
    reader = spark.read.format("binaryFile")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("filename"), media_type(F.col("path")).alias("media_type"), "content", F.concat(F.lit("doc-"), X.fingerprint(F.col("content"))).alias("document_id"))


MOST_BYTES = 20 * 1024 * 1024


def upload_status(content: Column, filename: Column) -> Column:
    """Why an upload is refused: 400 (empty), 413 (over 20 MB) or 415 (neither PDF nor DOCX),
    in this order; 200 if it is not."""
    known = F.lower(filename).endswith(".pdf") | F.lower(filename).endswith(".docx")
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(size == 0, 400).when(size > MOST_BYTES, 413).when(~F.coalesce(known, F.lit(False)), 415).otherwise(200)


def supports(kind: str, media: Column, filename: Column) -> Column:
    suffix = f".{kind}"
    return (F.lower(media) == MEDIA[suffix]) | F.lower(filename).endswith(suffix)


def select_parser(media: Column, filename: Column) -> Column:
    """The first parser that takes the file (pdf before docx); an error if none does."""
    unknown = F.raise_error(F.concat(F.lit("no parser for "), filename))
    return F.when(supports("pdf", media, filename), "pdf").when(supports("docx", media, filename), "docx").otherwise(unknown)


def docx_lines(content: bytes) -> Iterator[tuple[int, str, bool]]:
    """(page, text, is_heading) of a DOCX body in order; a table row is a line of its
    distinct neighbouring cells, and a blank line follows a table."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_NS}body")
    page = 1
    words = lambda e: "".join("\t" if n.tag == f"{_NS}tab" else n.text or "" for n in e.iter() if n.tag in (f"{_NS}t", f"{_NS}tab"))
    for block in body if body is not None else ():
        if block.tag == f"{_NS}p":
            style = block.find(f"{_NS}pPr/{_NS}pStyle")
            heading = style is not None and style.get(f"{_NS}val", "").lower().startswith("heading")
            yield page, words(block), heading
            page += sum(b.get(f"{_NS}type") == "page" for b in block.iter(f"{_NS}br"))
        elif block.tag == f"{_NS}tbl":
            for row in block.iter(f"{_NS}tr"):
                cells: list[str] = []
                for cell in row.iter(f"{_NS}tc"):
                    t = " ".join(filter(None, (words(p).strip() for p in cell.iter(f"{_NS}p"))))
                    if t and (not cells or cells[-1] != t):
                        cells.append(t)
                yield page, " | ".join(cells), False
            yield page, "", False


def parse_docx(files: DataFrame, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """lines and warnings (document_id, code, message); a file that can't be read gives no
    line and a warning, never an exception."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, content in zip(f["document_id"], f["content"], strict=True):
                try:
                    rows = list(docx_lines(bytes(content)))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, EOFError, NotImplementedError, RuntimeError) as e:
                    out.append((doc, version, -1, 0, f"{type(e).__name__}: {e}", False, False))
                    continue
                out += [(doc, version, k, page, text, False, heading) for k, (page, text, heading) in enumerate(rows)]
            yield pd.DataFrame(out, columns=["document_id", "version", "line_no", "page", "text", "is_ocr", "is_heading"])

    parsed = files.select("document_id", "content").mapInPandas(run, LINES)
    failed = parsed.where("line_no < 0").select("document_id", F.lit("unreadable_document").alias("code"), F.col("text").alias("message"))
    return parsed.where("line_no >= 0"), failed


def page_lines(pages: DataFrame, ocr: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """lines and warnings from pages (document_id, version, page, text, error). A page of
    fewer than 40 characters goes to ocr, a function from its rows to (document_id,
    version, page, text); without one, or without text from it, a warning says so. A
    blank line follows each page."""
    thin = F.length(F.trim(F.coalesce("text", F.lit("")))) < FEW_CHARACTERS
    broken = F.col("error").isNotNull()
    warn = lambda d, code, message: d.select("document_id", "page", F.lit(code).alias("code"), message.cast("string").alias("message"))
    warnings = warn(pages.where(broken), "page_unreadable", F.col("error"))
    good = pages.where(~broken & ~thin).select("document_id", "version", "page", "text", F.lit(False).alias("is_ocr"))
    short = pages.where(~broken & thin)
    if ocr is None:
        warnings = warnings.unionByName(warn(short, "ocr_disabled", F.lit("the page has next to no text and OCR is off")))
        good = good.unionByName(short.select("document_id", "version", "page", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("is_ocr")))
    else:
        read = ocr(short).select("document_id", "version", "page", "text")
        empty = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
        warnings = warnings.unionByName(warn(read.where(empty), "ocr_empty", F.lit("OCR found no text")))
        good = good.unionByName(read.where(~empty).withColumn("is_ocr", F.lit(True)))
    each = good.select("document_id", "version", "page", "is_ocr", F.posexplode(F.concat(F.split("text", "\n"), F.array(F.lit("")))).alias("_i", "text"))
    number = F.row_number().over(W.partitionBy("document_id", "version").orderBy("page", "_i")) - 1
    lines = each.withColumn("line_no", number).select("document_id", F.col("version").cast("int").alias("version"), F.col("line_no").cast("int").alias("line_no"), F.col("page").cast("int").alias("page"), "text", "is_ocr", F.lit(False).alias("is_heading"))
    return lines, warnings
