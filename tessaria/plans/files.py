"""Queries of file parsers (A rows of the inventory): every document is written as a file's bytes and parsed again."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.plans.base import query, table
from tessaria.plans.text import _strip
from tessaria.sources import office

BOOK = "<workbook xmlns:r='r'><sheets><sheet name='S1' r:id='rId1'/></sheets></workbook>"
RELATIONS = "<Relationships><Relationship Id='rId1' Target='worksheets/sheet1.xml'/></Relationships>"


def zipped(parts: dict[str, str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


def xlsx(grid: list[list]) -> bytes:
    """A workbook of one sheet: numbers as such, all else as text in its cell."""
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int) else f"<c t='inlineStr'><is><t>{escape(str(v))}</t></is></c>"
    cells = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in grid)
    return zipped({"xl/workbook.xml": BOOK, "xl/_rels/workbook.xml.rels": RELATIONS, "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"})


def docx(lines: list[str]) -> bytes:
    """A document of a paragraph per line."""
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    return zipped({"word/document.xml": f"<w:document xmlns:w='http://w'><w:body>{body}</w:body></w:document>"})


def pdf(pages: list[str]) -> bytes:
    """A file of a page per text: one font, whose codes are the characters in order of appearance."""
    chars = dict.fromkeys("".join(pages))
    code = {c: f"{k:04x}" for k, c in enumerate(chars, 1)}
    table = f"1 begincodespacerange <0000> <ffff> endcodespacerange {len(code)} beginbfchar " + " ".join(f"<{n}> <{c.encode('utf-16-be').hex()}>" for c, n in code.items()) + " endbfchar"
    kids = " ".join(f"{2 * k + 5} 0 R" for k in range(len(pages)))
    parts = ["<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Resources<</Font<</F1 3 0 R>>>>>>", "<</Type/Font/ToUnicode 4 0 R>>", table]
    for k, page in enumerate(pages):
        parts += [f"<</Type/Page/Parent 2 0 R/Contents {2 * k + 6} 0 R>>", f"BT /F1 12 Tf 72 700 Td <{''.join(code[c] for c in page)}> Tj ET"]
    body = b"%PDF-1.7\n"
    for n, part in enumerate(parts, 1):
        raw = zlib.compress(part.encode())
        whole = part.encode() if part.startswith("<<") else b"<</Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (len(raw), raw)
        body += b"%d 0 obj\n%s\nendobj\n" % (n, whole)
    return body


def written(docs: DataFrame, extension: str, make: Callable[[pd.DataFrame], list[bytes]]) -> DataFrame:
    """path and content of a file per row, as a scan of a folder gives them."""

    def run(batches):
        for frame in batches:
            yield pd.DataFrame({"path": [f"kb/{i}{extension}" for i in frame["doc_id"]], "content": make(frame)})

    return docs.mapInPandas(run, "path string, content binary")


def number(path: str):
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long")


@query("a2_registered_parser", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS title, text AS content FROM documents")
def registered(spark, sf_dir):
    """A parser of one's own for a further extension."""
    office.register_parser(".note", lambda data, path: office.ParsedFile(path.rsplit("/", 1)[-1].removesuffix(".note"), data.decode()))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("kb/"), "doc_id", F.lit(".note")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return office.parse_files(files).where("error is null").select(number("path").alias("doc_id"), "title", "content")


@query("a3_a4_xlsx_rows", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, lang, source, CAST(n_chars AS VARCHAR) AS chars FROM documents")
def sheet_rows(spark, sf_dir):
    """A sheet per document: whole numbers come back in full, texts as they were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    make = lambda pdf: [xlsx([["id", "lang", "source", "chars"], [int(i), a, s, int(n)]]) for i, a, s, n in pdf.itertuples(index=False)]
    row = office.parse_files(written(docs, ".xlsx", make)).select(number("path").alias("doc_id"), F.col("sheets")[0]["rows"][0].alias("r"))
    return row.select("doc_id", *[F.col("r")[k].alias(n) for k, n in enumerate(("id", "lang", "source", "chars"))])


LINES = f"SELECT doc_id, pos, {_strip('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE {_strip('line')} <> ''"


@query("a6_docx_paragraphs", f"WITH l AS ({LINES}) SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS content FROM l GROUP BY doc_id")
def paragraphs(spark, sf_dir):
    """A paragraph per line of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parsed = office.parse_files(written(docs, ".docx", lambda pdf: [docx(t.split("\n")) for t in pdf["text"]]))
    return parsed.where("error is null").select(number("path").alias("doc_id"), "content")


@query("a7_pdf_pages", f"WITH l AS ({LINES}) SELECT doc_id, string_agg(regexp_replace(line, '[ \\t]+', ' ', 'g'), chr(10) || chr(10) ORDER BY pos) AS content FROM l GROUP BY doc_id")
def pages(spark, sf_dir):
    """A page per line of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parsed = office.parse_files(written(docs, ".pdf", lambda frame: [pdf(t.split("\n")) for t in frame["text"]]))
    return parsed.where("error is null").select(number("path").alias("doc_id"), "content")
