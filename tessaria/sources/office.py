"""Office files as tables: a scan of binary files and a parser per kind of file.

Parsers take a file's bytes and use the standard library alone; they run in
Arrow batches on the executors, one row per file, and a file that can't be read
gives a row with its error instead of ending the job. Spreadsheets and word
processor files are zipped XML; PDF texts come from tessaria.sources.pdf or an
extractor of the user's.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.sources import pdf

SCHEMA = (
    "path string, title string, file_type string, content string, error string, "
    "sheets array<struct<name:string,headers:array<string>,rows:array<array<string>>>>, sections array<struct<heading:string,text:string>>"
)


class ParsedFile(dict):
    """title, content, sheets and sections of a file."""

    def __init__(self, title: str = "", content: str = "", sheets=(), sections=()):
        super().__init__(title=title, content=content, sheets=list(sheets), sections=list(sections))


def format_cell(value) -> str:
    """Nothing: empty; whole numbers without a fraction; else the trimmed text."""
    if value is None:
        return ""
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value).strip()


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node, name: str):
    return [x for x in node if _local(x.tag) == name]


def _attr(node, name: str, default: str = "") -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), default)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref).group():
        n = 26 * n + ord(ch) - 64
    return n - 1


def _zip_xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _cell_text(cell, shared: list[str]) -> str:
    kind = cell.attrib.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t").strip()
    v = next(iter(_children(cell, "v")), None)
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)].strip()
    if kind in ("str", "e"):
        return v.text.strip()
    if kind == "b":
        return str(v.text == "1")
    try:
        return format_cell(float(v.text))
    except ValueError:
        return v.text.strip()


def tidy_sheet(name: str, grid: list[list[str]]) -> dict | None:
    """First row: headers, without trailing blanks, at least two. Rows are cut or filled to that width; blank rows go."""
    if not grid:
        return None
    headers = list(grid[0])
    while headers and not headers[-1].strip():
        headers.pop()
    if len(headers) < 2:
        return None
    n = len(headers)
    rows = [(r + [""] * n)[:n] for r in grid[1:]]
    rows = [r for r in rows if any(c.strip() for c in r)]
    return {"name": name, "headers": headers, "rows": rows} if rows else None


def parse_xlsx(data: bytes, path: str = "") -> ParsedFile:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = _zip_xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in _children(strings, "si")] if strings is not None else []
        book, rels = _zip_xml(z, "xl/workbook.xml"), _zip_xml(z, "xl/_rels/workbook.xml.rels")
        target = {r.attrib["Id"]: posixpath.normpath(posixpath.join("xl", r.attrib["Target"].removeprefix("/xl/"))) for r in rels} if rels is not None else {}
        sheets = []
        for s in (x for x in book.iter() if _local(x.tag) == "sheet"):
            xml = _zip_xml(z, target.get(_attr(s, "id"), ""))
            if xml is None:
                continue
            grid: list[list[str]] = []
            for row in (x for x in xml.iter() if _local(x.tag) == "row"):
                cells: list[str] = []
                for c in _children(row, "c"):
                    at = _column(c.attrib.get("r", "")) if c.attrib.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = _cell_text(c, shared)
                grid.append(cells)
            if tidy := tidy_sheet(s.attrib.get("name", ""), grid):
                sheets.append(tidy)
    if not sheets:
        raise ValueError("no sheet with headers and rows")
    text = "\n\n".join(f"=== Sheet: {s['name']} ===\n\n" + "\n".join(" | ".join(f"{h}: {' '.join(v.split(chr(10)))}" for h, v in zip(s["headers"], r, strict=True) if v.strip()) for r in s["rows"]) for s in sheets)
    return ParsedFile(posixpath.basename(path).rsplit(".", 1)[0], text, sheets)


def _flag(properties, name: str) -> bool:
    found = _children(properties, name) if properties is not None else []
    return bool(found) and _attr(found[0], "val", "1") not in ("0", "false", "none")


def heading_level(style: str, bold: bool, points: float | None) -> int | None:
    """1 to 6 from a heading, title or subtitle style; 1 to 3 from bold text of 18, 14 or 12 points and more."""
    low = style.strip().lower()
    for prefix, level in (("heading", 1), ("subtitle", 2), ("title", 1)):
        if low.startswith(prefix):
            digits = re.search(r"[1-9]", low)
            return min(6, int(digits.group())) if digits else level
    if bold and points:
        return next((level for least, level in ((18, 1), (14, 2), (12, 3)) if points >= least), None)
    return None


def parse_docx(data: bytes, path: str = "") -> ParsedFile:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, styles, core = _zip_xml(z, "word/document.xml"), _zip_xml(z, "word/styles.xml"), _zip_xml(z, "docProps/core.xml")
    names = {_attr(s, "styleId"): _attr(n[0], "val") for s in (styles if styles is not None else []) if _local(s.tag) == "style" and (n := _children(s, "name"))}
    title = next((x.text or "" for x in (core if core is not None else []) if _local(x.tag) == "title"), "")
    lines, sections = [], []
    for p in (x for x in body.iter() if _local(x.tag) == "p"):
        style = next((_attr(s, "val") for s in p.iter() if _local(s.tag) == "pStyle"), "")
        plain, marked, first = "", "", None
        for r in (x for x in p.iter() if _local(x.tag) == "r"):
            text = "".join("\t" if _local(t.tag) == "tab" else "\n" if _local(t.tag) in ("br", "cr") else t.text or "" for t in r if _local(t.tag) in ("t", "tab", "br", "cr"))
            pr = next(iter(_children(r, "rPr")), None)
            bold, italic = _flag(pr, "b"), _flag(pr, "i")
            size = next((float(_attr(s, "val", "0")) / 2 for s in _children(pr, "sz")), None) if pr is not None else None
            first = first or (bold, size)
            plain += text
            core_text = text.strip()
            if core_text and (bold or italic):
                mark = "**" if bold else "*"
                text = text.replace(core_text, f"{mark}{core_text}{mark}")
            marked += text
        if not plain.strip():
            continue
        level = heading_level(names.get(style, style), *(first or (False, None)))
        if level:
            lines.append("#" * level + " " + plain.strip())
            sections.append({"heading": plain.strip(), "text": ""})
        else:
            lines.append(marked.strip())
            if not sections:
                sections.append({"heading": "", "text": ""})
            sections[-1]["text"] = (sections[-1]["text"] + "\n" + marked.strip()).strip()
    if not lines:
        raise ValueError("no text")
    return ParsedFile(title or posixpath.basename(path).rsplit(".", 1)[0], "\n\n".join(lines), (), sections)


def pdf_parser(extract_pages: Callable[[bytes], list[str | None]]) -> Callable[[bytes, str], ParsedFile]:
    """A PDF parser from a function that gives the text of each page; pages without are skipped."""

    def parse(data: bytes, path: str = "") -> ParsedFile:
        pages = [re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", p)).strip() for p in extract_pages(data) if p]
        text = "\n\n".join(p for p in pages if p)
        if not text:
            raise ValueError("no page could be read")
        return ParsedFile(posixpath.basename(path).rsplit(".", 1)[0], text)

    return parse


PARSERS: dict[str, Callable[[bytes, str], ParsedFile]] = {".xlsx": parse_xlsx, ".docx": parse_docx, ".pdf": pdf_parser(pdf.extract_pages)}


def register_parser(extension: str, parser: Callable[[bytes, str], ParsedFile]) -> None:
    """Adds a parser for an extension such as ``.pdf``: a function of (bytes, path)."""
    if not re.fullmatch(r"\.\w+", extension):
        raise ValueError(f"an extension begins with a dot: {extension!r}")
    if not callable(parser):
        raise TypeError("a parser is a function")
    PARSERS[extension.lower()] = parser


def scan_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """path, length, content of the files below a folder whose extension is known, in any case; lock files (~$...) are skipped. A missing folder raises."""
    known = sorted(e.lower() for e in (extensions or PARSERS))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(F.regexp_extract("path", r"(\.\w+)$", 1)).isin(*known) & ~name.startswith("~$")).select("path", "length", "content")


def parse_files(files: DataFrame) -> DataFrame:
    """A row per file; error is null where it was read."""
    parsers = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                ext = "." + path.rsplit(".", 1)[-1].lower()
                try:
                    rows.append({"path": path, "file_type": ext[1:], "error": None, **parsers[ext](bytes(data), path)})
                except Exception as e:  # a file's own fault: reported in its row
                    rows.append({"path": path, "file_type": ext[1:], "error": f"{type(e).__name__}: {e}", **ParsedFile()})
            yield pd.DataFrame(rows, columns=["path", "title", "file_type", "content", "error", "sheets", "sections"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
