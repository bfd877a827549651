"""Chunkers: one document in, an ordered table of chunks out.

Packing sentences is a fold over a document, so that it runs once per document in
Arrow batches of a pandas UDF; everything around it (splitting, overlap, parents,
headings) is a native expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.functions.text import WS, ZWNJ, question_form, strip
from tessaria.functions.tokens import estimate_tokens, words

MAX_TOKENS, MIN_TOKENS, OVERLAP = 512, 64, 50

# The structural marks of documents, in the syntax of both regex engines, and labels of fields.
DIGITS = r"[0-9۰-۹٠-٩]"
HEADING = r"(?m)^#{1,6}\s+.+$"
ARTICLE = rf"(?m)^[ماده]\s*{DIGITS}+"
SECTION = rf"(?m)^(?:[بشرطی][ها]?\s*{DIGITS}+|فصل\s*{DIGITS}+)"
QUESTION = r"(?mi)^[-*]?\s*(?:سؤال|سوال|پرسش|Question)\s*[:：]"
REASON = r"(?mi)^(?:کد\s*دلیل|reason\s*code)\s*[:؛：]"
SHEET = r"(?m)^={3,}\s*(?:Sheet:)?\s*.+"
SCHEMA = r"(?m)^\[Schema:.*\]"
PIPE_ROW = r"(?m)^[^|\n]+\|[^|\n]+(?:\|[^|\n]+)*$"
BLANK_LINE, NEWLINE = r"\n\s*\n", r"\n"
LAW_ARTICLE = r"(?:ماد[هة]|مادة|المادة|فقر[هة]|الفقر[هة]|بند|البند)\s*(?:ال\s*)?\(?[٠-٩0-9]+\)?"
LABELS = {
    "question": "سوال", "briefanswer": "پاسخ کوتاه", "brief_answer": "پاسخ کوتاه", "answer": "پاسخ کامل", "keyword": "کلیدواژه‌ها", "keywords": "کلیدواژه‌ها", "model": "مدل",
    "reason_code": "کد دلیل", "brief_explanation": "توضیح کوتاه", "detailed_explanation": "توضیح کامل",
}
FIELD_ORDER = {
    "reason_codes": ["reason_code", "model", "brief_explanation", "detailed_explanation"],
    "": ["question", "briefanswer", "brief_answer", "answer", "keyword", "keywords"],
}


# --- folds over one document ---------------------------------------------------------------------------------------------


def token_count(text: str) -> int:
    return 2 * len(text.split())


def pack(pieces: Iterable[str], most: int, fits: Callable[[int, int, int], bool], alone: bool) -> list[str]:
    """Fills groups of neighbouring pieces, joined by a space; ``alone``: an oversized piece at a group's start is a group."""
    out: list[str] = []
    group: list[str] = []
    held = 0
    for p in pieces:
        n = token_count(p)
        if not group and alone and n >= most:
            out.append(p)
        elif group and not fits(held, n, most):
            out.append(" ".join(group))
            group, held = [p], n
        else:
            group.append(p)
            held += n
    return [*out, " ".join(group)] if group else out


def absorb_short(pieces: list[str], least: int) -> list[str]:
    """A piece that is too short takes in the next one; the last may stay short."""
    out: list[str] = []
    for p in pieces:
        if out and token_count(out[-1]) < least:
            out[-1] = f"{out[-1]}\n\n{p}"
        else:
            out.append(p)
    return out


def split_before(text: str, pattern: re.Pattern) -> list[str]:
    """Cuts before each match; blank pieces go."""
    at = sorted({0, *(m.start() for m in pattern.finditer(text)), len(text)})
    return [p for a, b in zip(at, at[1:]) if (p := text[a:b]).strip()]


_SENTENCE = re.compile(r"(?<=[.!؟?])\s+")
_LATIN_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_LEVELS = [re.compile(p) for p in (ARTICLE, SECTION, HEADING, SHEET)]
_FINE = [re.compile(p) for p in (PIPE_ROW, SCHEMA, BLANK_LINE, NEWLINE)]


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text) if s.strip()]


def fixed_pieces(text: str, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> list[str]:
    """Sentences packed into pieces of at most ``most`` tokens; short ones take in the next."""
    return absorb_short(pack(sentences(text), most, lambda held, n, m: held + n <= m, alone=True), least)


def fine_pieces(text: str) -> list[str]:
    """The first finer mark that cuts the text in several pieces: table rows, schema marks, blank lines, newlines."""
    for k, p in enumerate(_FINE):
        if k == 0 and text.count("|") < 3:
            continue
        if len(parts := split_before(text, p)) > 1:
            return parts
    return [text]


def last_resort(text: str, most: int) -> list[str]:
    """Sentences packed; a text of one sentence is cut by length."""
    parts = _LATIN_SENTENCE.split(text)
    if len(parts) > 1:
        return [p for x in pack(parts, most, lambda held, n, m: held + n <= m, alone=False) if (p := x.strip())] or [text]
    return [text[i : i + 4 * most] for i in range(0, len(text), 4 * most)]


def structural_pieces(text: str, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> list[str]:
    """The first structural mark that occurs cuts the text; oversized pieces are cut more finely, short ones merged."""
    level = next((p for p in _LEVELS if p.search(text)), None)
    parts = split_before(text, level) if level else [text]
    for finer in (fine_pieces, lambda x: last_resort(x, most)):
        parts = [q for p in parts for q in (finer(p) if token_count(p) > most else [p])]
    return absorb_short(parts, least)


def sentence_overlap_pieces(text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[str]:
    """Packs sentences; each piece begins with the last whole sentences of the one before, up to ``overlap`` tokens."""
    out: list[list[str]] = []
    group: list[str] = []
    for s in sentences(text):
        if group and token_count(" ".join(group)) + token_count(s) > most:
            out.append(group)
            tail: list[str] = []
            for t in reversed(group):
                if token_count(" ".join([t, *tail])) > overlap:
                    break
                tail.insert(0, t)
            group = tail
        group.append(s)
    if group:
        out.append(group)
    return [" ".join(g) for g in out]


def _cutter(fn: Callable[[str], list[str]]):
    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: fn(t) if t is not None else [])

    return cut


# --- chunkers ------------------------------------------------------------------------------------------------------------


def split_on(c: Column, pattern: str, replacement: str = "$0") -> Column:
    """Pieces that begin at each match of a pattern, natively; blank pieces go."""
    return F.filter(F.split(F.regexp_replace(c, pattern, f"\u0001{replacement}"), "\u0001"), lambda p: F.char_length(strip(p)) > 0)


def law_sections(c: Column) -> Column:
    """Sections of a law text from each article mark on; what precedes the first is no section."""
    parts = F.split(F.regexp_replace(c, LAW_ARTICLE, "\u0001$0"), "\u0001")
    return F.filter(F.transform(F.slice(parts, 2, 1 << 30), strip), lambda p: p != "")


def heading_path(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?m)^#{1,6}[ \t]+(.+)$", 1))


def build(docs: DataFrame, id_col: str, pieces: Column, chunk_type: str = "body") -> DataFrame:
    """id, ordinal (before blank pieces go), chunk_type, content, heading_path, token_count."""
    out = docs.select(id_col, F.posexplode(pieces).alias("ordinal", "content")).withColumn("content", strip(F.col("content"))).where("content <> ''")
    return out.select(id_col, F.col("ordinal").cast("long").alias("ordinal"), F.lit(chunk_type).alias("chunk_type"), "content", heading_path(F.col("content")).alias("heading_path"), estimate_tokens(F.col("content")).alias("token_count"))


def with_overlap(chunks: DataFrame, id_col: str, overlap: int = OVERLAP, left: str = "…", right: str = "…", parent: Column | None = None) -> DataFrame:
    """Sets the last words of the chunk before, as it was without overlap, ahead of each; parents stay as they are."""
    if overlap <= 0:
        return chunks
    before = F.lag("content").over(Window.partitionBy(id_col).orderBy("ordinal"))
    own = F.lit(True) if parent is None else ~parent
    tail = words(F.col("_before"))
    n = max(1, overlap // 2)
    text = F.concat(F.lit(left), F.array_join(F.slice(tail, F.greatest(F.size(tail) - n, F.lit(0)) + 1, F.lit(n)), " "), F.lit(right + "\n"), F.col("content"))
    out = chunks.withColumn("_before", before).withColumn("content", F.when(F.col("_before").isNotNull() & own, text).otherwise(F.col("content")))
    return out.drop("_before").withColumn("token_count", estimate_tokens(F.col("content")))


SEMANTIC_MARKS = (f"...{ZWNJ}", f"{ZWNJ}...")


def fixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    return with_overlap(build(docs, id_col, _cutter(lambda t: fixed_pieces(t, most, least))(F.col(text_col))), id_col, overlap)


def semantic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", doc_type: str = "body", most: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Cut by questions, by reason codes, or by structure, as the type of the documents says."""
    if doc_type == "qa_pair":
        pieces = split_on(F.col(text_col), QUESTION)
    elif doc_type == "reason_detail":
        pieces = split_on(F.col(text_col), REASON)
    else:
        pieces = _cutter(lambda t: structural_pieces(t, most, least))(F.col(text_col))
    return with_overlap(build(docs, id_col, pieces, doc_type), id_col, overlap, *SEMANTIC_MARKS)


def sentence_aware(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    return build(docs, id_col, _cutter(lambda t: sentence_overlap_pieces(t, most, overlap))(F.col(text_col)))


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixed": fixed, "semantic": semantic, "sentence": sentence_aware}


def register_chunker(name: str, chunker: Callable[..., DataFrame]) -> None:
    """Adds a chunker: a function of (docs, id_col, text_col, ...) to a table of chunks."""
    if not callable(chunker):
        raise TypeError("a chunker is a function")
    CHUNKERS[name] = chunker


def chunk(docs: DataFrame, chunker: str = "semantic", **options) -> DataFrame:
    if chunker not in CHUNKERS:
        raise KeyError(f"{chunker}: known are {sorted(CHUNKERS)}")
    return CHUNKERS[chunker](docs, **options)


# --- rows of sheets ------------------------------------------------------------------------------------------------------

# The columns of known sheets.
SCHEMAS = {
    "reason_codes": ["reason_code", "model_name", "model_id", "brief_explanation", "detailed_explanation", "reason_text", "improvement_suggestions", "bin_score", "bin_impact", "feature_score", "feature_impact", "bin_details", "keywords", "feature_name", "data_source"],
    "crm_qa": ["question", "model", "briefanswer", "answer", "keyword"],
    "articles": ["documentname", "title", "sectiontitle", "content", "type", "version", "author(s)", "heading", "keywords", "summary"],
}
DOC_TYPES = {"reason_codes": "reason_detail", "crm_qa": "qa_pair", "articles": "body"}


def detect_schema(headers: Column) -> Column:
    """The first known sheet of whose columns at least 60 % are there, both sides compared without case, blanks, ``_`` and ``-``."""
    have = F.array_distinct(F.transform(F.coalesce(headers, F.array().cast("array<string>")), lambda h: F.regexp_replace(F.lower(strip(F.coalesce(h, F.lit("")))), rf"[{WS}_-]+", "")))
    out = None
    for name, columns in SCHEMAS.items():
        want = [re.sub(r"[\s_-]+", "", c) for c in columns]
        test = F.size(F.array_intersect(have, F.array(*map(F.lit, want)))) >= 0.6 * len(want)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def row_fields(headers: Column, row: Column) -> Column:
    """(key, value) of a row's filled cells, keys in lower case; of equal keys the last counts, at the place of the first."""
    pairs = F.transform(F.arrays_zip(headers.alias("h"), row.alias("r")), lambda z: F.struct(F.lower(z["h"]).alias("k"), F.replace(strip(z["r"]), F.lit("\n"), F.lit(" ")).alias("v")))
    full = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & (p["v"] != ""))
    keys = F.array_distinct(F.transform(full, lambda p: p["k"]))
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(full, lambda p: p["k"] == k), -1)["v"].alias("v")))


def _field(fields: Column, *names: str) -> Column:
    return F.get(F.transform(F.filter(fields, lambda p: p["k"].isin(*names)), lambda p: p["v"]), F.lit(0))


def labelled(fields: Column, schema: Column) -> Column:
    """``label: value`` lines: the fields of the schema in their order, then the others as they come."""
    label = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), k), k)

    def lines(order: list[str]) -> Column:
        first = [F.concat(F.lit(f"{LABELS[k]}: "), _field(fields, k)) for k in order]
        rest = F.transform(F.filter(fields, lambda p: ~p["k"].isin(*order)), lambda p: F.concat(label(p["k"]), F.lit(": "), p["v"]))
        return F.array_join(F.concat(F.array_compact(F.array(*first)), rest), "\n")

    return F.when(schema == "reason_codes", lines(FIELD_ORDER["reason_codes"])).otherwise(lines(FIELD_ORDER[""]))


def sheet_rows(sheets: DataFrame, doc_type: str = "qa_pair", dedup: bool = False) -> DataFrame:
    """Child chunks from sheets (doc_id, sheet_no, name, schema, headers, rows): one per row.

    Rows of questions need a question and an answer. With ``dedup`` the first row of
    a question stays, across sheets and documents, and rows without one go.
    Columns: doc_id, sheet_no, row_no, ordinal, sheet_name, schema, chunk_type, content, heading_path, keywords, question, token_count.
    """
    r = sheets.select("doc_id", "sheet_no", "name", "schema", "headers", F.posexplode("rows").alias("row_no", "row"))
    r = r.withColumn("fields", row_fields(F.col("headers"), F.col("row"))).where(F.size("fields") > 0)
    f = F.col("fields")
    r = r.withColumn("question", _field(f, "question"))
    if doc_type == "qa_pair":
        r = r.where(F.col("question").isNotNull() & _field(f, "answer", "briefanswer", "brief_answer").isNotNull())
        if dedup:
            key = question_form(F.col("question"))
            first = F.row_number().over(Window.partitionBy("_key").orderBy("doc_id", "sheet_no", "row_no"))
            r = r.withColumn("_key", key).where("_key <> ''").withColumn("_n", first).where("_n = 1").drop("_key", "_n")
    kw = _field(f, "keyword")
    out = r.select(
        "doc_id", "sheet_no", F.col("row_no").cast("long").alias("row_no"), F.col("name").alias("sheet_name"), "schema", F.lit(doc_type).alias("chunk_type"), labelled(f, F.coalesce("schema", F.lit(""))).alias("content"),
        F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("Sheet: "), F.col("name"))).otherwise("").alias("heading_path"), F.coalesce(F.split(kw, "،"), F.array().cast("array<string>")).alias("keywords"), "question",
    )
    w = Window.partitionBy("doc_id").orderBy("sheet_no", "row_no")
    return out.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long")).withColumn("token_count", estimate_tokens(F.col("content")))


def parents(children: DataFrame, scope: str = "sheet") -> DataFrame:
    """A parent per sheet or document: doc_id, parent_key, chunk_type, content, child_count, token_count."""
    if scope not in ("sheet", "document"):
        raise ValueError(scope)
    key = F.col("sheet_name") if scope == "sheet" else F.lit("document")
    g = children.groupBy("doc_id", key.alias("parent_key"), F.concat("chunk_type", F.lit("_parent")).alias("chunk_type"))
    out = g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "\n\n").alias("content"), F.count(F.lit(1)).alias("child_count"))
    return out.withColumn("token_count", estimate_tokens(F.col("content")))


def sheet_text(name: Column, schema: Column, headers: Column, rows: Column) -> Column:
    """A sheet as text: its name, its schema, a blank line, a line of ``header: value`` cells per row."""
    cell = lambda z: F.concat(z["h"], F.lit(": "), F.regexp_replace(z["r"], r"[\r\n]+", " "))
    line = lambda row: F.array_join(F.transform(F.filter(F.arrays_zip(headers.alias("h"), row.alias("r")), lambda z: F.coalesce(strip(z["r"]), F.lit("")) != ""), cell), " | ")
    return F.concat_ws("\n", F.concat(F.lit("=== Sheet: "), name, F.lit(" ===")), F.when(schema.isNotNull(), F.concat(F.lit("[Schema: "), schema, F.lit("]"))), F.lit(""), F.array_join(F.transform(rows, line), "\n"))


