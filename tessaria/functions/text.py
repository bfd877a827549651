"""Text cleaning and normalisation as native column expressions.

All functions map a Column to a Column and leave null as null. Python's
notion of white space is spelt out, as Java's ``\\s`` knows ASCII alone.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters and patterns of the cleaning rules.
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS_NOT_NEWLINE = WS.replace(r"\x09-\x0D", r"\x09\x0B-\x0D")
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}"
ZWNJ = "‌"
COMMENT, TAG = r"(?s)<!--.*?-->", r"<[^>]+>"
URL = rf"(?i)(?:https?://|ftp://|//)[^{WS}<>\"']+"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
TEMP = rf"~\$[^{WS}]*"
INVISIBLE = r"[\x{FEFF}\x{200B}\x{200D}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
STRIP = rf"\A[{WS}]+|[{WS}]+\z"
ARABIC_LETTERS = {"آ": "ا", "أ": "ا", "إ": "ا", "ة": "ه", "ى": "ی", "ك": "ک", "ء": "ا", "ئ": "ی"}
SEARCH_LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک", "ة": "ه", "ٱ": "ا", "أ": "ا", "إ": "ا", ZWNJ: " "} | {
    chr(zero + d): str(d) for zero in (0x0660, 0x06F0) for d in range(10)
}
COMPARISON_LETTERS = {"ي": "ی", "ك": "ک", "ٱ": "ا", ZWNJ: " "}
PUNCTUATION = {"؛": "،", "​": "", "﻿": "", "‫": "", "‬": "", "‭": "", "‮": ""}
SUFFIXES = ["ها", "های", "ترین", "تر", "گر", "گری", "ی", "ای", "هایی", "هایی", "م", "ت", "ش"]


def mapped(c: Column, table: dict[str, str]) -> Column:
    """Replaces single characters; those with an empty value are deleted."""
    kept = {k: v for k, v in table.items() if v}
    gone = [k for k, v in table.items() if not v]
    return F.translate(c, "".join([*kept, *gone]), "".join(kept.values()))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def remove_html(c: Column) -> Column:
    """Comments go, tags become a space; character references stay."""
    return F.regexp_replace(F.regexp_replace(c, COMMENT, ""), TAG, " ")


def remove_urls(c: Column, placeholder: str = "[URL]") -> Column:
    return F.regexp_replace(c, URL, placeholder)


def remove_emails(c: Column, placeholder: str = "[EMAIL]") -> Column:
    return F.regexp_replace(c, EMAIL, placeholder)


def remove_temp_markers(c: Column) -> Column:
    return F.regexp_replace(c, TEMP, "")


def strip_bom(c: Column) -> Column:
    """Drops byte order marks and directional marks; the non-joiner stays."""
    return F.regexp_replace(c, INVISIBLE, "")


def remove_surrogates(c: Column) -> Column:
    """Valid UTF-8 has none: invalid bytes are replaced."""
    return F.make_valid_utf8(c)


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, rf"[{WS_NOT_NEWLINE}]{{2,}}", " "), r"\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    """The whole generic cleaning, one projection."""
    return collapse_whitespace(remove_temp_markers(remove_emails(remove_urls(remove_html(strip_bom(remove_surrogates(c)))))))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@lru_cache(1)
def unstable() -> str:
    """A character class of all that composition may change: what isn't its own NFC, combining marks, and second parts of composed characters."""
    second = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for k in range(0x110000):
        d = unicodedata.decomposition(chr(k))
        if d and d[0] != "<" and " " in d:
            second.add(int(d.split(" ")[1], 16))
    found = [k for k in range(0x300, 0x110000) if not 0xD800 <= k < 0xE000 and (k in second or unicodedata.combining(chr(k)) or not unicodedata.is_normalized("NFC", chr(k)))]
    # Such a class tries one range after another: its ranges lie within those of their block, so that most characters try a few.
    def ranges(of: list[int]) -> str:
        cuts = [i for i in range(len(of)) if i == 0 or of[i] != of[i - 1] + 1]
        return "".join(rf"\x{{{of[a]:X}}}-\x{{{of[b - 1]:X}}}" for a, b in zip(cuts, [*cuts[1:], len(of)], strict=True))

    def within(of: list[int], *sizes: int) -> str:
        if not sizes:
            return ranges(of)
        blocks = [list(g) for _, g in groupby(of, lambda x: x // sizes[0])]
        return "".join(rf"[\x{{{g[0]:X}}}-\x{{{g[-1]:X}}}&&[{within(g, *sizes[1:])}]]" for g in blocks)

    return rf"[\x{{300}}-\x{{10FFFF}}&&[{within(found, 0x1000, 0x100)}]]"


def nfc(c: Column) -> Column:
    """Canonical composition. Only texts with characters that it may change pass through Python."""
    return F.when(c.rlike(unstable()), _nfc(c)).otherwise(c)


def arabic_to_persian(c: Column) -> Column:
    return mapped(c, ARABIC_LETTERS)


def fix_zwnj(c: Column, mode: str = "anywhere") -> Column:
    """Sets a non-joiner before the listed suffixes, one after the other; ``boundary`` only at the end of a word."""
    if mode not in ("anywhere", "boundary"):
        raise ValueError(mode)
    c = F.regexp_replace(c, rf"([a-zA-Z0-9]){ZWNJ}([a-zA-Z0-9])", "$1$2")
    end = rf"(?![{ARABIC}{ZWNJ}])" if mode == "boundary" else rf"(?!{ZWNJ})"
    for s in SUFFIXES:
        c = F.regexp_replace(c, rf"([{ARABIC}])({s}){end}", f"$1{ZWNJ}$2")
    return F.replace(c, F.lit(ZWNJ * 2), F.lit(ZWNJ))


def fix_numbers(c: Column) -> Column:
    return F.translate(c, "٪", "%")


def fix_punctuation(c: Column) -> Column:
    return mapped(c, PUNCTUATION)


def remove_extra_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t\x{A0}]{2,}", " "), r"\n{3,}", "\n\n"))


def spell_check(c: Column, typos: dict[str, str] | None = None, collapse_newlines: bool = False) -> Column:
    """Replaces whole tokens; newlines stay unless ``collapse_newlines``, which joins all tokens by one space."""
    for wrong, right in (typos or {}).items():
        if wrong != right:
            c = F.regexp_replace(c, rf"(?<![^{WS}])\Q{wrong}\E(?![^{WS}])", right.replace("\\", "\\\\").replace("$", "\\$"))
    return F.array_join(F.regexp_extract_all(c, F.lit(rf"[^{WS}]+"), F.lit(0)), " ") if collapse_newlines else c


def normalise(c: Column, zwnj_mode: str = "anywhere", collapse_newlines: bool = False, external=None) -> Column:
    """The Persian normalisation; ``external`` may be a Column function that runs after the letters are mapped."""
    c = arabic_to_persian(nfc(c))
    if external:
        c = external(c)
    return spell_check(remove_extra_spaces(fix_punctuation(fix_numbers(fix_zwnj(c, zwnj_mode)))), collapse_newlines=collapse_newlines)


def search_letters(c: Column) -> Column:
    return mapped(c, SEARCH_LETTERS)


def comparison_form(c: Column) -> Column:
    return strip(mapped(c, COMPARISON_LETTERS))


def question_form(c: Column) -> Column:
    """The form in which questions are the same: letters, no question marks, single spaces."""
    return strip(F.regexp_replace(F.translate(comparison_form(c), "؟?", ""), rf"[{WS}]+", " "))


def pdf_clean(c: Column) -> Column:
    """Runs of spaces and tabs become one space, long gaps two newlines."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def header_form(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), rf"[{WS}_-]+", "")


def keyword_field(keywords: Column, question: Column) -> Column:
    """The keyword field as a query: at most six clean items, or else long words of the question."""
    c = F.regexp_replace(F.coalesce(keywords, F.lit("")), rf"[{WS}]*مدل[{WS}]*:[{WS}]*[^\n,،؛]+", "")
    c = F.replace(F.regexp_replace(c, "…+", ""), F.lit(ZWNJ), F.lit(" "))
    items = F.transform(F.split(c, r"[،,؛;\n]+"), lambda x: strip(F.regexp_replace(x, r"\A[\[\]\"' …]+|[\[\]\"' …]+\z", "")))
    good = F.filter(items, lambda x: (F.char_length(x) >= 2) & ~x.contains(":") & ~x.contains("مدل") & ~x.isin("حقیقی", "حقوقی", "و") & ~x.rlike(r"\A[…. ]+\z"))
    words = F.filter(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"[\x{0600}-\x{06FF}]+"), F.lit(0)), lambda w: F.char_length(w) > 3)
    return F.array_join(F.slice(F.when(F.size(good) > 0, good).otherwise(words), 1, 6), " ")


def keyword_list(c: Column) -> Column:
    """Keywords of a cell, split at commas of either script."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,،]"), strip), lambda x: x != "")


def context_text(title: Column, heading: Column, chunk_type: Column, content: Column) -> Column:
    """The text that is embedded for a chunk: title, heading, kind and content, those that are there."""
    some = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(name), x))
    return F.concat_ws("\n", some("Title: ", title), some("Heading: ", heading), F.when(chunk_type == "qa_pair", F.lit("Type: Q&A")), F.concat(F.lit("Content: "), F.coalesce(content, F.lit(""))))
