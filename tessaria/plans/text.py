"""Queries of the text functions (D and E rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaria.functions import text as T
from tessaria.functions import tokens as K
from tessaria.plans.base import TEXTS_SQL, query, quoted, rr, table, texts


def _translate(x: str, mapping: dict[str, str]) -> str:
    kept = {k: v for k, v in mapping.items() if v}
    gone = "".join(k for k, v in mapping.items() if not v)
    return f"translate({x}, {quoted(''.join(kept) + gone)}, {quoted(''.join(kept.values()))})"


def _strip(x: str) -> str:
    return rr(x, T.STRIP, "")


def _spaces(x: str, pattern: str) -> str:
    return _strip(rr(rr(x, pattern, " "), r"\n{3,}", "\n\n"))


def clean_sql(x: str) -> str:
    for pattern, new in ((T.INVISIBLE, ""), (T.COMMENT, ""), (T.TAG, " "), (T.URL, "[URL]"), (T.EMAIL, "[EMAIL]"), (T.TEMP, "")):
        x = rr(x, pattern, new)
    return _spaces(x, rf"[{T.WS_NOT_NEWLINE}]{{2,}}")


def zwnj_sql(x: str) -> str:
    """A suffix that a non-joiner follows is put away before it is looked for, as the dialect has no lookahead."""
    x = rr(x, f"([a-zA-Z0-9]){T.ZWNJ}([a-zA-Z0-9])", r"\1\2")
    for s in T.SUFFIXES:
        kept = quoted(s + T.ZWNJ)
        away = rr(f"replace({x}, {kept}, chr(2))", f"([{T.ARABIC}])({s})", rf"\1{T.ZWNJ}\2")
        x = f"replace({away}, chr(2), {kept})"
    return f"replace({x}, {quoted(T.ZWNJ * 2)}, {quoted(T.ZWNJ)})"


COMPARISON = _strip(_translate("text", T.COMPARISON_LETTERS))
QUESTION_SQL = _strip(rr(f"translate({COMPARISON}, '؟?', '')", rf"[{T.WS}]+", " "))
#: name: (Column function, SQL over ``text`` or None)
SCALARS = {
    "d1_remove_html": (T.remove_html, rr(rr("text", T.COMMENT, ""), T.TAG, " ")),
    "d2_remove_urls": (T.remove_urls, rr("text", T.URL, "[URL]")),
    "d3_remove_emails": (T.remove_emails, rr("text", T.EMAIL, "[EMAIL]")),
    "d4_remove_temp_markers": (T.remove_temp_markers, rr("text", T.TEMP, "")),
    "d5_strip_bom": (T.strip_bom, rr("text", T.INVISIBLE, "")),
    "d6_remove_surrogates": (T.remove_surrogates, "text"),
    "d7_collapse_whitespace": (T.collapse_whitespace, _spaces("text", rf"[{T.WS_NOT_NEWLINE}]{{2,}}")),
    "d8_clean_text": (T.clean_text, clean_sql("text")),
    "d9_nfc": (T.nfc, "nfc_normalize(text)"),
    "d10_arabic_to_persian": (T.arabic_to_persian, _translate("text", T.ARABIC_LETTERS)),
    "d11_fix_zwnj": (T.fix_zwnj, zwnj_sql("text")),
    "d12_fix_numbers": (T.fix_numbers, "translate(text, '٪', '%')"),
    "d13_fix_punctuation": (T.fix_punctuation, _translate("text", T.PUNCTUATION)),
    "d14_remove_extra_spaces": (T.remove_extra_spaces, _spaces("text", r"[ \t\x{A0}]{2,}")),
    "d15_spell_check": (lambda c: T.spell_check(c, collapse_newlines=True), f"array_to_string(regexp_extract_all(text, {quoted(f'[^{T.WS}]+')}), ' ')"),
    "d16_normalise": (T.normalise, _spaces(_translate(f"translate({zwnj_sql(_translate('nfc_normalize(text)', T.ARABIC_LETTERS))}, '٪', '%')", T.PUNCTUATION), r"[ \t\x{A0}]{2,}")),
    "d17_search_letters": (T.search_letters, _translate("text", T.SEARCH_LETTERS)),
    "d18_comparison_form": (T.comparison_form, COMPARISON),
    "d19_question_form": (T.question_form, QUESTION_SQL),
    "d20_pdf_clean": (T.pdf_clean, _spaces("text", r"[ \t]+")),
    "d21_header_form": (T.header_form, rr(f"lower({_strip('text')})", rf"[{T.WS}_-]+", "")),
}


def _scalar(fn):
    return lambda spark, sf_dir: texts(spark, sf_dir).select("id", fn(F.col("text")).alias("out"))


for _name, (_fn, _sql) in SCALARS.items():
    query(_name, f"WITH {TEXTS_SQL} SELECT id, {_sql} AS out FROM texts" if _sql else None)(_scalar(_fn))


@query("d8_clean_pages", f"SELECT page_id, {clean_sql('html')} AS out FROM pages")
def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("out"))


WORD = quoted(f"[^{T.WS}]+")
#: Keyword fields with junk of all kinds, made of a document's first words; every fourth has none.
KEYWORD_ROWS = f"""SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN concat_ws('،', w[1], '[' || w[2] || ']', w[3] || '…', w[4] || ':' || w[5], 'حقیقی', ' ' || w[6] || ' مدل: ' || w[7], '…', w[8] || '; ' || w[9], w[10]) END AS keywords, 'این پرسش درباره قرارداد است ' || w[1] AS question
  FROM (SELECT doc_id, regexp_extract_all(text, {WORD}) AS w FROM documents)"""


@query("d22_keyword_field", rf"""
WITH r AS ({KEYWORD_ROWS}),
c AS (SELECT id, question, replace({rr(rr("coalesce(keywords, '')", f"[{T.WS}]*مدل[{T.WS}]*:[{T.WS}]*[^\n,،؛]+", ""), "…+", "")}, {quoted(T.ZWNJ)}, ' ') AS k FROM r),
i AS (SELECT id, question, list_transform(regexp_split_to_array(k, '[،,؛;\n]+'), lambda x: {_strip(rr("x", "^[][\"' …]+|[][\"' …]+$", ""))}) AS items FROM c),
g AS (SELECT id, list_filter(items, lambda x: length(x) >= 2 AND NOT contains(x, ':') AND NOT contains(x, 'مدل') AND x NOT IN ('حقیقی', 'حقوقی', 'و') AND NOT regexp_full_match(x, '[…. ]+')) AS good,
  list_filter(regexp_extract_all(coalesce(question, ''), '[\x{{0600}}-\x{{06FF}}]+'), lambda w: length(w) > 3) AS words FROM i)
SELECT id, array_to_string(list_slice(CASE WHEN len(good) > 0 THEN good ELSE words END, 1, 6), ' ') AS out FROM g
""")
def keyword_field(spark, sf_dir):
    w = lambda k: F.get("w", F.lit(k - 1))
    junk = F.concat_ws("،", w(1), F.concat(F.lit("["), w(2), F.lit("]")), F.concat(w(3), F.lit("…")), F.concat(w(4), F.lit(":"), w(5)), F.lit("حقیقی"), F.concat(F.lit(" "), w(6), F.lit(" مدل: "), w(7)), F.lit("…"), F.concat(w(8), F.lit("; "), w(9)), w(10))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), K.words(F.col("text")).alias("w"))
    rows = rows.select("id", F.when(F.col("id") % 4 > 0, junk).alias("keywords"), F.concat(F.lit("این پرسش درباره قرارداد است "), w(1)).alias("question"))
    return rows.select("id", T.keyword_field(F.col("keywords"), F.col("question")).alias("out"))


@query("d23_keyword_list", f"WITH {TEXTS_SQL} SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,،]'), lambda x: {_strip('x')}), lambda x: x <> ''), '|') AS out FROM texts")
def keyword_list(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(T.keyword_list(F.col("text")), "|").alias("out"))


@query("d24_heading_hierarchy", rf"""
WITH {TEXTS_SQL}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM texts)
SELECT id, CAST(pos AS INTEGER) AS pos, CAST(length(regexp_extract(line, '^(#{{1,6}})[ \t]+', 1)) AS INTEGER) AS level, {_strip("regexp_extract(line, '^#{1,6}[ \\t]+(.+)$', 1)")} AS heading
FROM l WHERE regexp_matches(line, '^#{{1,6}}[ \t]+.')
""")
def heading_hierarchy(spark, sf_dir):
    line = texts(spark, sf_dir).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^#{1,6}[ \t]+."))
    return line.select("id", "pos", F.char_length(F.regexp_extract("line", r"^(#{1,6})[ \t]+", 1)).alias("level"), T.strip(F.regexp_extract("line", r"^#{1,6}[ \t]+(.+)$", 1)).alias("heading"))


# --- tokens, keywords, quality -------------------------------------------------------------------------------------------

STOP = ", ".join(map(quoted, K.STOP_SEARCH))


def search_words_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all({_translate(f'lower({x})', T.SEARCH_LETTERS)}, {quoted(K.SEARCH_TOKEN)}), lambda t: length(t) > 1 AND t NOT IN ({STOP}))"


def search_tokens_sql(x: str) -> str:
    words = search_words_sql(x)
    grams = f"flatten(list_transform(list_filter({words}, lambda t: regexp_matches(t, '[\\x{{0600}}-\\x{{06FF}}]') AND length(t) >= 3), lambda t: list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))))"
    return f"list_concat({words}, {grams})"


def encoding_sql(x: str, delete: bool = False) -> str:
    bad = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F" + (r"\x7F]" if delete else "]")
    return f"CASE WHEN length({x}) > 0 THEN 1 - CAST(length(regexp_extract_all({x}, {quoted(bad)})) AS DOUBLE) / length({x}) ELSE 0.0 END"


def ratio_sql(x: str) -> str:
    letters = rr(x, r"[^\p{L}]", "")
    return f"CASE WHEN length({letters}) > 0 THEN CAST(length(regexp_extract_all({letters}, {quoted(f'[{T.ARABIC}]')})) AS DOUBLE) / length({letters}) ELSE 0.0 END"


def quality_sql(x: str) -> str:
    return f"round(0.4 * ({encoding_sql(x)}) + 0.3 * ({ratio_sql(x)}) + 0.2 * (CASE WHEN length({_strip(x)}) > 0 THEN 1.0 ELSE 0.0 END) + 0.1 * least(length({x}) / 100.0, 1.0), 4)"


def _number(name, fn, sql):
    query(name, f"WITH {TEXTS_SQL} SELECT id, {sql} AS out FROM texts" if sql else None)(_scalar(fn))


_number("e1_estimate_tokens", K.estimate_tokens, f"CAST(2 * length(regexp_extract_all(text, {WORD})) AS BIGINT)")
_number("e2_search_tokens", lambda c: F.array_join(K.search_tokens(c), " "), f"array_to_string({search_tokens_sql('text')}, ' ')")
_number("e3_keyword_tokens", lambda c: F.array_join(K.keyword_tokens(c), " "), f"array_to_string(regexp_extract_all(lower(text), {quoted(K.KEYWORD_TOKEN)}), ' ')")
_number("e5_encoding_quality", lambda c: F.round(K.encoding_quality(c), 6), f"round({encoding_sql('text')}, 6)")
_number("e6_encoding_quality_gate", lambda c: F.round(K.encoding_quality(c, delete=True), 6), f"round({encoding_sql('text', True)}, 6)")
_number("e7_persian_ratio", lambda c: F.round(K.persian_ratio(c), 6), f"round({ratio_sql('text')}, 6)")
_number("e8_quality_score", K.quality_score, quality_sql("text"))
_number("e9_count_sentences", K.count_sentences, f"CAST(CASE WHEN length({_strip('text')}) > 0 THEN greatest(length(regexp_extract_all(text, {quoted(f'[.!؟]+[{T.WS}]+')})) + 1, 1) ELSE 0 END AS BIGINT)")
_number("e10_split_sentences", lambda c: F.array_join(K.split_sentences(c), "|"), f"array_to_string(list_filter(list_transform(string_split({rr('text', f'([.!؟?])[{T.WS}]+', chr(92) + '1' + chr(2))}, chr(2)), lambda s: {_strip('s')}), lambda s: s <> ''), '|')")
_number(
    "e11_integrity_issues", lambda c: F.array_join(K.integrity_issues(c), "|"),
    "array_to_string(list_filter([CASE WHEN contains(text, chr(65533)) THEN 'replacement character' END, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'control character' END, "
    "CASE WHEN regexp_matches(text, '(?s)[\\x{0600}-\\x{06FF}]\\?.|.\\?[\\x{0600}-\\x{06FF}]') THEN 'question mark next to an Arabic letter' END], lambda x: x IS NOT NULL), '|')",
)
def _query_type_sql() -> str:
    hits = ", ".join(f"{' + '.join(f'(CASE WHEN contains(lower(text), {quoted(w)}) THEN 1 ELSE 0 END)' for w in ws)} AS n{k}" for k, ws in enumerate(K.QUERY_TYPES.values()))
    most = f"greatest({', '.join(f'n{k}' for k in range(len(K.QUERY_TYPES)))})"
    cases = " ".join(f"WHEN n{k} = {most} THEN {quoted(name)}" for k, name in enumerate(K.QUERY_TYPES))
    return f"WITH {TEXTS_SQL}, h AS (SELECT id, {hits} FROM texts) SELECT id, CASE WHEN {most} = 0 THEN 'general' {cases} END AS out FROM h"


query("e13_query_type", _query_type_sql())(_scalar(K.query_type))


def keywords_sql(stop: list[str] = K.STOP_KEYWORDS, top: int = 15) -> str:
    return f"""
WITH {TEXTS_SQL}, l AS (SELECT id, regexp_extract_all(lower(text), {quoted(K.KEYWORD_TOKEN)}) AS ts FROM texts),
t AS (SELECT id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM l),
c AS (SELECT id, token, count(*) AS n, min(pos) AS p FROM t WHERE length(token) >= 2 AND token NOT IN ({', '.join(map(quoted, stop))}) GROUP BY ALL),
r AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY n + CASE WHEN regexp_matches(token, '^[A-Za-z0-9_.\\-]{{3,}}$') THEN 5 ELSE 0 END DESC, p) AS k FROM c)
SELECT texts.id, coalesce((SELECT string_agg(token, '|' ORDER BY k) FROM r WHERE r.id = texts.id AND k <= {top}), '') AS out FROM texts
"""


@query("e4_extract_keywords", keywords_sql())
def extract_keywords(spark, sf_dir):
    return K.extract_keywords(texts(spark, sf_dir), "id", "text").select("id", F.array_join("keywords", "|").alias("out"))


@query("e12_token_jaccard", f"""
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), {WORD})) AS ws FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(list_distinct(list_concat(a.ws, b.ws))) > 0 THEN round(CAST(len(list_intersect(a.ws, b.ws)) AS DOUBLE) / len(list_distinct(list_concat(a.ws, b.ws))), 6) ELSE 0.0 END AS out
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def jaccard(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(K.words(F.lower("text"))).alias("ws"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("next"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(K.token_jaccard(F.col("ws"), F.col("next")), 6).alias("out"))


@query("e14_preprocess")
def preprocess(spark, sf_dir):
    return K.preprocess(texts(spark, sf_dir), "id", "text")


#: A model's answers about each document: bare, fenced, within a text, an object, or none.
ANSWERS = """SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN j WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' WHEN 2 THEN 'text ' || j || ' end' WHEN 3 THEN '{"query": "' || source || '"}' ELSE 'none: ' || source END AS text
  FROM (SELECT doc_id, source, '[{"query": "' || source || '-' || doc_id || '", "type": "' || lang || '"}]' AS j FROM documents)"""


@query("e15_repaired_json", f"""
WITH a AS ({ANSWERS}),
p AS (SELECT id, coalesce(CASE WHEN json_valid(text) AND (text LIKE '[%' OR text LIKE '{{%') THEN text END, CASE WHEN json_valid(regexp_extract(text, '(?s)\\[.*\\]')) THEN regexp_extract(text, '(?s)\\[.*\\]') END) AS j FROM a)
SELECT id, coalesce(j ->> '$[0].query', j ->> '$.query', '') AS out FROM p
""")
def repaired_json(spark, sf_dir):
    one = F.concat(F.lit('[{"query": "'), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit('", "type": "'), "lang", F.lit('"}]'))
    k = F.col("doc_id") % 5
    text = F.when(k == 0, one).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), one, F.lit("\n```"))).when(k == 2, F.concat(F.lit("text "), one, F.lit(" end"))).when(k == 3, F.concat(F.lit('{"query": "'), "source", F.lit('"}'))).otherwise(F.concat(F.lit("none: "), "source"))
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))
    j = K.repaired_json(F.col("text"), "array<struct<query:string,type:string>>")
    return a.select("id", F.coalesce(F.get(j, F.lit(0))["query"], F.lit("")).alias("out"))


@query("e16_json_fields", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("i12_context_text", "SELECT doc_id, concat_ws(chr(10), 'Title: ' || substr(text, 1, 40), CASE WHEN source <> '' THEN 'Heading: ' || source END, CASE WHEN lang = 'qa_pair' THEN 'Type: Q&A' END, 'Content: ' || text) AS out FROM documents WHERE text <> ''")
def context_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text <> ''")
    return d.select("doc_id", T.context_text(F.substring("text", 1, 40), F.col("source"), F.col("lang"), F.col("text")).alias("out"))
