"""Tokens, keywords and quality scores as native column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessaria.functions.text import ARABIC, WS, clean_text, normalise, search_letters, strip

# The stop words of search and of keyword extraction.
SEARCH_STOP_WORDS = """
از در به و با برای که این آن را شد است هستند بودند می باشد می شود می گردد می کند هر دو آیا یا اگر ولی تا باشد بر اساس طبق طریق
نیز همچنین نیز درباره بین توسط مانند مثل طی خود کنید گردد باید یک یکی شود گردد را ندارد نمی کنند می شوند می باشند
the a an is are was were be been am does do did have has had in on at to for of and or but not no so if it its this that
can will would should could may might shall
"""
KEYWORD_STOP_WORDS = """
و در به از که این را با است برای آن یک خود تا کرد بر هم نیز گفت می شد باید دو یا هر او ما شما آنها من بی پس چه اگر اما یعنی شود شده بود
شدند دارد می‌شود می‌کند داشت ندارد شوند بودن کردن شدن داشتن باشد باشند نیست هست هستند نیستند نمی بیشتر کمتر خیلی البته یکی دیگر همه چند
چون لی هنوز هیچ بین زیر روی قبل بعد همین همان آنان اینک پیش فقط بدون علاوه طی ضمن نوع manner مورد اول دوم سوم
the is at which on a an and or but in with to for of not no can had has have it its be as are was were been that this these those from by
if than then so do does did will would could should may might must shall need also very just about into through during before after above
below between same other being there here where when how what who whom why all each every both few more most some any such only own too
"""



STOP_SEARCH = sorted(set(SEARCH_STOP_WORDS.split()))
STOP_KEYWORDS = sorted(set(KEYWORD_STOP_WORDS.split()))
SEARCH_TOKEN = rf"[a-zA-Z{ARABIC}\x{{200C}}\x{{200D}}\p{{Nd}}]+"
KEYWORD_TOKEN = rf"[\p{{L}}\p{{N}}_{ARABIC}]+"
#: Words that tell the type of a query.
QUERY_TYPES = {
    "keyword_only": ["امتیاز", "اعتباری", "تسهیلات", "بازپرداخت", "ضامن", "گزارش", "اعتبارسنجی"],
    "conversational": ["می‌شه", "می‌تونم", "یه", "داشتم", "سلام", "ببخشید", "راستی"],
    "typo": ["میشه", "میکنن", "دسترسى", "اعتبارى", "قرارداد", "گزراش"],
    "reworded": ["نقش", "چیه", "چی", "تفاوت", "مراحل", "مرحله"],
}


def extract_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def words(c: Column) -> Column:
    """Runs of all but white space."""
    return extract_all(c, rf"[^{WS}]+")


def estimate_tokens(c: Column) -> Column:
    """Twice the number of words."""
    return (2 * F.size(words(F.coalesce(c, F.lit(""))))).cast("long")


def search_words(c: Column) -> Column:
    """Lower-cased words of two letters and more that are no stop words."""
    found = extract_all(search_letters(F.lower(c)), SEARCH_TOKEN)
    return F.filter(found, lambda t: (F.char_length(t) > 1) & ~t.isin(*STOP_SEARCH))


def char_grams(tokens: Column, n: int = 3) -> Column:
    """Character n-grams of the tokens that hold a letter of the Arabic script."""
    script = F.filter(tokens, lambda t: t.rlike(r"[\x{0600}-\x{06FF}]") & (F.char_length(t) >= n))
    return F.flatten(F.transform(script, lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))))


def search_tokens(c: Column) -> Column:
    """The bag of search: words, then 3-grams of words in the Arabic script."""
    # The words are bound to a name, so that they are found once.
    both = F.transform(F.array(search_words(c)), lambda found: F.when(F.rlike(c, F.lit(r"[\x{0600}-\x{06FF}]")), F.concat(found, char_grams(found))).otherwise(found))
    return F.get(both, F.lit(0))


def keyword_tokens(c: Column) -> Column:
    return extract_all(F.lower(c), KEYWORD_TOKEN)


def top_tokens(top: int):
    """A function of a column of tokens in order: of each row the most frequent, counted where the row is."""

    @F.arrow_udf(ArrayType(StringType()))
    def keywords(tokens: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        words_, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        size = max(1, len(words_))
        good = pc.and_(pc.greater_equal(pc.utf8_length(words_), 2), pc.invert(pc.is_in(words_, value_set=pa.array(STOP_KEYWORDS)))).to_numpy(zero_copy_only=False)
        more = 5 * pc.match_substring_regex(words_, r"\A[A-Za-z0-9_.\-]{3,}\z").to_numpy(zero_copy_only=False).astype(int)
        at, first, count = np.unique(np.repeat(np.arange(len(n)), n) * size + code, return_index=True, return_counts=True)
        kept = good[at % size] if len(at) else np.zeros(0, bool)
        at, first, count = at[kept], first[kept], count[kept]
        row, word = at // size, at % size
        order = np.lexsort((first, -(count + more[word] if len(at) else count), row))
        row, word = row[order], word[order]
        starts = np.searchsorted(row, np.arange(len(n) + 1))
        best = np.arange(len(row)) - starts[row] < top
        cuts = np.searchsorted(row[best], np.arange(len(n) + 1))
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words_.take(pa.array(word[best])))

    return keywords


def extract_keywords(df: DataFrame, id_col: str, text_col: str, top: int = 15) -> DataFrame:
    """(id, keywords): the most frequent tokens; ASCII words count five more, ties by first occurrence."""
    return df.select(id_col, top_tokens(top)(keyword_tokens(F.col(text_col))).alias("keywords"))


def encoding_quality(c: Column, delete: bool = False) -> Column:
    """Share of characters that are no replacement or control characters; ``delete`` counts 7F among these. Empty: 0."""
    bad = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F" + (r"\x7F]" if delete else "]")
    n = F.char_length(c)
    return F.when(n > 0, 1 - F.regexp_count(c, F.lit(bad)) / n).otherwise(F.lit(0.0))


def persian_ratio(c: Column) -> Column:
    """Share of letters that are of the Arabic script; without letters 0."""
    n = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(n > 0, F.regexp_count(c, F.lit(rf"[{ARABIC}&&\p{{L}}]")) / n).otherwise(F.lit(0.0))


def quality_score(cleaned: Column) -> Column:
    """In [0, 1]: encoding .4, script .3, not blank .2, length .1."""
    length = F.least(F.char_length(cleaned) / 100.0, F.lit(1.0))
    filled = F.when(F.char_length(strip(cleaned)) > 0, 1.0).otherwise(0.0)
    return F.round(0.4 * encoding_quality(cleaned) + 0.3 * persian_ratio(cleaned) + 0.2 * filled + 0.1 * length, 4)


def count_sentences(c: Column) -> Column:
    found = F.regexp_count(c, F.lit(rf"[.!؟]+[{WS}]+|\z"))
    return F.when(F.char_length(strip(c)) > 0, F.greatest(found, F.lit(1))).otherwise(0).cast("long")


def split_sentences(c: Column) -> Column:
    """Sentences end at a mark that white space follows."""
    return F.filter(F.transform(F.split(c, rf"(?<=[.!؟?])[{WS}]+"), strip), lambda s: s != "")


def integrity_issues(c: Column) -> Column:
    """What is wrong with a string, as a list."""
    checks = (
        ("replacement character", c.contains("�")),
        ("control character", c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")),
        ("question mark next to an Arabic letter", c.rlike(r"(?s)[\x{0600}-\x{06FF}]\?.|.\?[\x{0600}-\x{06FF}]")),
    )
    return F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in checks]))


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def query_type(c: Column) -> Column:
    """The type with most key words, the first of several; none: ``general``."""
    low = F.lower(c)
    hits = {k: sum((F.when(low.contains(w), 1).otherwise(0) for w in ws), F.lit(0)) for k, ws in QUERY_TYPES.items()}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, F.lit("general"))
    for k, n in hits.items():
        out = out.when(n == most, F.lit(k))
    return out


def preprocess(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, cleaned, normalised, keywords, sentence_count, quality_score."""
    out = df.select(id_col, clean_text(F.col(text_col)).alias("cleaned"))
    out = out.withColumn("normalised", normalise(F.col("cleaned")))
    return out.withColumns({"sentence_count": count_sentences(F.col("normalised")), "quality_score": quality_score(F.col("cleaned")), "keywords": top_tokens(15)(keyword_tokens(F.col("normalised")))})


def repaired_json(c: Column, schema: str) -> Column:
    """An answer's JSON: as it stands, in a fenced block, or its first array or object."""
    parse = lambda x: F.from_json(F.when(F.try_parse_json(x).isNotNull(), x), schema)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    array, record = F.regexp_extract(c, r"(?s)\[.*\]", 0), F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(parse(strip(c)), parse(fenced), parse(array), parse(record))
