"""Variants of a query, made from a table of its words.

A format is a recipe: how many inner words go, how many get a synonym, how many
change places, and what is put around them. Candidates of all formats are one
table of words, in which each choice is an order or a share of hashes of (id,
format, candidate, place), so that a variant is the same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.functions.text import ZWNJ, keyword_field
from tessaria.functions.tokens import token_jaccard, words

# Synonyms, phrases, typing errors, difficulties and similarity bands.
SYNONYMS = {
    "قرارداد": ["عقد", "توافق‌نامه"], "آغاز": ["شروع"], "فرآیند": ["روند"], "ثبت": ["قید", "درج"], "نامه": ["مکاتبه"], "امضا": ["تایید"], "ارسال": ["فرستادن"],
    "مدارک": ["اسناد", "مستندات"], "سرویس": ["خدمت", "وب‌سرویس"], "دسترسی": ["ورود"], "بررسی": ["بازبینی", "تأیید"], "پرداخت": ["تسویه"], "گزارش": ["خروجی"],
    "مشتری": ["کاربر", "متقاضی"], "اثرگذار": ["تاثیرگذار", "موثر"], "لازم": ["الزامی", "ضروری"], "تاخیر": ["دیرکرد", "تأخیر"],
}
PREFIXES = ["لطفاً بگویید ", "ممکن است توضیح دهید که ", "می‌خواهم بدانم ", "در این باره بگویید که "]
ENDINGS = ["؟", " . لطفاً دقیق توضیح دهید.", " . اگر جزئیات دارید در میان بگذارید."]
FILLERS = ["در این بخش", "طبق متن", "بر اساس اسناد", "در عمل", "همان‌طور که اشاره شد"]
GREETINGS = ["ببخشید، ", "سلام، ", "راستی، ", "یه سوال داشتم، "]
TYPOS = {"دسترسی": "دسترسى", "می‌شود": "میشود", "می‌کنند": "میکنند", "اعتباری": "اعتبارى", "گزارش": "گزراش"}
SPOKEN = {"می‌شود": "میشه", "می‌شوند": "میشن", "می‌توانم": "می‌تونم", "می‌توان": "می‌شه", "به‌طور": "به صورت", "اینکه": "که"}
DIFFICULTY = {"verbatim": "easy", "paraphrase": "medium", "typo": "medium", "reworded": "hard", "keyword_only": "hard", "conversational": "hard"}
BANDS = {"verbatim": (0.8, 1.0), "paraphrase": (0.45, 0.79), "typo": (0.4, 0.85), "reworded": (0.05, 0.44), "keyword_only": (0.0, 0.3), "conversational": (0.05, 0.45)}


@dataclass(frozen=True)
class Recipe:
    """Inner words that go, in percent; words that get a synonym and inner words that change places, at most; typing errors, in percent each; spoken forms; what stands before and after, and how often."""

    drop: int = 0
    synonyms: int = 0
    moves: int = 0
    errors: int = 0
    spoken: bool = False
    before: tuple[tuple[str, ...], ...] = ()
    wrapped: int = 0


EVERY = 1 << 30
RECIPES = {
    "paraphrase": Recipe(synonyms=5, moves=2, before=(tuple(PREFIXES),), wrapped=80),
    "reworded": Recipe(drop=40, synonyms=EVERY, moves=3, before=(tuple(PREFIXES), tuple(f"{x} " for x in FILLERS)), wrapped=100),
    "typo": Recipe(errors=50),
    "conversational": Recipe(spoken=True, before=(tuple(GREETINGS),), wrapped=100),
}
_CANDIDATE = ["query_id", "format", "turn"]


def _of(field: str) -> Column:
    """A recipe's number for the row's format."""
    return F.element_at(F.create_map(*[F.lit(x) for f, r in RECIPES.items() for x in (f, int(getattr(r, field)))]), F.col("format"))


def _hash(*place: Column | str) -> Column:
    return F.xxhash64(F.col("query_id").cast("string"), "format", "turn", *[F.lit(p) if isinstance(p, str) else p for p in place])


def _share(percent: Column, *place: Column | str) -> Column:
    return F.pmod(_hash(*place), F.lit(100)) < percent


def _one_of(options: Column, place: Column | str) -> Column:
    return F.get(options, F.pmod(_hash(place), F.size(options)).cast("int"))


def _texts(options) -> Column:
    return F.array(*map(F.lit, options))


def _word_table(candidates: DataFrame) -> DataFrame:
    """query_id, format, turn, text: the candidates' words after drops, synonyms and moves, put together again."""
    inner = (F.col("at") > 0) & (F.col("at") < F.col("n") - 1)
    by = Window.partitionBy(*_CANDIDATE)  # a question's words
    rows = candidates.select(*_CANDIDATE, F.posexplode(words(F.col("question"))).alias("at", "word")).withColumn("n", F.count(F.lit(1)).over(by))
    place = lambda turn: F.row_number().over(by.orderBy((~inner).cast("int"), _hash(turn, F.col("at")), "at"))
    share = F.least(F.greatest(F.lit(1), F.floor(F.col("n") * _of("drop") / 100)), F.col("n") - 2)
    rows = rows.withColumn("_d", place("drop")).where(~(inner & (F.col("n") > 4) & (_of("drop") > 0) & (F.col("_d") <= share)))
    # Words keep their places' order; those that move take each other's places in a ring.
    rows = rows.withColumns({"at": (F.row_number().over(by.orderBy("at")) - 1).cast("int"), "n": F.count(F.lit(1)).over(by)})
    rows = rows.withColumn("_m", place("move"))
    moved = inner & (F.col("n") > 3) & (F.col("_m") <= F.least(_of("moves"), F.col("n") - 3))
    rows = rows.withColumn("_ring", F.when(moved, F.col("_m")))
    to = F.coalesce(F.lead("at").over(by.orderBy(F.col("_ring").asc_nulls_last(), "at")), F.lit(-1))
    first, last = F.min_by("at", "_ring").over(by), F.max("_ring").over(by)
    rows = rows.withColumns({"_next": to, "_first": first, "_last": last})
    rows = rows.withColumn("to", F.when(F.col("_ring").isNull(), F.col("at")).when(F.col("_ring") == F.col("_last"), F.col("_first")).otherwise(F.col("_next")))
    known = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), _texts(v))])
    rows = rows.withColumn("_stem", F.regexp_replace("word", "،+$", "")).withColumn("_options", F.element_at(known, F.col("_stem")))
    rows = rows.withColumn("_s", F.count("_options").over(by.orderBy("to").rowsBetween(Window.unboundedPreceding, 0)))
    swapped = F.concat(_one_of(F.col("_options"), F.concat(F.lit("synonym"), F.col("at").cast("string"))), F.expr("substring(word, char_length(_stem) + 1)"))
    rows = rows.withColumn("word", F.when(F.col("_options").isNotNull() & (F.col("_s") <= _of("synonyms")), swapped).otherwise(F.col("word")))
    return rows.groupBy(*_CANDIDATE).agg(F.array_sort(F.collect_list(F.struct("to", "word"))).alias("ws")).select(*_CANDIDATE, F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("text"))


def _with_errors(text: Column) -> Column:
    """Each known typing error once, by its own chance, and a joiner that is left out."""
    wrong = F.array(*[F.struct(F.lit(f"error{k}").alias("place"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate([*TYPOS.items(), (ZWNJ, "")])])
    ahead = lambda t, x: F.call_function("substring_index", t, x["a"], F.lit(1))
    cut = lambda t, x: F.concat(ahead(t, x), x["b"], F.substr(t, F.char_length(ahead(t, x)) + F.char_length(x["a"]) + 1))
    return F.aggregate(wrong, text, lambda t, x: F.when(F.contains(t, x["a"]) & _share(_of("errors"), x["place"]), cut(t, x)).otherwise(t))


def _as_spoken(text: Column) -> Column:
    text = F.regexp_replace(text, "؟+$", "")
    for written, said in SPOKEN.items():
        text = F.replace(text, F.lit(written), F.lit(said))
    return text


def _wrapped(text: Column) -> Column:
    """The text between what its format puts before and after it."""
    before = F.lit("")
    for fmt, r in RECIPES.items():
        before = F.when(F.col("format") == fmt, F.concat(F.lit(""), *[_one_of(_texts(b), f"before{k}") for k, b in enumerate(r.before)])).otherwise(before)
    return F.when(_share(_of("wrapped"), "wrap"), F.concat(before, text, _one_of(_texts(ENDINGS), "after"))).otherwise(text)


def made(questions: DataFrame, tries: int = 9) -> DataFrame:
    """query_id, format, query of the formats in RECIPES: of so many candidates the first within the format's band of similarity, else the last. Ids are unique."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("turn")
    all_ = questions.where(F.col("question").isNotNull()).select("query_id", "question", F.explode(_texts(RECIPES)).alias("format")).select("*", turns)
    cooked = F.col("format").isin(*[f for f, r in RECIPES.items() if r.drop or r.synonyms or r.moves])
    parts = _word_table(all_.where(cooked)).join(all_.where(cooked).select(*_CANDIDATE, "question"), _CANDIDATE, "right").withColumn("text", F.coalesce("text", F.lit("")))
    both = parts.unionByName(all_.where(~cooked).withColumn("text", F.col("question")))
    both = both.withColumn("text", F.when(_of("errors") > 0, _with_errors(F.col("text"))).when(_of("spoken") > 0, _as_spoken(F.col("text"))).otherwise(F.col("text"))).withColumn("text", _wrapped(F.col("text")))
    near = F.coalesce(token_jaccard(F.array_distinct(words(F.col("text"))), F.array_distinct(words(F.col("question")))), F.lit(0.0))
    low, high = (F.element_at(F.create_map(*[F.lit(x) for f, b in BANDS.items() for x in (f, b[k])]), F.col("format")) for k in (0, 1))
    order = F.when(near.between(low, high), F.col("turn")).otherwise(2 * tries - F.col("turn"))
    return both.groupBy("query_id", "format").agg(F.min_by("text", order).alias("query"))


def verbatim(q: Column) -> Column:
    return F.regexp_replace(q, "؟+$", "")


def difficulty(fmt: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DIFFICULTY.items() for x in kv]), fmt), F.lit("medium"))


def all_variants(questions: DataFrame, formats: list[str] | None = None, tries: int = 9) -> DataFrame:
    """query_id, format, difficulty, query, similarity, from questions (query_id, question, keywords); an unknown format is taken as verbatim."""
    rows = questions.select("query_id", "question", "keywords", F.explode(_texts(formats or list(DIFFICULTY))).alias("format"))
    rows = rows.join(made(questions, tries).withColumnRenamed("query", "_made"), ["query_id", "format"], "left")
    q = F.when(F.col("format") == "keyword_only", keyword_field(F.col("keywords"), F.col("question"))).when(F.col("format").isin(*RECIPES), F.col("_made")).otherwise(verbatim(F.col("question")))
    rows = rows.withColumn("query", q)
    return rows.select("query_id", "format", difficulty(F.col("format")).alias("difficulty"), "query", F.round(token_jaccard(F.array_distinct(words(F.col("query"))), F.array_distinct(words(F.col("question")))), 6).alias("similarity"))
