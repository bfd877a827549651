"""Preprocessing in one pass: keywords counted in their own row, and the class of characters that composition may change."""

import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from tessaria.functions import text as T
from tessaria.functions import tokens as K


def test_preprocess_shuffles_nothing(spark, capfd):
    rows = [(1, "b b a1x the x y zz zz zz"), (2, ""), (3, None), (4, "the of and"), (5, " ".join(f"w{k % 40}" for k in range(500)) + " Ä ä été été")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    out = K.preprocess(df, "id", "text")
    out.explain()
    plan = capfd.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
    assert out.columns == ["id", "cleaned", "normalised", "sentence_count", "quality_score", "keywords"]
    got = {r["id"]: r["keywords"] for r in out.collect()}
    for i, text in rows:
        words = [w for w in (text or "").lower().split() if len(w) > 1 and w not in K.STOP_KEYWORDS]
        n = Counter(words)
        want = sorted(n, key=lambda w: (-n[w] - 5 * (w.isascii() and len(w) > 2), words.index(w)))[:15]
        assert got[i] == want, i


def test_the_class_of_unstable_characters(spark):
    second = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)) | {int(d.split(" ")[1], 16) for k in range(0x110000) if (d := unicodedata.decomposition(chr(k))) and d[0] != "<" and " " in d}
    want = [k for k in range(0x300, 0x110000) if not 0xD800 <= k < 0xE000 and (k in second or unicodedata.combining(chr(k)) or not unicodedata.is_normalized("NFC", chr(k)))]
    # A block's ranges are tried only for the block's own characters.
    assert T.unstable().startswith(r"[\x{300}-\x{10FFFF}&&[")
    points = spark.range(0x110000).where("id < 55296 or id >= 57344")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    assert [r["id"] for r in points.where(char.rlike(T.unstable())).orderBy("id").collect()] == want
