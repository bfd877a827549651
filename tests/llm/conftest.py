"""Small tables with the hard cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rid string, kept boolean, score string"


def prose(seed: int, n: int) -> str:
    """Words that differ from seed to seed."""
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append("".join(chr(97 + (x >> s) % 26) for s in (8, 16, 24, 32))[: 2 + (x >> 40) % 3])
    return " ".join(out)


def changed(text: str, every: int, to: str = "zzz") -> str:
    w = text.split(" ")
    return " ".join(to + str(i) if i % every == every - 1 else x for i, x in enumerate(w))


def rows() -> list[tuple]:
    base, other, far = prose(1, 400), prose(2, 300), prose(3, 250)
    texts = [
        (1, base), (2, base), (3, changed(base, 60)), (4, other), (5, other.upper()), (6, far), (7, None), (8, ""), (9, " \t\n\x0b\f\r"), (10, "one"), (11, "one"), (12, "two words"),
        (13, base[:900] + " " + prose(4, 60)), (14, prose(5, 30) + " " + " ".join(other.split(" ")[40:75]) + " " + prose(6, 30)), (15, "a b " * 40), (16, "Ünï çödé 漢字 " * 30), (17, prose(9, 6000)),
        (17, prose(9, 6000)), (None, base), (None, None), (-5, far + "  "), (2**62, "!!! ... 123"), (18, "<|endoftext|> and more"), (19, changed(prose(9, 6000), 97)),
    ]
    return [(i, t, ("en", "de", "fr", None)[k % 4], f"s{k % 3}", None, "k", "r", True, "x") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def table_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, table_rows):
    return spark.createDataFrame(table_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
