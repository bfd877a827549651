"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Text and items are normalised to words of digits, lower-cased letters and
non-ASCII characters. Every word of the items gets a code of a fixed number of
characters, and a text is one string of its words' codes, so that the automaton
has a node for a few symbols of a word and not for each of its letters. It
holds every window of ten consecutive item words (or the whole of a shorter
item). A text is scanned once; hits are mapped to words and, where wanted, to
offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.llm.common import join_spread, keep, small_batches

WINDOW = 10
#: Most words of items in one automaton (some 200 MB in a Python worker); larger benchmarks are scanned in several blocks of items.
BLOCK_WORDS = 1 << 17
#: Symbols a place of a code has: few, as the automaton seeks a node's children one by one.
SYMBOLS = 64
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RAW_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text: str | None) -> list[bytes]:
    """The normalised words, as UTF-8."""
    return _RAW_WORD.findall(text.encode("utf-8", "surrogatepass").translate(_FOLD)) if text else []


class Windows:
    """The automaton over the windows of some items; an item is (name, its words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        names = {w for _, ws in items for w in ws}
        self.width = next(k for k in range(1, 12) if SYMBOLS**k > len(names))
        # The places of a code use symbols of their own, so that a match begins where a word does. All symbols 0 is no word.
        self.code = {w: self._encode(k) for k, w in enumerate(sorted(names), 1)}
        self.none = self._encode(0)
        held: dict[str, tuple[int, set[int]]] = {}
        for k, (_, ws) in enumerate(items):
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1 if n else 0):
                held.setdefault("".join([self.code[w] for w in ws[i : i + n]]), (n, set()))[1].add(k)
        self.auto = ahocorasick.Automaton()
        for pattern, (n, ks) in held.items():
            self.auto.add_word(pattern, (n, tuple(sorted(ks))))
        self.auto.make_automaton()

    def _encode(self, k: int) -> str:
        return "".join(chr(1 + place * SYMBOLS + k // SYMBOLS**place % SYMBOLS) for place in range(self.width))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """(which words are hit, which items have windows here)."""
        hit, found = np.zeros(len(words), bool), set()
        if words and len(self.auto):
            code, none = self.code, self.none
            for end, (n, ks) in self.auto.iter("".join([code.get(w, none) for w in words])):
                last = end // self.width
                hit[last - n + 1 : last + 1] = True
                found.update(ks)
        return hit, found


def build(items: list[tuple[str, str]], window: int = WINDOW) -> Windows:
    return Windows([(i, word_list(t)) for i, t in items], window)


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as offsets in the original text (code points)."""
    out: list[tuple[int, int]] = []
    last = -2
    for k, m in enumerate(WORD.finditer(text.translate(FOLD))):
        if hit[k]:
            if last == k - 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
            last = k
    return out


Item = tuple[str, list[bytes]]


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> Iterator[list[Item]]:
    """Items in blocks of bounded words, one block on the driver at a time; more than one only beyond the bound.

    An item of more words than a block is cut into overlapping parts, so that no window is lost. Items without a word are left out.
    An item is named by ``i`` and its id, or by ``n`` and its number where it has none.
    """
    block: list[Item] = []
    size = 0
    for k, r in enumerate(benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where(F.col("text").isNotNull()).toLocalIterator()):
        ws = word_list(r["text"])
        step = max(1, most - window + 1)
        for at in range(0, max(1, len(ws) - window + 1) if ws else 0, step):
            part = ws[at : at + step + window - 1]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((f"n{k}" if r["i"] is None else f"i{r['i']}", part))
            size += len(part)
    yield block


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: The key of a row whose hits are stored: its id, and 128 bits of its text.
KEY = ["_none", "_id", "_a", "_b"]
_held: dict[str, Windows] = {}


def _automaton(key: str, shared, window: int) -> Windows:
    """The automaton of a broadcast block, made once per Python worker, which holds one at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = Windows(shared.value, window)
    return _held[key]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_a": F.xxhash64("text"), "_b": F.xxhash64("text", F.lit(1))})


def _judged(words: list[bytes], text: str | None, hit: np.ndarray, names: set[str]) -> tuple:
    own = ",".join(sorted(n[1:] for n in names if n[0] == "i"))
    cuts = [{"start": s, "end": e} for s, e in spans(text, hit)] if names else []
    return len(words), int(hit.sum()), len(names), hashlib.sha256(own.encode()).hexdigest(), bool(hit.any()), cuts


def _result(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), _SPANS]
    return pa.RecordBatch.from_arrays([doc_ids, *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], [f.split()[0] for f in RESULT.split(", ")])


def _one_block(docs: DataFrame, block: list[Item], window: int) -> DataFrame:
    """The result where all items fit in one automaton: one scan, nothing is stored or shuffled."""
    items, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(key, items, window)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, out = whole.slice(at, 512), []
                for t in b.column(1):
                    t = t.as_py()
                    w = word_list(t)
                    hit, found = auto.scan(w)
                    out.append(_judged(w, t, hit, {items.value[k][0] for k in found}))
                yield _result(b.column(0), out)

    return docs.mapInArrow(run, RESULT)


def _block_hits(docs: DataFrame, block: list[Item], window: int) -> DataFrame:
    """The keys of the rows that hold a window of a block's items, with which words are hit, as bits, and the items' names."""
    items, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(key, items, window)
        for b in batches:
            rows, bits, names = [], [], []
            for k, t in enumerate(b.column(0)):
                hit, found = auto.scan(word_list(t.as_py()))
                if found:
                    rows.append(k)
                    bits.append(np.packbits(hit).tobytes())
                    names.append(sorted({items.value[i][0] for i in found}))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows, pa.int64())) for c in b.columns[1:]], pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))], [*KEY, "hit", "items"])

    return _keyed(docs).select("text", *KEY).mapInArrow(run, "_none boolean, _id string, _a long, _b long, hit binary, items array<string>")


def _stored_hits(docs: DataFrame, first: list[list[Item]], rest: Iterator[list[Item]], window: int) -> DataFrame:
    """The hits of all blocks. Each block is a job of its own, whose hits are written before the next begins, so that no worker ever holds two automata."""
    tables = [keep(_block_hits(docs, block, window), "hits")[0] for block in chain(first, rest)]
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.distinct()  # rows that repeat have the same hits; a row per block is left of each


def _first_two(found: Iterator[list[Item]]) -> list[list[Item]]:
    return list(islice(found, 2))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word inside any occurrence of an item's window is hit; an item of fewer
    words than a window, but not none, is one window. Null and empty texts have no
    words, nor have null items. Repeated documents are judged one by one. An item
    repeated under one id counts once; items without an id hit as others do and
    count each by itself, but have no place in items_sha256. Other columns are
    ignored. An empty benchmark contaminates nothing, an empty table gives an empty
    result. spans are runs of hit words as code point offsets in the original
    text. A benchmark of one block is one scan without a shuffle; of a larger one
    each block is a scan, whose hits, the only rows that are shuffled, are stored and joined.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = blocks(benchmark, window, block_words)
    first = _first_two(found)
    if len(first) == 1:
        return _one_block(rows, first[0], window)
    hits = _stored_hits(rows, first, found, window).groupBy(*KEY).agg(F.collect_list("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("names"))
    joined = join_spread(_keyed(rows).withColumn("_at", F.spark_partition_id()), hits, KEY, ["_at"], "left").select("doc_id", "text", "hits", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, out = whole.slice(at, 512), []
                for t, hits, names in zip(b.column(1), b.column(2), b.column(3), strict=True):
                    t = t.as_py()
                    w = word_list(t)
                    hit = np.zeros(len(w), bool)
                    for bits in hits.as_py() or ():
                        hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(w)).astype(bool)
                    out.append(_judged(w, t, hit, set(names.as_py() or ())))
                yield _result(b.column(0), out)

    return joined.mapInArrow(run, RESULT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no window of any item, with their own columns.

    Null texts and texts without a word stay, rows that repeat each for itself. A
    benchmark of one block is one scan; of a larger one, rows are held against the stored keys of the rows with hits.
    """
    names, at = small_batches(docs).columns, docs.columns.index("text")
    found = blocks(benchmark, window, block_words)
    first = _first_two(found)
    if len(first) > 1:
        own = [F.col(c).alias(f"_own{k}") for k, c in enumerate(names)]
        back = [F.col(f"_own{k}").alias(c) for k, c in enumerate(names)]
        keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own)).withColumn("_at", F.spark_partition_id())
        hits = _stored_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), first, found, window).select(*KEY).distinct().withColumn("_hit", F.lit(True))
        return join_spread(keyed, hits, KEY, ["_at"], "left").where(F.col("_hit").isNull()).select(*back)
    items, key = docs.sparkSession.sparkContext.broadcast(first[0]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(key, items, window)
        for b in batches:
            ok = [not auto.scan(word_list(t.as_py()))[1] for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns], names)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
