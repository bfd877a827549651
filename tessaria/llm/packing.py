"""Packing: first-fit decreasing on a tournament tree of bin capacities.

Documents are dealt into randomised groups of bounded size, and each group is
packed by itself. A document longer than a sequence gives its full sequences
first; what remains is packed first-fit decreasing: the tournament tree holds
the most free places below each node, so that the first bin with room is found
in logarithmic time. The emptiest bins are then cut up to fill the gaps of the
others. What is left over in a group, less than one sequence, is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.llm import tokens
from tessaria.llm.common import small_batches

LENGTH = 2048
#: The id after each document.
END_ID = 1
GROUP_DOCS = 2048
SEED = 17

PIECES = "bundle int, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bins in order of opening; each inner node holds the most free places of its two sides."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.width)

    def first(self, need: int) -> int:
        """The first bin with room for ``need``."""
        node, most = 1, self.most
        while node < self.width:
            node *= 2
            if most[node] < need:
                node += 1
        return node - self.width

    def take(self, which: int, n: int) -> None:
        node, most = which + self.width, self.most
        most[node] -= n
        node //= 2
        while node:
            top = max(most[2 * node], most[2 * node + 1])
            if most[node] == top:
                break
            most[node] = top
            node //= 2


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by bin; items must fit a bin. Equal lengths keep their order."""
    tree = Tournament(max(1, len(lengths)), capacity)
    bins: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = tree.first(lengths[k])
        tree.take(b, lengths[k])
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def close_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Cuts the emptiest bins' pieces (item, start, length) into the gaps of the fullest; then at most one bin isn't full,
    and that is cut into bins whose lengths are powers of two."""
    size = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-size[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        b, donor = order[lo], bins[order[hi]]
        gap = capacity - size[b]
        if gap == 0:
            lo += 1
        elif not donor:
            hi -= 1
        else:
            item, start, n = donor[-1]
            cut = min(gap, n)
            if cut == n:
                donor.pop()
            else:
                donor[-1] = (item, start, n - cut)
            bins[b].append((item, start + n - cut, cut))
            size[b] += cut
            size[order[hi]] -= cut
    out = [bins[b] for b in order if bins[b]]
    if out and (left := sum(p[2] for p in out[-1])) < capacity and left & (left - 1):
        rest = out.pop()
        for bit in reversed(range(left.bit_length())):
            want, part = left & (1 << bit), []
            while want:
                item, start, n = rest.pop(0)
                cut = min(want, n)
                part.append((item, start, cut))
                want -= cut
                if cut < n:
                    rest.insert(0, (item, start + cut, n - cut))
            if part:
                out.append(part)
    return out


def pieces(docs: DataFrame, groups: int, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Each document's full sequences and what remains; only what remains carries its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoding(path)
        wide = np.uint32 if enc.max_token_value >= 1 << 16 else np.uint16
        names, kinds = zip(*[(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in PIECES.split(", ")], strict=True)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out: list[tuple] = []
                for g, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    got = np.append(tokens.ids(enc, t.as_py()), np.uint32(END_ID)).astype("<u4")
                    total = len(got)
                    for s in range(0, total - total % length, length):
                        out.append((g, d, s, length, total, zlib.crc32(got[s : s + length].tobytes()), None))
                    if rest := total % length:
                        out.append((g, d, total - rest, rest, total, None, got[total - rest :].astype(wide).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    group = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(groups)).cast("int")
    return docs.select(group.alias("bundle"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack_group(pdf: pd.DataFrame, length: int = LENGTH, wide=np.uint16) -> pd.DataFrame:
    """Packs one group's pieces; sequence ids begin with the group's number."""
    pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    doc, start, size, total, crc, raw = (pdf[c].tolist() for c in ("doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"))
    whole = [k for k in range(len(pdf)) if raw[k] is None]
    part = [k for k in range(len(pdf)) if raw[k] is not None]
    bins = [[(part[i], 0, size[part[i]]) for i in b] for b in first_fit_decreasing([size[k] for k in part], length)]
    base, rows = int(pdf["bundle"].iloc[0]) << 32, []
    for n, k in enumerate(whole):
        rows.append((doc[k], start[k], size[k], int(crc[k]), total[k], base + n, 0))
    for n, b in enumerate(close_gaps(bins, length), len(whole)):
        at = 0
        for k, s, m in b:
            ids = np.frombuffer(raw[k], wide)[s : s + m].astype("<u4")
            rows.append((doc[k], start[k] + s, m, zlib.crc32(ids.tobytes()), total[k], base + n, at))
            at += m
    out = pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT.split(", ")])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with id 1; a null or empty text has that id alone. Each id
    lies in exactly one piece, sequences have at most ``length`` ids, and offsets in
    a sequence are gapless from 0. Rows that repeat a doc_id, or have none, are packed
    each for itself. Columns other than doc_id and text are ignored; an empty table
    gives an empty result. Groups are dealt by a seeded hash of id and text, so that
    their expected size is ``group_docs`` whatever the input's size or order.
    """
    groups = max(1, -(-small_batches(docs).count() // group_docs))
    wide = np.uint32 if tokens.encoding(path).max_token_value >= 1 << 16 else np.uint16

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_group(pdf, length, wide)

    return pieces(docs, groups, path, length).groupBy("bundle").applyInPandas(run, RESULT)
