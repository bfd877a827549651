"""Substring dedup: prefix-partitioned suffix trees over words.

A window of twenty words that also starts earlier in the corpus is a repeat. The
corpus' word suffixes are cut at twenty words and split into groups that fit a
task's memory. The words by which they are dealt out are of variable length: in
general a suffix' anchor, the least by hash of its 8-word grams, which equal
suffixes have in common, and where an anchor is too frequent all twenty words. A
group's suffix tree is laid out by naming: a suffix' node at depth 2d is the pair
of the nodes at depth d that it and the suffix d words further on lie under. Depth
one is the words themselves, so that equal nodes are equal words. The nodes twenty
words deep with several leaves are the repeats: all leaves but the first go, and
repeats that follow on one another in a document make up a maximal one.

Three things keep the volume small. Only suffixes that can be repeats enter the
trees: those whose anchor occurs twice in the corpus. Neighbouring suffixes with
one anchor travel as one segment of text, some 26 words for seven suffixes. And of
segments that are equal byte by byte a task sends the first alone, since the others
are repeats already; a passage that is in a third of all documents therefore
costs one segment per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.llm import words
from tessaria.llm.common import keep, small_batches

U = np.uint64
WINDOW, GRAM = 20, 8
#: An anchor that occurs more often is hot: its suffixes are dealt out by all their words.
HOT = 1 << 13
#: Words of segments in a group, text bytes per group of anchors, and anchors and bytes of segments that a task sorts at once.
GROUP_WORDS, GROUP_BYTES, RUN, RUN_BYTES = 1 << 20, 16 << 20, 1 << 20, 16 << 20


class Words:
    """The words of some rows, their hashes and which windows there are."""

    def __init__(self, col: pa.Array, window: int):
        self.data, self.off = words.buffers(col)
        self.h, self.start, self.end, self.first = words.words(self.data, self.off, words.PLAIN)
        self.count = np.diff(self.first)
        n = np.maximum(0, self.count - window + 1)
        self.row = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n)  # start in its row
        self.word = self.at + self.first[:-1][self.row]  # its first word here

    def anchors(self, window: int) -> np.ndarray:
        """Each window's anchor, as the word here that it begins with."""
        gram = min(GRAM, window)
        self.grams = words.grams(self.h, gram)
        wide = window - gram + 1
        if len(self.grams) < wide or not len(self.word):
            return np.zeros(0, np.int64)
        return self.word + np.lib.stride_tricks.sliding_window_view(self.grams, wide)[self.word].argmin(1)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)


def _cuts(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A stable order by part, and the runs of parts in it."""
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(_changes(part[order]))
    return order, list(zip(at.tolist(), [*at[1:].tolist(), len(part)], strict=True)) if len(part) else []


def _unblob(raw: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind)


def _run(turn: int) -> int:
    """The number of a task's run, the same when the task is tried again."""
    return (TaskContext.get().partitionId() << 24) + turn


def _any(run: int, parts: int) -> int:
    """A part for what may pass through any, another for each run."""
    return int(words.mix(np.array([run + 1], U))[0] % U(parts))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _by_row(answers: DataFrame, merge) -> DataFrame:
    """(rid, pos): each run puts together what all groups have answered; merge gives rid and pos of its places, and a row per document is made of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rid, pos = merge(pdf)
        order = np.lexsort((pos, rid))
        rid, pos = rid[order], pos[order].astype("<i4")
        cut = np.flatnonzero(_changes(rid))
        return pd.DataFrame({"rid": rid[cut], "pos": [pos[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(rid)], strict=True)]})

    return answers.groupBy("run").applyInPandas(run, "rid long, pos binary")


# --- anchors that occur more than once -----------------------------------------------------------------------------------

#: A run's first occurrences of anchors, with how often each occurs in it; and a row without h, which passes through: the
#: further ones, with the part and the place there of their first one.
ANCHORS = "run long, part int, h binary, pos binary, times binary, new binary, rid binary, firsts binary"
ANSWERS = "run long, part int, pos binary, new binary, rid binary, hot binary, firsts binary"
HOT_BIT = np.int32(-(1 << 31))


def repeated_anchors(rows: DataFrame, parts: int, window: int) -> DataFrame:
    """(rid, pos): where the anchors start that occur more than once; the sign bit is set where they are hot."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids: list[np.ndarray] = []
        size = docs = turn = 0

        def flush() -> pa.RecordBatch:
            h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            rid, run = np.concatenate(ids), _run(turn)
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(_changes(h[order]))
            times = np.diff(np.append(first, len(h)))
            lead = order[first]
            sent, rank = np.sort(lead), np.argsort(lead)
            part = ((h[sent] >> U(24)) % U(parts)).astype(np.int32)
            often = np.minimum(times[rank], 65535).astype(np.uint16)
            by, cuts = _cuts(part)
            place, out = np.zeros(len(sent), np.int32), []
            for a, b in cuts:
                i = by[a:b]
                place[i] = np.arange(b - a)
                at = sent[i]
                new = _changes(doc[at])
                out.append((run, int(part[i[0]]), h[at].tobytes(), pos[at].tobytes(), often[i].tobytes(), new.tobytes(), rid[doc[at][new]].tobytes(), b""))
            more = np.ones(len(h), bool)
            more[lead] = False
            if more.any():
                of = np.zeros(len(h), np.int64)
                of[order] = np.repeat(np.searchsorted(sent, lead), times)
                at = np.flatnonzero(more)
                new = _changes(doc[at])
                firsts = (part[of[at]].astype(np.int64) << 32) | place[of[at]]
                out.append((run, _any(run, parts), b"", pos[at].tobytes(), b"", new.tobytes(), rid[doc[at][new]].tobytes(), firsts.tobytes()))
            held.clear()
            ids.clear()
            return _batch(out, ANCHORS)

        for b in batches:
            for s in words.slices(b, "text"):
                w = Words(s.column(1), window)
                anchor = w.anchors(window)
                if len(anchor):
                    once = _changes(anchor) | _changes(w.row)  # anchors never step back
                    anchor, row = anchor[once], w.row[once]
                    held.append((w.grams[anchor], (row + docs).astype(np.int32), (anchor - w.first[:-1][row]).astype(np.int32)))
                    ids.append(s.column(0).to_numpy(zero_copy_only=False))
                    docs += s.num_rows
                    size += len(anchor)
                    if size >= RUN:
                        yield flush()
                        size, docs, turn = 0, 0, turn + 1
        if size:
            yield flush()

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each run its anchors that occur twice, and which are hot."""
        passed, sent = pdf[pdf["h"].str.len() == 0], pdf[pdf["h"].str.len() > 0]
        out = [(r.run, -1, r.pos, r.new, r.rid, b"", r.firsts) for r in passed.itertuples()]
        h, times = _unblob(sent["h"], U), _unblob(sent["times"], np.uint16).astype(np.int64)
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(_changes(h[order]))
        total = np.zeros(len(h), np.int64)
        if len(h):
            total[order] = np.repeat(np.add.reduceat(times[order], first), np.diff(np.append(first, len(h))))
        ends = np.cumsum(sent["h"].str.len().to_numpy(int) // 8) if len(sent) else []
        for r, a, b in zip(sent.itertuples(), [0, *ends][:-1], ends, strict=True):
            at = np.flatnonzero(total[a:b] > 1)
            if len(at):
                doc = np.cumsum(np.frombuffer(r.new, bool)) - 1
                new = _changes(doc[at])
                out.append((r.run, r.part, np.frombuffer(r.pos, np.int32)[at].tobytes(), new.tobytes(), np.frombuffer(r.rid, np.int64)[doc[at][new]].tobytes(), (total[a:b][at] > HOT).tobytes(), at.astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=[f.split()[0] for f in ANSWERS.split(", ")])

    def merge(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The further occurrences are as hot as their first ones."""
        rid = _unblob(pdf["rid"], np.int64)[np.cumsum(_unblob(pdf["new"], bool)) - 1]
        pos, firsts = _unblob(pdf["pos"], np.int32).copy(), _unblob(pdf["firsts"], np.int64)
        part = np.repeat(pdf["part"].to_numpy(np.int64), pdf["pos"].str.len().to_numpy(int) // 4)
        hot, own = np.zeros(len(pos), bool), part >= 0
        hot[own] = _unblob(pdf.loc[pdf["part"] >= 0, "hot"], bool)
        where = np.where(own, (part << 32) | firsts, firsts)
        hot[~own] = np.isin(where[~own], where[own & hot])
        pos[hot] |= HOT_BIT
        return rid, pos

    return _by_row(rows.select("rid", "text").mapInArrow(find, ANCHORS).groupBy("part").applyInPandas(judge, ANSWERS), merge)


# --- suffixes ------------------------------------------------------------------------------------------------------------


class Segments:
    """The rows' suffixes whose anchors are repeated, as runs of neighbours with one anchor; a hot anchor's are apart."""

    def __init__(self, col: pa.Array, flags: pa.Array, window: int):
        self.words = w = Words(col, window)
        anchor = w.anchors(window)
        state = np.zeros(len(w.h) + 1, np.int8)
        for k, lists in enumerate(flags.to_pylist()):
            for raw in lists or ():
                at = np.frombuffer(raw, "<i4")
                state[(at & ~HOT_BIT) + w.first[k]] = np.where(at < 0, 2, 1)
        of = state[anchor] if len(anchor) else np.zeros(0, np.int8)
        chosen = np.flatnonzero(of)
        new = _changes(anchor[chosen]) | _changes(w.row[chosen]) | (of[chosen] == 2)
        first = np.flatnonzero(new)
        self.suffixes = np.diff(np.append(first, len(chosen)))  # of each segment
        at = chosen[first]
        self.hot, self.row, self.at, self.word, self.anchor = of[at] == 2, w.row[at], w.at[at], w.word[at], anchor[at] if len(anchor) else at
        self.size = self.suffixes + window - 1  # in words


def _digest(data: bytes) -> tuple[int, str]:
    found = data.split()  # at ASCII white space alone
    return len(found), hashlib.sha256(b" ".join(found)).hexdigest()


MARKED = "kind int, rid long, ord long, doc_id long, n_words long, kept_sha256 string, text string, flags array<binary>, words long, hot_words long"


def marked(rows: DataFrame, flags: DataFrame, window: int) -> DataFrame:
    """Kind 0: documents that no repeat can be in, with their result. 1: the others, with text and anchors. 2: a task's words of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in MARKED.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.binary()), pa.int64(), pa.int64()]
        cool = hot = 0
        for b in batches:
            for s in words.slices(b, "text"):
                got = Segments(s.column(3), s.column(4), window)
                w = got.words
                hot += int(got.size[got.hot].sum())
                cool += int(got.size[~got.hot].sum())
                some = np.zeros(s.num_rows, bool)
                some[got.row] = True
                done = [(None, None) if m else _digest(w.data[w.off[k] : w.off[k + 1]].tobytes()) for k, m in enumerate(some)]
                cols = [pa.array(some.astype(np.int32)), s.column(0), s.column(1), s.column(2), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())]
                cols += [pa.array([t.as_py() if m else None for t, m in zip(s.column(3), some, strict=True)], kinds[6]), pa.array([f if m else None for f, m in zip(s.column(4).to_pylist(), some, strict=True)], kinds[7])]
                cols += [pa.nulls(s.num_rows, kinds[8]), pa.nulls(s.num_rows, kinds[9])]
                yield pa.RecordBatch.from_arrays(cols, names)
        yield pa.RecordBatch.from_arrays([pa.array([2], kinds[0]), *[pa.nulls(1, k) for k in kinds[1:8]], pa.array([cool], kinds[8]), pa.array([hot], kinds[9])], names)

    by_row = flags.groupBy("rid").agg(F.collect_list("pos").alias("flags"))
    return rows.join(by_row.hint("shuffle_hash"), "rid", "left").select("rid", "ord", "doc_id", "text", "flags").mapInArrow(run, MARKED)


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes alone."""
    size = end - start
    off = np.append(0, np.cumsum(size))
    held = data[np.arange(off[-1]) + np.repeat(start - off[:-1], size)]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(held)]).dictionary_encode().indices.to_numpy()


def nodes(ids: np.ndarray, depth: int) -> np.ndarray:
    """The node of the suffix tree, ``depth`` words deep, under which each suffix of the sequence lies; those beyond its end are of no use."""

    def below(node: np.ndarray, by: int) -> np.ndarray:
        further = np.append(node[by:], np.zeros(min(by, len(node)), node.dtype))
        return np.unique((node.astype(np.int64) << 32) | further, return_inverse=True)[1].astype(np.int64)

    node, deep = ids, 1
    while 2 * deep <= depth:
        node, deep = below(node, deep), 2 * deep
    return below(node, depth - deep) if deep < depth else node


#: A run's segments in a group; and a row without text, which passes through: places that are known as repeats.
LEAVES = "run long, part int, text binary, size binary, suffixes binary, pos binary, new binary, rid binary, ord binary"
PLACES = "run long, pos binary, new binary, rid binary"


def repeats(hits: DataFrame, groups: int, hot_groups: int, window: int) -> DataFrame:
    """(rid, pos): where the windows start that also start earlier. hits: rid, ord, text, flags."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        held: list[tuple[np.ndarray, ...]] = []
        ids: list[tuple[np.ndarray, np.ndarray]] = []
        size = docs = turn = 0

        def flush() -> pa.RecordBatch:
            part, suffixes, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            rid, ord_ = (np.concatenate(x) for x in zip(*ids, strict=True))
            run = _run(turn)
            order = np.lexsort((pos, rid[doc], ord_[doc]))
            seen: dict[bytes, int] = {}
            lead, gone = [], []
            for k, r, p in zip(order.tolist(), rid[doc[order]].tolist(), pos[order].tolist(), strict=True):
                first = seen.setdefault(texts[k], k)
                if first == k:
                    lead.append(k)
                elif rid[doc[first]] != r or pos[first] != p:  # else the same place, as rows may be repeated
                    gone.append(k)
            lead, gone, out = np.array(lead), np.array(gone, np.int64), []
            by, cuts = _cuts(part[lead])
            for a, b in cuts:
                at = lead[by[a:b]]
                new = _changes(doc[at])
                raw = [texts[k] for k in at.tolist()]
                fields = (np.array([len(t) for t in raw], np.int32), suffixes[at].astype(np.int32), pos[at].astype(np.int32))
                out.append((run, int(part[at[0]]), b"".join(raw), *[f.tobytes() for f in fields], new.tobytes(), rid[doc[at][new]].tobytes(), ord_[doc[at][new]].tobytes()))
            if len(gone):
                n = suffixes[gone]
                place = np.repeat(pos[gone] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                owner = np.repeat(doc[gone], n)
                new = _changes(owner)
                out.append((run, _any(run, groups + hot_groups), b"", b"", b"", place.astype(np.int32).tobytes(), new.tobytes(), rid[owner[new]].tobytes(), b""))
            for x in (texts, held, ids):
                x.clear()
            return _batch(out, LEAVES)

        for b in batches:
            for s in words.slices(b, "text"):
                got = Segments(s.column(2), s.column(3), window)
                if not len(got.row):
                    continue
                w = got.words
                part = (words.mix(w.grams[got.anchor]) % U(groups)).astype(np.int64)
                if got.hot.any():
                    part[got.hot] = groups + (words.mix(words.grams(w.h, window)[got.word[got.hot]]) % U(hot_groups)).astype(np.int64)
                raw = w.data.tobytes()
                texts += [raw[a:z] for a, z in zip(w.start[got.word].tolist(), w.end[got.word + got.size - 1].tolist(), strict=True)]
                held.append((part, got.suffixes, got.row + docs, got.at))
                ids.append((s.column(0).to_numpy(zero_copy_only=False), s.column(1).to_numpy(zero_copy_only=False)))
                docs += s.num_rows
                size += int((w.end[got.word + got.size - 1] - w.start[got.word]).sum())
                if size >= RUN_BYTES:
                    yield flush()
                    size, docs, turn = 0, 0, turn + 1
        if texts:
            yield flush()

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """A group's tree: of each node of full depth all leaves but the first are repeats."""
        passed, sent = pdf[pdf["text"].str.len() == 0], pdf[pdf["text"].str.len() > 0]
        out = list(passed[["run", "pos", "new", "rid"]].itertuples(index=False, name=None))
        if len(sent):
            data = np.frombuffer(b"".join(sent["text"]), np.uint8)
            off = np.append(0, np.cumsum(_unblob(sent["size"], np.int32), dtype=np.int64))
            start, end, first = words.borders(data, off, words.PLAIN)
            node = nodes(word_numbers(data, start, end), window)
            n, pos, doc = _unblob(sent["suffixes"], np.int32).astype(np.int64), _unblob(sent["pos"], np.int32), np.cumsum(_unblob(sent["new"], bool)) - 1
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            node, pos, doc = node[np.repeat(first[:-1], n) + step], np.repeat(pos, n) + step, np.repeat(doc, n)
            row = np.repeat(np.repeat(np.arange(len(sent)), sent["size"].str.len().to_numpy(int) // 4), n)
            rid, ord_ = _unblob(sent["rid"], np.int64), _unblob(sent["ord"], np.int64)
            o = np.lexsort((pos, rid[doc], ord_[doc], node))  # the tree's leaves in order
            begins = _changes(node[o])
            top = o[begins][np.cumsum(begins) - 1]
            hit = np.zeros(len(node), bool)
            hit[o] = (rid[doc[o]] != rid[doc[top]]) | (pos[o] != pos[top])
            at = np.flatnonzero(hit)
            cut = np.searchsorted(row[at], np.arange(len(sent) + 1))
            for k, run in enumerate(sent["run"]):
                a = at[cut[k] : cut[k + 1]]
                if len(a):
                    new = _changes(doc[a])
                    out.append((run, pos[a].astype(np.int32).tobytes(), new.tobytes(), rid[doc[a][new]].tobytes()))
        return pd.DataFrame(out, columns=["run", "pos", "new", "rid"])

    def merge(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return _unblob(pdf["rid"], np.int64)[np.cumsum(_unblob(pdf["new"], bool)) - 1], _unblob(pdf["pos"], np.int32)

    return _by_row(hits.select("rid", "ord", "text", "flags").mapInArrow(find, LEAVES).groupBy("part").applyInPandas(judge, PLACES), merge)


def covered(hits: DataFrame, gone: DataFrame, window: int, texts: bool) -> DataFrame:
    """Takes the repeats' words out of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in words.slices(b, "text"):
                w = Words(s.column(1), window)
                raw_all = w.data.tobytes()
                n, removed, shas, kept_texts = [], [], [], []
                for k, lists in enumerate(s.column(2).to_pylist()):
                    total = int(w.count[k])
                    edge = np.zeros(total + 1, np.int64)
                    for raw in lists or ():
                        at = np.frombuffer(raw, "<i4")
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0) + w.first[k]
                    text = b" ".join([raw_all[a:z] for a, z in zip(w.start[kept].tolist(), w.end[kept].tolist(), strict=True)])
                    n.append(total)
                    removed.append(total - len(kept))
                    shas.append(hashlib.sha256(text).hexdigest())
                    kept_texts.append(text.decode() if texts else None)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    by_row = gone.groupBy("rid").agg(F.collect_list("pos").alias("gone"))
    return hits.join(by_row.hint("shuffle_hash"), "rid", "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless ``texts``, or where nothing was removed).

    Words are runs of all but ASCII white space. Every word covered by a window
    of ``window`` words whose sequence also starts earlier is removed: in a smaller
    doc_id, or earlier in the same document. A null text has no words. A null doc_id
    comes last; rows of one doc_id with different texts are ordered by a hash of the
    text; rows equal in both are one document, each returned. Other columns are
    ignored, an empty table gives an empty result.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = small_batches(docs).select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64(doc_id, "text").alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    flags = repeated_anchors(rows, max(1, -(-size // GROUP_BYTES)), window)
    table, _ = keep(marked(rows, flags, window), "marked")
    cool, hot = table.where("kind = 2").agg(F.sum("words"), F.sum("hot_words")).first()
    groups, hot_groups = (max(1, -(-(n or 0) // GROUP_WORDS)) for n in (cool, hot))
    hits = table.where("kind = 1")
    done = table.where("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    return done.unionByName(covered(hits, repeats(hits, groups, hot_groups, window), window, texts))
