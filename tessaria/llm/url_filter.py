"""URL filter: a bit-parallel wildcard automaton.

Glob rules are packed into multiword Shift-And masks, and all of them are
simulated at once over each canonical URL (``.`` + host + path). In a glob,
``*`` stands for any characters but ``/`` and ``**`` for any characters. One
step of the simulation is a shift and two masks on an array with a row per URL
and a 64-bit word per 64 states, so that the cost does not grow with the
number of rules that fit in a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The production rules (host, path): (rule, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
U = np.uint64
ROWS = 8192


def host_rule(rule: str) -> str:
    """The glob of a rule host/path: the host, all its subdomains, paths that start so."""
    return f"*.{rule}**"


@dataclass
class Automaton:
    """States of all globs, one bit each; ``final[i]`` is glob i's (word, bit)."""

    step: np.ndarray  # 256 x words: states that may be entered on a byte
    loop: np.ndarray  # 256 x words: states that may stay on a byte
    init: np.ndarray
    first: np.ndarray  # states at which a glob starts: nothing is shifted into them
    final: list[tuple[int, int]]

    def run(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each row, whether it is matched by each glob, to its last byte."""
        n, w = len(off) - 1, len(self.init)
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")  # the rows still running are a prefix
        state = np.tile(self.init, (n, 1))
        at = off[:-1][order]
        live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
        for i in range(int(size.max(initial=0))):
            m = int(live[i])
            b, s = data[at[:m] + i], state[:m]
            up = s << U(1)
            if w > 1:
                up[:, 1:] |= s[:, :-1] >> U(63)
            up &= ~self.first
            state[:m] = (up & self.step[b]) | (s & self.loop[b])
        out = np.empty((n, len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] >> U(bit)) & U(1) != 0
        return out


def compile_globs(globs: list[str]) -> Automaton:
    """State j of a glob: its first j plain bytes are matched. Wildcards are loops of states."""
    parsed: list[tuple[bytes, dict[int, bool]]] = []
    for g in globs:
        plain, loops, raw, i = bytearray(), {}, g.encode(), 0
        while i < len(raw):
            if raw[i : i + 1] == b"*":
                wide = raw[i : i + 2] == b"**"
                loops[len(plain)] = loops.get(len(plain), False) or wide
                i += 1 + wide
            else:
                plain.append(raw[i])
                i += 1
        parsed.append((bytes(plain), loops))
    total = sum(len(p) + 1 for p, _ in parsed)
    w = max(1, -(-total // 64))
    step, loop = np.zeros((256, w), U), np.zeros((256, w), U)
    init, first, final, base = np.zeros(w, U), np.zeros(w, U), [], 0
    for plain, loops in parsed:
        init[base // 64] |= U(1) << U(base % 64)
        first[base // 64] |= U(1) << U(base % 64)
        for j, b in enumerate(plain):
            s = base + j + 1
            step[b, s // 64] |= U(1) << U(s % 64)
        for j, wide in loops.items():
            s = base + j
            for b in range(256):
                if wide or b != 0x2F:
                    loop[b, s // 64] |= U(1) << U(s % 64)
        final.append(((base + len(plain)) // 64, (base + len(plain)) % 64))
        base += len(plain) + 1
    return Automaton(step, loop, init, first, final)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def parts(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path) of a url; both empty if null or without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for stop in "?#":
        if (k := rest.find(stop)) >= 0:
            rest = rest[:k]
    k = rest.find("/")
    host, path = (rest, "") if k < 0 else (rest[:k], rest[k:])
    return host.translate(_FOLD), path


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """Judges each row's url: page_id, url, host, path, rule, verdict.

    The longest rule that fits wins, equally long ones in the order given; where
    none fits, rule is null and the verdict is ``default``. A null url or one
    without ``://`` has an empty host and path, which no rule fits. Repeated rows
    are judged one by one, other columns are dropped, an empty table gives none.
    """
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    auto = compile_globs([host_rule(r) for r, _ in ranked])
    names, verdicts = [r for r, _ in ranked], [v for _, v in ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                cut = [parts(u) for u in b.column(1).to_pylist()]
                canon = [f".{h}{p}".encode() for h, p in cut]
                off = np.concatenate([[0], np.cumsum([len(c) for c in canon])]).astype(np.int64)
                hit = auto.run(np.frombuffer(b"".join(canon), np.uint8), off)
                best = np.where(hit.any(1), hit.argmax(1), -1) if names else np.full(len(cut), -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(1), pa.array([h for h, _ in cut], pa.string()), pa.array([p for _, p in cut], pa.string()),
                        pa.array([names[k] if k >= 0 else None for k in best], pa.string()), pa.array([verdicts[k] if k >= 0 else default for k in best], pa.string()),
                    ],
                    ["page_id", "url", "host", "path", "rule", "verdict"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, url string, host string, path string, rule string, verdict string")
