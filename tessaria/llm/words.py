"""Words of whole Arrow text columns and their hashes, computed over the UTF-8 bytes.

No Python object is made per word: a column's bytes are classified by a table
of 256 entries, and a word's hash is the polynomial of its bytes modulo 2**64
(read off prefix sums), then mixed. Separators are ASCII, so that bytes of
other characters never split a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, GRAM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SLICE_BYTES = 1 << 19


def inverse(odd: int) -> int:
    """The inverse of an odd number modulo 2**64."""
    return pow(odd, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_table(word: set[int], lower: bool) -> np.ndarray:
    """Each byte's value in the polynomial, 0 for what separates words."""
    out = np.zeros(256, U)
    for b in range(256):
        a = b + 32 if lower and 65 <= b <= 90 else b
        if a in word:
            out[b] = mix(np.array([a + 1], U))[0] | U(1)
    return out


SPACES = {0x20, *range(0x09, 0x0E)}
#: Runs of all but white space, as they stand.
PLAIN = byte_table(set(range(256)) - SPACES, lower=False)
#: Runs of digits, letters in lower case and all non-ASCII characters.
FOLDED = byte_table({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}, lower=True)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 2 * SLICE_BYTES)
        up, down = np.full(m, base, U), np.full(m, inverse(base), U)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's UTF-8 bytes and row offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    _, off = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def borders(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word, the byte after it, first word of each row and the end)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = (table != 0)[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, off)


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, the byte after it, first word of each row and the end)."""
    start, end, first = borders(data, off, table)
    n = len(data)
    if n == 0:
        return np.zeros(0, U), start, end, first
    up, down = powers(BASE, n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(table[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start]), start, end, first


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k neighbouring words, across rows too: callers drop those."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    up, down = powers(GRAM, n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(h * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
