"""Vectorised words and word-shingle hashes of whole texts in an Arrow batch.

Bytes of a batch are one numpy array; words are found and hashed without a
Python loop over documents. ``plain`` words are what ASCII white space separates;
``folded`` words are runs of letters and digits (every byte from 0x80 counts as a
letter) of the lower-cased text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_LIBC = ctypes.CDLL(None)
SHINGLE = 5
#: Bytes of text handled at once; one longer text is handled alone.
CHUNK = 1 << 19

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    np.multiply.accumulate(np.full(n - 1, base, U), out=out[1:])
    return out


_LOW = _powers(int(_STEP), 4096)
_HIGH = _powers(pow(int(_STEP), 4096, 2**64), 4096)
_MIX = _rng.integers(1, 2**63, 64, dtype=U) * U(2) + U(1)

PLAIN = np.zeros(256, bool)
PLAIN[[9, 10, 11, 12, 13, 32]] = True
FOLDED = np.ones(256, bool)
FOLDED[128:] = False
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    FOLDED[ord(_a) : ord(_b) + 1] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, at, data = col.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each, one row at least.

    Behind the last, freed memory goes back to the system: a worker lives on for later
    tasks and shares its executor's memory with the others.
    """
    _, off = text_bytes(col)
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, to
        at = to
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim:
        trim(0)


def spans(data: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (with the total at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separator[data]
    begin = np.empty(len(data), bool)
    begin[0] = True
    begin[1:] = ~inside[:-1]
    head = off[:-1]
    head = head[head < len(data)]
    begin[head] = True
    begin &= inside
    starts = np.flatnonzero(begin)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[head[head > 0] - 1] = True
    last &= inside
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    place = np.arange(int(size.sum()))
    within = place - np.repeat(first, size)
    value = _BYTE[data[within + np.repeat(starts, size)]]
    value *= _LOW[within & 4095]
    if int(size.max()) > 4096:
        value *= _HIGH[(within >> 12) & 4095]
    return mix64(np.add.reduceat(value, first) + size.astype(U) * _STEP)


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int = SHINGLE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, text by text, and the offsets of each text's.

    With ``short``, a text of 1 to n-1 words has one shingle of all its words.
    """
    count = np.diff(first)
    if not len(words):
        return np.zeros(0, U), np.zeros(len(first), np.int64)
    total = len(words)
    value = np.zeros(max(0, total - n + 1), U)
    for i in range(n):
        value += words[i : i + len(value)] * _MIX[i]
    keep = np.zeros(total, bool)
    keep[: len(value)] = True
    for i in range(1, n):  # windows that reach into the next text
        at = first[1:] - i
        keep[at[(at >= 0) & (at >= first[:-1]) & (at < total)]] = False
    out_n = np.maximum(count - n + 1, 0)
    value = mix64(value[keep[: len(value)]] + U(n))
    off = np.zeros(len(first), np.int64)
    np.cumsum(out_n, out=off[1:])
    few = np.flatnonzero((count > 0) & (count < n))
    if short and len(few):
        size = out_n.copy()
        size[few] = 1
        both = np.zeros(len(first), np.int64)
        np.cumsum(size, out=both[1:])
        out = np.empty(int(both[-1]), U)
        own = np.ones(len(out), bool)
        own[both[few]] = False
        out[own] = value
        one = np.zeros(len(few), U)
        for i in range(n - 1):
            has = count[few] > i
            one[has] += words[first[few[has]] + i] * _MIX[i]
        out[both[few]] = mix64(one + count[few].astype(U))
        return out, both
    return value, off


def unique_sets(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    out = np.zeros(len(off), np.int64)
    np.cumsum([len(x) for x in parts], out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U)), out


def folded_shingles(col: pa.Array, n: int = SHINGLE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the folded words of each text (not made distinct)."""
    data, off = text_bytes(pc.utf8_lower(col))
    starts, ends, first = spans(data, off, FOLDED)
    return shingle_hashes(word_hashes(data, starts, ends), first, n, short)


def folded_words(text: str | None) -> list[str]:
    """The folded words of one text, in plain Python: the definition that the numpy code follows."""
    raw = (text or "").lower().encode()
    return [w.decode() for w in bytes(32 if FOLDED[b] else b for b in raw).split(b" ") if w]
