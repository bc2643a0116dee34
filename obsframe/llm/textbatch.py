"""Batches of texts as numpy arrays: bytes, row offsets, words and hashes.

The helpers run inside ``mapInArrow`` tasks. Work goes in blocks of a few MB, so that what a task holds
follows the block and not the batch; a text longer than a block is cut between two words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20
U64 = np.uint64

_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)
BYTE_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True

_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(kind: str, step: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        p = np.full(max(n, BLOCK + 1), step, dtype=np.uint64)
        p[0] = 1
        _powers[kind] = np.multiply.accumulate(p)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit given."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class SpanHash:
    """64-bit hashes of any spans of one byte array, each in constant time."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUE):
        n = len(data)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[data] * _power("up", _STEP, n), out=self.total[1:])
        self.down = _power("down", _UNSTEP, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offsets, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def row_blocks(offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """Words of a batch: byte ranges, hashes, and the number of the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


#: First and last characters of blocks whose scripts set no blanks between words.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029),
             (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAA7F),
             (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))


@lru_cache(1)
def _character_kinds() -> np.ndarray:
    """Of each character beyond ASCII: 0 a part of words, 1 between words (blanks, punctuation, symbols), 2 a word by itself."""
    kind = np.zeros(1 << 21, dtype=np.uint8)
    for lo, hi in _UNSPACED:
        kind[lo:hi + 1] = 2
    kind[[c for c in range(128, 0x20000) if unicodedata.category(chr(c))[0] in "ZPS" or unicodedata.category(chr(c)) == "Cc"]] = 1
    kind[0x200B] = 1  # a blank of no width
    return kind


def _by_script(x: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are in words, and where a word ends although the next byte is in a word too, for texts of any script."""
    m, cut = is_word[x], np.zeros(len(x) + 1, dtype=bool)
    lead = np.flatnonzero(x >= 0xC2)
    if not len(lead):
        return m, cut
    b = x[lead].astype(np.int64)
    size = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
    whole = lead + size <= len(x)
    lead, b, size = lead[whole], b[whole], size[whole]
    code = b & (0x7F >> size)
    for i in range(1, 4):
        code = np.where(i < size, code << 6 | x[np.minimum(lead + i, len(x) - 1)] & 0x3F, code)
    kind = _character_kinds()[code]
    for i in range(4):
        m[(lead + i)[(kind == 1) & (i < size)]] = False
    cut[lead[kind == 2]] = cut[(lead + size)[kind == 2]] = True
    return m, cut


def _gaps(x: np.ndarray, is_word: np.ndarray, scripts: bool) -> np.ndarray:
    """Places before which a text can be cut."""
    if not scripts:
        return np.flatnonzero(~is_word[x])
    m, cut = _by_script(x, is_word)
    return np.flatnonzero((~m | cut[:-1]) & (x & 0xC0 != 0x80))


def _cuts(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, scripts: bool = False) -> Iterator[tuple[int, int]]:
    for lo, hi in row_blocks(offs):
        a, z = int(offs[lo]), int(offs[hi])
        while z - a > BLOCK:  # one long text: cut it before a byte between words
            gap = _gaps(data[a + BLOCK // 2:a + BLOCK], is_word, scripts)
            if not len(gap):
                rest = _gaps(data[a + BLOCK:z], is_word, scripts)
                cut = a + BLOCK + int(rest[0]) if len(rest) else z
            else:
                cut = a + BLOCK // 2 + int(gap[-1])
            yield a, cut
            a = cut
        if z > a:
            yield a, z


def find_words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = WORD_BYTE, lower: bool = True, scripts: bool = False) -> Words:
    """Maximal runs of word bytes; no word spans two rows. Hashes ignore the case of A-Z if ``lower``.

    With ``scripts``, blanks and punctuation beyond ASCII are no word bytes, and in scripts without blanks each character is a word.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    for a, z in _cuts(data, offs, is_word, scripts):
        x = LOWER[data[a:z]] if lower else data[a:z]
        m, cut = _by_script(x, is_word) if scripts else (is_word[x], None)
        before = np.empty_like(m)
        before[0] = False
        before[1:] = m[:-1] if cut is None else m[:-1] & ~cut[1:-1]
        rows = offs[np.searchsorted(offs, a):np.searchsorted(offs, z)] - a
        before[rows] = False
        start = np.flatnonzero(m & ~before)
        after = np.empty_like(m)
        after[-1] = False
        after[:-1] = m[1:] if cut is None else m[1:] & ~cut[1:-1]
        after[rows[rows > 0] - 1] = False
        end = np.flatnonzero(m & ~after) + 1
        parts.append((start + a, end + a, SpanHash(x)(start, end)))
    if parts:
        start, end, h = (np.concatenate(p) for p in zip(*parts))
    else:
        start = end = np.zeros(0, np.int64)
        h = np.zeros(0, np.uint64)
    return Words(start, end, h, np.searchsorted(start, offs))


#: Small letters and the bytes beyond ASCII stay; every other byte is a boundary.
LETTER_BYTES = np.full(256, 32, dtype=np.uint8)
LETTER_BYTES[97:123] = np.arange(97, 123)
LETTER_BYTES[128:] = np.arange(128, 256)


def byte_ngrams(data: np.ndarray, offs: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashed buckets and places of the n-grams of ``data``, whose boundaries are blanks, for consecutive ``orders``.

    An n-gram lies in one row and may begin or end with a boundary, but holds none inside.
    """
    n = len(data)
    x = data.astype(np.uint32)
    stop = np.full(n + 1, n, dtype=np.int32)  # the first boundary at or after each byte, or the end of its row
    gap = np.flatnonzero(x == 32)
    stop[gap] = gap
    stop[offs[1:]] = np.minimum(stop[offs[1:]], offs[1:])
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    row_end = np.repeat(offs[1:], np.diff(offs)).astype(np.int32)
    last = np.minimum(stop[1:] + 1, row_end)
    room = last - np.arange(n, dtype=np.int32)
    key, found, where = np.zeros(n, dtype=np.uint32), [], []
    for m in range(1, max(orders) + 1):
        key[:max(n - m + 1, 0)] = key[:max(n - m + 1, 0)] * np.uint32(0x01000193) ^ x[m - 1:]
        if m in orders:
            i = np.flatnonzero((room >= m) & (x != 32) if m == 1 else room >= m)
            found.append(((key[i] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32) ^ np.int32(m))
            where.append(i)
    return found, where


def per_row(values: np.ndarray, first: np.ndarray, how=np.add, empty=0) -> np.ndarray:
    """A reduction of ``values`` over each row's range ``first[i]:first[i + 1]``; ``empty`` for rows without any."""
    out = np.full(len(first) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = how.reduceat(values, first[full])
    return out


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
