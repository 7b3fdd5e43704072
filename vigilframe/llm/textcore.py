"""Vectorised text primitives shared by the operators that read whole texts as bytes.

Everything works on the UTF-8 buffer of an Arrow string column, in pieces of about a megabyte, so that memory stays
bounded for any batch; a longer text is a piece of its own. Words are the maximal runs of bytes other than 0x20 and
0x09-0x0D. Hashes are 64 bits wide; they are only ever compared between a few thousand values at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SHINGLE = 5
_U = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD_BYTE = np.where(_SPACE, _U(0), _BYTE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTE_LOWER = _WORD_BYTE[_LOWER]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_ORDER = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE * 2), base % 2**64, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= PIECE * 2:
            _POWERS[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows) and validity of an Arrow string or binary array; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary())
    n = len(column)
    valid = np.asarray(column.is_valid())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0], valid


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes (a longer row is alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Rows cuts[k] to cuts[k + 1] of values as the bytes of element k."""
    raw = np.ascontiguousarray(values)
    wide = raw.nbytes // len(raw) if len(raw) else 0
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * wide).astype(np.int32)), pa.py_buffer(raw.tobytes())])


def dealt(to: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How rows that go to the parts `to` are packed, one row for each part that occurs: the order of the rows, those
    parts, their cuts in that order, each row's place in its part's list of distinct `who`, and those lists with their
    cuts. The work depends on the rows alone, whatever the number of parts."""
    order = np.argsort(to, kind="stable")
    parts, first, index = np.unique(to[order], return_index=True, return_inverse=True)
    wide = int(who.max(initial=0)) + 1
    pairs, place = np.unique(index * wide + who[order], return_inverse=True)
    few_cuts = np.searchsorted(pairs // wide, np.arange(len(parts) + 1))
    mine = place - few_cuts[index]
    mine = mine.astype(np.uint32 if mine.max(initial=0) > 65535 else np.uint16)
    return order, parts, np.append(first, len(to)), mine, pairs % wide, few_cuts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z read as a-z, and the first word's index for each row (one more than rows)."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    start[cut] = inside[cut]
    starts = np.flatnonzero(start)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    terms = _WORD_BYTE_LOWER[data]
    terms *= powers(len(data), _P)
    sums = np.add.reduceat(terms, starts)
    return mix(sums * powers(len(data), _P_INV)[starts]), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row. Fewer words than a shingle has: one hash of all of them.
    No words or no text: an empty array."""
    data, offsets, _ = utf8(column)
    for i, j in pieces(offsets):
        words, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if len(words) >= SHINGLE:
            grams = np.zeros(len(words) - SHINGLE + 1, np.uint64)
            for k in range(SHINGLE):
                grams += words[k : k + len(grams)] * _ORDER[k]
            grams = mix(grams, SHINGLE)
        for row in range(i, j):
            a, b = int(first[row - i]), int(first[row - i + 1])
            if b - a >= SHINGLE:
                yield row, np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                yield row, mix(np.array([np.sum(words[a:b] * _ORDER[: b - a])], np.uint64), b - a)
            else:
                yield row, np.zeros(0, np.uint64)
