"""Words, lines and shingles of many texts at once, as numpy arrays.

A word is a run of bytes other than space and the five control characters
U+0009 to U+000D.  Hashes are polynomials over random byte values modulo 2^64,
taken from prefix sums, so that their cost does not depend on the word length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # texts are worked on in slices of about this size
SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
# For token models: everything in ASCII but letters and digits parts words.
NOT_ALPHANUMERIC = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the usual length is kept."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        kept = np.multiply.accumulate(steps)
        if n <= 2 * SLICE_BYTES:
            _powers[base] = kept
    return kept[:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``limit`` bytes: first row and texts; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else [0]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, column.slice(first, last - first)
        first = last


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (one more at the end)."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@dataclass
class Pieces:
    """Runs of bytes: where they begin and end, their text, their hash."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    def counts(self, texts: int) -> np.ndarray:
        return np.bincount(self.text, minlength=texts)


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs in ascending order, in blocks so that memory stays bounded."""
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        low = int(start[first])
        last = max(first + 1, int(np.searchsorted(end, low + SLICE_BYTES, "right")))
        high = int(end[last - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUE[data[low:high]] * _power(_BASE, high - low), out=sums[1:])
        s, e = start[first:last] - low, end[first:last] - low
        shift = _power(_INVERSE, high - low + 1)[s]
        out[first:last] = (sums[e] - sums[s]) * shift + (e - s).astype(np.uint64)
        first = last
    return mix(out)


def words(data: np.ndarray, at: np.ndarray, fold: bool = True, between: np.ndarray = _IS_SPACE) -> Pieces:
    """The words of all texts; ``fold`` lower-cases A-Z before hashing, ``between`` marks what parts words."""
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = between[data[:-1]]
    edge[at] = True
    solid = ~between[data]
    start = np.flatnonzero(edge[:-1] & solid)
    closed = np.ones(len(data) + 1, bool)
    closed[:-1] = ~solid
    closed[at] = True
    end = np.flatnonzero(closed[1:] & solid) + 1
    text = np.searchsorted(at, start, "right") - 1
    return Pieces(start, end, text, _hashed(_FOLD[data] if fold else data, start, end))


def prefixes(data: np.ndarray, pieces: Pieces, size: int, fold: bool = True) -> np.ndarray:
    """Hashes of the first ``size`` bytes of each piece; shorter pieces are hashed whole."""
    return _hashed(_FOLD[data] if fold else data, pieces.start, np.minimum(pieces.end, pieces.start + size))


def with_beginnings(data: np.ndarray, pieces: Pieces, sizes: tuple[int, ...], fold: bool = True) -> list[np.ndarray]:
    """As ``prefixes`` for each of ``sizes``, from one run of sums over the bytes."""
    data = _FOLD[data] if fold else data
    out = [np.empty(len(pieces.start), np.uint64) for _ in sizes]
    first = 0
    while first < len(pieces.start):
        low = int(pieces.start[first])
        last = max(first + 1, int(np.searchsorted(pieces.end, low + SLICE_BYTES, "right")))
        start = pieces.start[first:last] - low
        # Of a last piece beyond the block only its beginning is asked for.
        high = min(int(pieces.end[last - 1]), int(pieces.start[last - 1]) + max(sizes))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUE[data[low:high]] * _power(_BASE, high - low), out=sums[1:])
        shift = _power(_INVERSE, high - low + 1)[start]
        for own, size in zip(out, sizes, strict=True):
            end = np.minimum(pieces.end[first:last] - low, start + size)
            own[first:last] = (sums[end] - sums[start]) * shift + (end - start).astype(np.uint64)
        first = last
    return [mix(own) for own in out]


def lines(data: np.ndarray, at: np.ndarray) -> Pieces:
    """The lines of all texts, split at line feeds; an empty text has one empty line."""
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([at[:-1], feeds + 1]))
    # An empty text begins where its neighbour does, so both bounds are sorted alike.
    end = np.sort(np.concatenate([at[1:], feeds]))
    text = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(feeds, at)) + 1)
    return Pieces(start, end, text, _hashed(data, start, end))


def shingles(pieces: Pieces, size: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` pieces within a text: hash, text, first piece.

    With ``short`` a text of fewer pieces gives one window of all it has.
    """
    n = len(pieces.hash)
    weight = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    whole = max(0, n - size + 1)
    first = np.flatnonzero(pieces.text[:whole] == pieces.text[n - whole :]) if whole else np.zeros(0, np.int64)
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        total += pieces.hash[first + k] * weight[k]
    code, text = mix(total), pieces.text[first]
    if short and n:
        begins = np.flatnonzero(np.r_[True, pieces.text[1:] != pieces.text[:-1]])
        length = np.diff(np.r_[begins, n])
        few = length < size
        own, length = begins[few], length[few]
        total = length.astype(np.uint64) * np.uint64(_INVERSE)
        for k in range(size - 1):
            there = k < length
            total[there] += pieces.hash[own[there] + k] * weight[k]
        code, text, first = np.r_[code, mix(total)], np.r_[text, pieces.text[own]], np.r_[first, own]
        order = np.argsort(first, kind="stable")
        code, text, first = code[order], text[order], first[order]
    return code, text, first


def distinct(code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once per text, in ascending signed order within the text."""
    signed = code.view(np.int64)
    order = np.lexsort((signed, text))
    signed, text = signed[order], text[order]
    first = np.ones(len(text), bool)
    first[1:] = (signed[1:] != signed[:-1]) | (text[1:] != text[:-1])
    return signed[first], text[first]


def repeated(code: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each entry whether its hash comes up again in the same text."""
    order = np.lexsort((code, text))
    same = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    many = np.zeros(len(code), bool)
    many[1:] |= same
    many[:-1] |= same
    out = np.empty(len(code), bool)
    out[order] = many
    return out
