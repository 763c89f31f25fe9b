"""Counts per text for quality rules and classifiers, many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from siltstone.llm import words

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

# Classes of bytes for the profile of a text: lower and upper letters, digits, space, line feed,
# marks of sentences, exclamation, bar, other signs, bytes beyond ASCII.
CLASSES = 10
_CLASS = np.full(256, 8, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 9
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
_CLASS[list(b".,:;?'\"()-")], _CLASS[33], _CLASS[124] = 5, 6, 7
PROFILE = CLASSES * CLASSES
RATIOS = 6
FEATURES = PROFILE + RATIOS


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


@dataclass
class Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_distinct: np.ndarray
    n_bytes: np.ndarray


def counts(part: pa.Array) -> tuple[Counts, np.ndarray, np.ndarray]:
    """The counts of each text, and the bytes and offsets they were taken from."""
    data, at = words.raw(part)
    n = len(at) - 1
    found = words.words(data, at, fold=False)
    per_text = found.counts(n)
    starts_sign = (data & 0xC0) != 0x80
    inside = starts_sign & ~words._IS_SPACE[data]

    code, text, first = words.shingles(found, 3, short=False)
    twice = first[words.repeated(code, text)]
    covered = np.zeros(len(found.text) + 3, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + 3, -1)
    again = np.cumsum(covered)[: len(found.text)] > 0

    rows = words.lines(data, at)
    sums = np.concatenate([[0], np.cumsum(~words._IS_SPACE[data], dtype=np.int64)])
    filled = sums[rows.end] > sums[rows.start]
    order = np.lexsort((rows.hash[filled], rows.text[filled]))
    h, t = rows.hash[filled][order], rows.text[filled][order]
    duplicate = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    _, kinds = words.distinct(found.hash, found.text)
    own = Counts(
        per_text,
        _per_text(inside, at),
        _per_text(_IS_SYMBOL[data], at),
        rows.counts(n),
        np.bincount(t[1:][duplicate], minlength=n),
        np.bincount(found.text, again, minlength=n).astype(np.int64),
        np.bincount(kinds, minlength=n),
        np.diff(at),
    )
    return own, data, at


def features(part: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` numbers per text: how byte classes follow each other, and ratios of counts."""
    own, data, at = counts(part)
    n = len(at) - 1
    kind = _CLASS[data].astype(np.int64)
    text = np.repeat(np.arange(n), own.n_bytes)
    same = text[1:] == text[:-1]
    pair = text[1:][same] * PROFILE + (kind[:-1] * CLASSES + kind[1:])[same]
    profile = np.bincount(pair, minlength=n * PROFILE).reshape(n, PROFILE)
    profile = np.sqrt(profile / np.maximum(own.n_bytes - 1, 1)[:, None])
    number = np.maximum(own.n_words, 1)
    ratios = np.column_stack(
        [
            np.log1p(own.n_words) / 5,
            own.word_chars / number / 5,
            own.n_distinct / number,
            own.n_repeat_words / number,
            own.n_dup_lines / np.maximum(own.n_lines, 1),
            np.log1p(own.n_words / np.maximum(own.n_lines, 1)) / 3,
        ]
    )
    return np.column_stack([profile, ratios]).astype(np.float32)
