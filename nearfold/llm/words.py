"""Word and line tables of a batch of texts, as numpy arrays over the Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+``.  All separators are single ASCII bytes, so
the rule can be applied to UTF-8 bytes without decoding a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; nulls are empty texts."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary array of adjacent slices of ``data``."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def doc_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of per-byte flags over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _edges(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end positions of runs of ``solid`` bytes that do not cross texts."""
    border = np.zeros(len(solid) + 1, bool)
    border[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | border[1:-1]
    end[:-1] &= ~solid[1:] | border[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


@dataclass
class Words:
    codes: np.ndarray  # of each word: its place in ``vocabulary``
    first: np.ndarray  # of each text, and one beyond: its first word
    vocabulary: pa.Array  # distinct words, UTF-8
    offsets: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: pa.Array) -> Words:
    offsets, data = text_bytes(texts)
    solid = ~_IS_SPACE[data]
    starts, ends = _edges(solid, offsets)
    encoded = slices(ends - starts, data[solid]).dictionary_encode()
    return Words(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets), encoded.dictionary, offsets, data)


def line_repeats(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and how many of them equal an earlier line."""
    offsets, data = words.offsets, words.data
    feed = data == 0x0A
    starts, ends = _edges(~feed, offsets)
    line = slices(ends - starts, data[~feed]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_IS_SPACE[data], out=solid[1:])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    real = solid[ends] > solid[starts]
    line, owner = line[real], owner[real]
    n = len(offsets) - 1
    total = np.bincount(owner, minlength=n)
    key = owner * (int(line.max(initial=0)) + 1) + line
    distinct = np.bincount(owner[~pd.Series(key).duplicated().to_numpy()], minlength=n)
    return total, total - distinct


def window_codes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, codes): equal codes mark equal ``width``-word windows; windows do not cross texts."""
    n = len(words.codes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, size = words.codes, len(words.vocabulary)
    for k in range(1, width):
        code = code[:-1] * size + words.codes[k:]
        code = pd.factorize(code)[0].astype(np.int64)
    owner = words.owner
    inside = owner[: n - width + 1] == owner[width - 1 :]
    return np.flatnonzero(inside), code[inside]


def repeated_window_words(words: Words, width: int = 3) -> np.ndarray:
    """Per text: words that lie in a ``width``-word window found twice or more in that text."""
    n = len(words.first) - 1
    at, code = window_codes(words, width)
    if not len(at):
        return np.zeros(n, np.int64)
    owner = words.owner
    key = pd.factorize(owner[at] * (int(code.max()) + 1) + code)[0]
    hit = at[np.bincount(key)[key] > 1]
    covered = np.zeros(len(words.codes), bool)
    for k in range(width):
        covered[hit + k] = True
    return np.bincount(owner[covered], minlength=n)
