r"""Spelling variants of a corpus vocabulary by asymmetric q-chunks.

Words are the maximal runs of ``[A-Za-zÀ-ÿ]`` with A-Z lower-cased.
A run of a document whose ``crc32("<doc_id>:<run>")`` is divisible by 97 loses
one code point (planted misspellings).  Two words are near if exactly one code
point is inserted, deleted or replaced.

The shorter word of a pair (either one, if both are as long) contributes two
disjoint chunks, its halves; the other contributes the grams that a chunk can
meet.  One edit leaves one half untouched, at the same place or shifted by the
one code point that the longer word has more.  Of all positional grams only
those at a shift of 0 (first half) and of the difference in length (second
half) can be that half, so only these are emitted.  A common half alone would
bring large groups together, so a key also holds the untouched half of the
remaining part, by the same argument: a key is the word without the quarter
that holds the edit, with the chunk side's length and the quarter's number.
Every pair that meets is verified by its edit distance.

``form`` is the near word of largest count if that is at least twice the
word's own, so counts at least double along a chain of forms and a chain has
at most log2(largest count) steps; ``root`` follows it by pointer doubling.

Defined results: a null or empty text has no words; a null id counts as the
empty string in the hash; repeated rows count as often as they occur; texts
and words of any length are whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import python_ready, staged
from nearfold.llm.words import _edges, slices, text_bytes

#: One run in so many loses a code point.
ERASE = 97
MIN_LETTERS = 5
MIN_COUNT = 3
#: Words longer than this are hashed by zlib one by one, shorter ones column by column.
_COLUMNS = 48


def _crc_table() -> np.ndarray:
    """The 256 steps of the CRC-32 polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: First byte of U+00C0 to U+00FF in UTF-8.
_ACCENT = 0xC3


def _hashes(prefix: np.ndarray, word: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """CRC-32 of each prefix (given by its CRC) followed by word ``word[i]``."""
    length = np.diff(offsets)[word]
    out = prefix.copy()
    order = np.argsort(-length, kind="stable")
    for i in order[: int(np.searchsorted(-length[order], -_COLUMNS, side="left"))]:
        out[i] = zlib.crc32(data[offsets[word[i]] : offsets[word[i] + 1]].tobytes(), int(out[i]))
    order = order[int(np.searchsorted(-length[order], -_COLUMNS, side="left")) :]
    state, begin, size = ~out[order], offsets[word[order]], length[order]
    for k in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -k, side="left"))  # words with more than k bytes come first
        part = state[:n]
        state[:n] = _CRC[(part ^ data[begin[:n] + k]) & 0xFF] ^ (part >> np.uint32(8))
    out[order] = ~state
    return out


def _erase(word: bytes, h: int) -> bytes:
    text = word.decode("utf-8")
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode("utf-8")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = text_bytes(batch.column("text"))
        data = _FOLD[data]
        solid = _LETTER[data] | (data == _ACCENT)
        solid[1:] |= data[:-1] == _ACCENT
        starts, ends = _edges(solid, offsets)
        runs = slices(ends - starts, data[solid]).dictionary_encode()
        codes = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(len(runs.dictionary), 1)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        pairs, n = np.unique(owner * size + codes, return_counts=True)
        doc, word = pairs // size, pairs % size
        ids = batch.column("doc_id").to_pylist()
        prefix = np.fromiter((zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids), np.uint32, len(ids))
        at, raw = text_bytes(runs.dictionary.cast(pa.large_string()))
        h = _hashes(prefix[doc], word, at, raw)
        hit = h % ERASE == 0
        total = np.bincount(word[~hit], weights=n[~hit], minlength=len(runs.dictionary)).astype(np.int64)
        letters = np.diff(at) - np.diff(np.concatenate([[0], np.cumsum(raw == _ACCENT)])[at])
        whole = np.flatnonzero((total > 0) & (letters >= MIN_LETTERS))
        lost = np.flatnonzero(hit & (letters[word] > MIN_LETTERS))
        changed = [_erase(raw[at[w] : at[w + 1]].tobytes(), int(x)).decode("utf-8") for w, x in zip(word[lost], h[lost])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([runs.dictionary.take(pa.array(whole)).cast(pa.string()), pa.array(changed, pa.string())]),
                pa.array(np.concatenate([total[whole], n[lost]]).astype(np.int64)),
            ],
            names=["word", "n"],
        )


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` for the words of at least 5 code points and 3 occurrences."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(_count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _quarters(length: Column) -> list[Column]:
    """Borders of the quarters of a word: those of its halves and of their halves."""
    half = F.floor(length / 2)
    return [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]


def _key(word: Column, length: Column, quarter: int, extra: int) -> Column:
    """The chunk side's ``length`` and the word without one quarter (and ``extra`` code points more)."""
    border = [b.cast("int") for b in _quarters(length)]
    head = F.substring(word, F.lit(1), border[quarter])
    tail = F.substring(word, border[quarter + 1] + F.lit(1 + extra), length.cast("int"))
    return F.concat_ws("/", length.cast("string"), F.lit(str(quarter)), head, tail)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of near words once, ``a`` the shorter (the smaller of equally long ones)."""
    sized = words.select("word", "n", F.length("word").alias("len"))
    chunks = sized.select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(*[_key(F.col("word"), F.col("len"), q, 0) for q in range(4)])).alias("key")
    )
    grams = sized.select(
        F.col("word").alias("b"),
        F.col("n").alias("n_b"),
        F.explode(
            F.array(
                *[_key(F.col("word"), F.col("len"), q, 0) for q in range(4)],
                *[_key(F.col("word"), F.col("len") - 1, q, 1) for q in range(4)],
            )
        ).alias("key"),
    )
    met = chunks.join(grams, "key").where((F.length("b") > F.length("a")) | (F.col("a") < F.col("b")))
    near = met.where(F.levenshtein("a", "b", 1) == 1)
    # A longer word can meet a shorter one under two quarters.
    return near.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of the vocabulary."""
    words = staged(vocabulary(docs), "spelling_words")
    pairs = near_pairs(words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    both = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    found = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.m") >= 2 * F.col("n"), F.col("best.form")).alias("form"),
        F.when(-F.col("best.m") >= 2 * F.col("n"), -F.col("best.m")).cast("long").alias("form_n"),
    )
    found = staged(found, "spelling_forms")
    roots = _roots(found)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(found: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form."""
    links = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = found.agg(F.max("n")).first()[0] or 1
    steps = max(1, int(math.log2(most)) + 1)
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = staged(links.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling_roots")
    return links
