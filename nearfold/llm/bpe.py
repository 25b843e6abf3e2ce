"""Byte-level BPE ids of a batch of texts, computed once per distinct chunk.

The pre-tokenizer's pattern never joins a word to what follows its white
space, so the ids of a text are the ids of its chunks (white space and the
word after it) one after another.  Each distinct chunk of a batch is encoded
once and the ids are put together by array indexing.  Texts for which that
rule does not hold (Unicode white space, special-token strings) go through
the plain tokenizer; both ways give the tokenizer's own ids."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from nearfold.llm.words import _IS_SPACE, _edges, slices, text_bytes

#: White space of the pattern outside the six ASCII separators.
_ODD_SPACE = "[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]"


@lru_cache(maxsize=2)
def _load(json_path: str, ranks_path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(json_path)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    quick = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        width[i] = len(piece)
    special = [re.escape(t.content) for t in plain.get_added_tokens_decoder().values()]
    return plain, quick, width, re.compile("|".join([_ODD_SPACE, *special]))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encode_chunks(chunks: list[bytes], quick, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks in one row, and where each chunk's ids begin.

    Chunks start with white space, so joining them keeps each chunk's ids;
    the ids' byte widths then show where a chunk ends."""
    ids, firsts, done = [], [], 0
    for i in range(0, len(chunks), 50_000):
        part = chunks[i : i + 50_000]
        got = np.asarray(quick.encode_ordinary(b"".join(part).decode("utf-8")), np.int64)
        begins = np.zeros(len(got) + 1, np.int64)
        np.cumsum(width[got], out=begins[1:])
        at = np.zeros(len(part), np.int64)
        np.cumsum([len(c) for c in part[:-1]], out=at[1:])
        firsts.append(np.searchsorted(begins, at) + done)
        ids.append(got)
        done += len(got)
    return np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([*firsts, [done]]).astype(np.int64)


def encode(texts: pa.Array, paths: tuple[str, str], count_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
    """(ids, first): the ids of all texts in a row, and where each text's ids begin (one beyond at the end).

    ``count_only``: no ids, which saves putting them together."""
    plain, quick, width, odd_rule = _load(*paths)
    values = texts.to_pylist()
    odd = {i: plain.encode(t, add_special_tokens=False).ids for i, t in enumerate(values) if t and odd_rule.search(t)}
    if odd:
        texts = pa.array(["" if i in odd else t for i, t in enumerate(values)], pa.large_string())
    del values
    offsets, data = text_bytes(texts)
    n = len(offsets) - 1
    solid = ~_IS_SPACE[data]
    starts, ends = _edges(solid, offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    # A chunk begins where the word before it ends, or where its text begins.
    begin = np.maximum(offsets[owner], np.concatenate([[0], ends[:-1]])) if len(starts) else starts
    # White space after a text's last word, or a text of white space only, is a chunk as well.
    last = np.searchsorted(starts, offsets[1:])
    tail = offsets[:-1].copy()
    has = last > np.searchsorted(starts, offsets[:-1])
    tail[has] = ends[last[has] - 1]
    more = np.flatnonzero(tail < offsets[1:])
    begin = np.concatenate([begin, tail[more]])
    end = np.concatenate([ends, offsets[1:][more]])
    owner = np.concatenate([owner, more])
    order = np.argsort(begin, kind="stable")
    begin, end, owner = begin[order], end[order], owner[order]
    encoded = slices(end - begin, data).dictionary_encode()
    del begin, end, order, solid, starts, ends, last, tail, has, more
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    chunks = encoded.dictionary.to_pylist()
    spaced = np.fromiter((c[:1].isspace() and not c.isspace() for c in chunks), bool, len(chunks))
    joined, alone = np.flatnonzero(spaced), np.flatnonzero(~spaced)
    ids, first = _encode_chunks([chunks[i] for i in joined], quick, width)
    single = [quick.encode_ordinary(chunks[i].decode("utf-8")) for i in alone]
    begins, counts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
    begins[joined], counts[joined] = first[:-1], np.diff(first)
    counts[alone] = [len(x) for x in single]
    begins[alone] = len(ids) + np.cumsum(counts[alone]) - counts[alone]
    ids = np.concatenate([ids, np.asarray([x for y in single for x in y], np.int64)])
    size = counts[codes]
    lengths = np.bincount(owner, weights=size, minlength=n).astype(np.int64)
    if count_only:
        for i, x in odd.items():
            lengths[i] = len(x)
        return None, np.concatenate([[0], np.cumsum(lengths)])
    total = int(size.sum())
    to = np.cumsum(size) - size
    out = ids[np.arange(total) + np.repeat(begins[codes] - to, size)] if total else np.zeros(0, np.int64)
    ends_of = np.concatenate([[0], np.cumsum(lengths)])
    if odd:
        parts, before = [], 0
        for i, x in sorted(odd.items()):
            parts += [out[before : ends_of[i]], np.asarray(x, np.int64)]
            before = ends_of[i]
            lengths[i] = len(x)
        out = np.concatenate([*parts, out[before:]])
        ends_of = np.concatenate([[0], np.cumsum(lengths)])
    return out.astype(np.uint32), ends_of
