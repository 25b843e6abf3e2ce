"""Vector bin packing of token sequences.

Items are placed under simultaneous limits on tokens, segments and
loss-bearing tokens.  A sequence takes, again and again, the item whose
demand has the largest dot product with what is left of the sequence
(both scaled by the limits); when no whole item fits, the best one is cut to
fill the rest.  What is left when a group of documents ends goes into
sequences whose lengths are powers of two, which need no padding.

:func:`pack_examples` packs instruction data, where the three demands differ
from example to example: an example's runs of text with one loss flag are its
segments, and the text under the flag bears loss.  Examples within the limits
stay whole; longer ones are cut at the ends of segments, and a segment beyond
the limits by tokens.  Demands are weighed by how much the group asks for of
each limit.

Groups are runs of documents within an input partition, closed at
``GROUP_TOKENS`` tokens, so packing needs no shuffle, a task holds one group
at a time, and hot sources or groups of copies do not matter.  Sequence ids
are unique: input partition, then a running number.  A task that runs again
reads the same rows and gives the same sequences.

Defined results: a null or empty text has the closing id alone; every id of
every document lies in exactly one piece; a text of any length is cut into
as many pieces as needed; repeated rows are packed as rows; an empty table
gives no rows; other columns are ignored.  An example without text (null or empty
segments only) has no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm import bpe
from nearfold.llm.common import python_ready

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 256, 2048
END_ID = 1
GROUP_TOKENS = 1 << 21

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, loss_tokens long, sequence_length long"
)

#: Limits of a sequence of instruction examples.
EXAMPLE_LIMITS = (2048, 16, 1024)
EXAMPLE_SCHEMA = (
    "conv_id long, start long, length long, segments long, loss_tokens long, ids_crc32 long, "
    "example_tokens long, sequence_id long, offset long, sequence_length long"
)


def pack_group(lengths: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) over items of the given lengths.

    ``loss``: loss-bearing tokens of each item, which are its last ones.
    Items are kept by length class, so a choice looks at distinct demands,
    not at every item."""
    cap = np.asarray(limits, float)
    out: list[list[tuple[int, int, int]]] = []
    # Whole sequences of items that are longer than one.
    start = np.zeros(len(lengths), np.int64)
    room = min(limits[0], limits[2])
    for i in np.flatnonzero(lengths > room):
        while lengths[i] - start[i] > room:
            out.append([(int(i), int(start[i]), room)])
            start[i] += room
    left = lengths - start
    # Distinct demands (tokens, loss) with the items that have them, first item last.
    stacks: dict[tuple[int, int], list[int]] = {}
    for i in np.flatnonzero(left > 0)[::-1].tolist():
        stacks.setdefault((int(left[i]), int(min(left[i], loss[i]))), []).append(i)
    keys = sorted(stacks)
    tokens = np.array([k[0] for k in keys], float)
    bearing = np.array([k[1] for k in keys], float)
    alive = np.array([len(stacks[k]) for k in keys])
    place = {k: j for j, k in enumerate(keys)}

    def add(key: tuple[int, int], item: int) -> None:
        nonlocal keys, tokens, bearing, alive
        j = place.get(key)
        if j is None:
            place[key] = len(keys)
            keys = [*keys, key]
            stacks[key] = [item]
            tokens, bearing, alive = np.append(tokens, key[0]), np.append(bearing, key[1]), np.append(alive, 1)
        else:
            stacks[key].append(item)
            alive[j] += 1

    waiting = int(alive.sum())
    while waiting:
        rest = cap.copy()
        seq: list[tuple[int, int, int]] = []
        while waiting and rest.min() >= 1:
            fits = (alive > 0) & (tokens <= rest[0]) & (bearing <= rest[2])
            if fits.any():
                score = tokens / cap[0] * (rest[0] / cap[0]) + rest[1] / cap[1] / cap[1] + bearing / cap[2] * (rest[2] / cap[2])
                j = int(np.argmax(np.where(fits, score, -1.0)))
                size = int(tokens[j])
            else:
                j = int(np.argmax(np.where(alive > 0, tokens, -1.0)))
                size = int(min(rest[0], rest[2]))
            item = stacks[keys[j]].pop()
            alive[j] -= 1
            waiting -= 1
            here = int(min(size, keys[j][1])) if size < keys[j][0] else keys[j][1]
            seq.append((item, int(start[item]), size))
            rest -= (size, 1, here)
            start[item] += size
            if size < keys[j][0]:
                remains = keys[j][0] - size
                add((remains, min(remains, keys[j][1])), item)
                waiting += 1
        total = sum(p[2] for p in seq)
        if total == limits[0] or total & (total - 1) == 0:
            out.append(seq)
        else:
            out += _powers_of_two(seq, total)
    return out


def _powers_of_two(seq: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of a short sequence, cut into sequences of power-of-two lengths."""
    out, pieces, at = [], list(seq), 0
    for k in range(total.bit_length() - 1, -1, -1):
        want, part = total & (1 << k), []
        while want:
            item, start, size = pieces[at]
            take = min(size, want)
            part.append((item, start, take))
            want -= take
            if take < size:
                pieces[at] = (item, start + take, size - take)
            else:
                at += 1
        if part:
            out.append(part)
    return out


def _pack(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], limits: tuple[int, int, int], group_tokens: int) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 40, 0
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size, made
        doc = pa.concat_arrays([h[0] for h in held])
        ids = np.concatenate([h[1] for h in held])
        length = np.concatenate([h[2] for h in held])
        first = np.cumsum(length) - length
        view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        cols: list[list[int]] = [[] for _ in range(8)]
        for seq in pack_group(length, np.maximum(length - 1, 0), limits):
            at, whole = 0, sum(p[2] for p in seq)
            for item, start, n in seq:
                begin = 4 * int(first[item] + start)
                bearing = n - (start == 0)  # nothing stands before a document's first id
                for c, v in zip(cols, (item, start, n, zlib.crc32(view[begin : begin + 4 * n]), base + made, at, bearing, whole), strict=True):
                    c.append(v)
                at += n
            made += 1
        item = np.asarray(cols[0], np.int64)
        held, size = [], 0
        values = [doc.take(pa.array(item)), *(pa.array(np.asarray(c, np.int64)) for c in (cols[1], cols[2], cols[3], length[item], *cols[4:]))]
        return pa.RecordBatch.from_arrays(values, names=[f.split()[0] for f in SCHEMA.split(", ")])

    for batch in batches:
        ids, first = bpe.encode(batch.column("text"), paths)
        n = len(first) - 1
        length = np.diff(first) + 1
        ids = np.insert(ids, first[1:], END_ID)
        ends = np.cumsum(length)
        # Close a group at the first document that brings it to ``group_tokens``.
        i = 0
        while i < n:
            before = ends[i - 1] if i else 0
            j = min(n, int(np.searchsorted(ends, before + group_tokens - size)) + 1)
            held.append((batch.column("doc_id").slice(i, j - i), ids[before : ends[j - 1]], length[i:j]))
            size += int(ends[j - 1] - before)
            i = j
            if size >= group_tokens:
                yield flush()
    if held:
        yield flush()


def pack(
    docs: DataFrame,
    paths: tuple[str, str] | None = None,
    limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS),
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece, see ``SCHEMA``.  ``paths``: the tokenizer's JSON file and its ranks."""
    python_ready(docs.sparkSession)
    paths = paths or bpe.default_paths()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, paths, limits, group_tokens), SCHEMA)


def cut_example(lengths: list[int], loss: list[bool], limits: tuple[int, int, int]) -> list[tuple[int, int, int, int]]:
    """Pieces (start, length, segments, loss-bearing) of an example with segments of these lengths, each within the limits."""
    out: list[tuple[int, int, int, int]] = []
    whole = (sum(lengths), len(lengths), sum(n for n, bears in zip(lengths, loss, strict=True) if bears))
    if all(d <= c for d, c in zip(whole, limits, strict=True)):
        return [(0, *whole)]
    at, size, segs, bearing = 0, 0, 0, 0
    for n, bears in zip(lengths, loss, strict=True):
        while n:
            room = min(limits[0], limits[2]) if bears else limits[0]
            take = min(n, room)
            if segs and (size + take > limits[0] or segs == limits[1] or bearing + take * bears > limits[2]):
                out.append((at, size, segs, bearing))
                at, size, segs, bearing = at + size, 0, 0, 0
            size, segs, bearing, n = size + take, segs + 1, bearing + take * bears, n - take
    if segs:
        out.append((at, size, segs, bearing))
    return out


def pack_vectors(demands: np.ndarray, limits: tuple[int, int, int]) -> list[list[int]]:
    """Bins of item numbers by dot products: a bin takes, again and again, the item that
    fits and whose scaled demand has the largest dot product with what is left, each limit
    weighed by the mean demand on it.  Ties go to the first of the distinct demands in order,
    and of these to the first item; every demand must keep within the limits."""
    if not len(demands):
        return []
    kinds, kind_of = np.unique(np.asarray(demands, np.int64), axis=0, return_inverse=True)
    order = np.argsort(kind_of.ravel(), kind="stable")
    left = np.bincount(kind_of.ravel(), minlength=len(kinds))
    first = np.cumsum(left) - left
    cap = np.asarray(limits, float)
    scaled = kinds / cap
    weight = scaled[kind_of.ravel()].mean(0)
    out: list[list[int]] = []
    alive = np.flatnonzero(left)
    while len(alive):
        rest, taken = np.asarray(limits, np.int64), []
        while True:
            fits = alive[(kinds[alive] <= rest).all(1) & (left[alive] > 0)]
            if not len(fits):
                break
            j = int(fits[np.argmax(scaled[fits] @ (weight * rest / cap))])
            taken.append(int(order[first[j]]))
            first[j] += 1
            left[j] -= 1
            rest = rest - kinds[j]
        out.append(taken)
        alive = alive[left[alive] > 0]
    return out


def _pack_examples(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], limits: tuple[int, int, int], group_tokens: int) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 40, 0
    names = [f.split()[0] for f in EXAMPLE_SCHEMA.split(", ")]
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size, made
        rows = []
        for seq in pack_vectors(np.array([h[2:5] for h in held]), limits):
            at, whole = 0, sum(held[i][2] for i in seq)
            for i in seq:
                conv, start, length, segs, bearing, crc, tokens = held[i]
                rows.append((conv, start, length, segs, bearing, crc, tokens, base + made, at, whole))
                at += length
            made += 1
        held, size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    for batch in batches:
        segments = batch.column("segments")
        # Segments that hold no text of their own are none; neighbours of one flag are one.
        convs, texts, flags, counts = batch.column("conv_id").to_pylist(), [], [], []
        for example in segments.to_pylist():
            before = len(texts)
            for s in example or ():
                if s and s["text"]:
                    if len(texts) > before and flags[-1] == bool(s["loss"]):
                        texts[-1].append(s["text"])
                    else:
                        texts.append([s["text"]])
                        flags.append(bool(s["loss"]))
            counts.append(len(texts) - before)
        ids, first = bpe.encode(pa.array(["".join(t) for t in texts], pa.large_string()), paths)
        view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        at = 0
        for conv, n in zip(convs, counts, strict=True):
            lengths, loss = np.diff(first[at : at + n + 1]).tolist(), flags[at : at + n]
            begin = int(first[at])
            for start, length, segs, bearing in cut_example(lengths, loss, limits):
                crc = zlib.crc32(view[4 * (begin + start) : 4 * (begin + start + length)])
                if length:
                    held.append((conv, start, length, segs, bearing, crc, sum(lengths)))
                    size += length
            at += n
            if size >= group_tokens:
                yield flush()
    if held:
        yield flush()


def pack_examples(
    examples: DataFrame,
    paths: tuple[str, str] | None = None,
    limits: tuple[int, int, int] = EXAMPLE_LIMITS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece of ``examples`` (``conv_id, segments``: array of text and loss), see ``EXAMPLE_SCHEMA``.

    Rows of a task are sorted by ``conv_id``, so a task that runs again packs them alike."""
    python_ready(examples.sparkSession)
    paths = paths or bpe.default_paths()
    rows = examples.select(F.col("conv_id").cast("long").alias("conv_id"), "segments").sortWithinPartitions("conv_id", "segments")
    return rows.mapInArrow(lambda it: _pack_examples(it, paths, limits, group_tokens), EXAMPLE_SCHEMA)
