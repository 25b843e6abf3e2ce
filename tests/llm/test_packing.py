import collections
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfold.llm import bpe, packing


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_paths()[0])
    return [[*x.ids, 1] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(df, **params):
    rows = df.select("doc_id", "text").collect()
    want = collections.Counter()
    for r, ids in zip(rows, ids_of([r.text for r in rows])):
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    got = packing.pack(df, **params).collect()
    by_seq = collections.defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
    limits = params.get("limits", (packing.MAX_TOKENS, packing.MAX_SEGMENTS, packing.MAX_LOSS))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits[0] and len(pieces) <= limits[1] and sum(r.loss_tokens for r in pieces) <= limits[2]
        assert {r.sequence_length for r in pieces} == {at}
    # Each document's pieces follow one another to its end.
    cover = collections.Counter()
    for r in got:
        cover[(r.doc_id, r.doc_tokens)] += r.length
    total = collections.Counter()
    for (d, n, _), c in want.items():
        total[(d, n)] += n * c
    assert cover == total
    whole = collections.Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got if r.length == r.doc_tokens)
    assert not whole - want
    return got, by_seq


def test_documents(docs):
    got, by_seq = check(docs)
    lengths = [sum(r.length for r in p) for p in by_seq.values()]
    assert sum(2048 - n for n in lengths if n & (n - 1)) == 0


def test_pieces_have_their_documents_ids(docs):
    ids = dict(zip([r.doc_id for r in docs.collect()], ids_of([r.text for r in docs.collect()])))
    for r in packing.pack(docs, group_tokens=5000).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32


def test_odd_rows(odd):
    check(odd, group_tokens=1000)


def test_limits_on_segments_and_loss(docs):
    check(docs, limits=(512, 3, 400))


def test_empty_table(empty):
    assert packing.pack(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), max_size=40), st.sampled_from([(32, 4, 32), (32, 2, 20), (16, 16, 5)]))
def test_every_token_once_within_limits(items, limits):
    lengths = np.array([n for n, _ in items], np.int64)
    loss = np.array([min(n, k) for n, k in items], np.int64)
    seen = collections.defaultdict(list)
    for seq in packing.pack_group(lengths, loss, limits):
        assert sum(p[2] for p in seq) <= limits[0] and len(seq) <= limits[1]
        for item, start, n in seq:
            seen[item].append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[i]):
            assert start == at and k > 0
            at += k
        assert at == n


@pytest.mark.parametrize("text", ["", " ", "a", "a ", " a  b\n\nc", "x y   z", "a<|endoftext|> b", "don't we'll", "日本 語", "\n", "a  b"])
def test_ids_equal_the_tokenizers(text):
    import pyarrow as pa

    ids, first = bpe.encode(pa.array([text, "mid dle", text]), bpe.default_paths())
    want = [x[:-1] for x in ids_of([text, "mid dle", text])]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want


def _brute_vectors(demands, limits):
    """The dot-product rule item by item, in exact order of demand and number."""
    left, out = sorted(range(len(demands)), key=lambda i: (tuple(demands[i]), i)), []
    mean = [sum(d[k] / limits[k] for d in demands) / len(demands) for k in range(3)]
    while left:
        rest, taken = list(limits), []
        while True:
            fits = [i for i in left if all(demands[i][k] <= rest[k] for k in range(3))]
            if not fits:
                break
            score = lambda i: sum(demands[i][k] / limits[k] * mean[k] * rest[k] / limits[k] for k in range(3))
            top = max(map(score, fits))
            best = next(i for i in fits if score(i) >= top - 1e-12)
            taken.append(best)
            left.remove(best)
            rest = [r - d for r, d in zip(rest, demands[best])]
        out.append(taken)
    return out


def _spare(demands, limits, bins):
    return [tuple(sum(demands[i][k] for i in b) for k in range(3)) for b in bins]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 8), st.integers(0, 32)), max_size=25))
def test_vectors_follow_the_dot_product(demands):
    limits = (64, 8, 32)
    bins = packing.pack_vectors(np.array(demands).reshape(-1, 3), limits)
    assert sorted(i for b in bins for i in b) == list(range(len(demands)))
    assert all(all(x <= c for x, c in zip(total, limits)) for total in _spare(demands, limits, bins))
    if demands:
        want = _brute_vectors(demands, limits)
        assert len(bins) == len(want) and _spare(demands, limits, bins) == _spare(demands, limits, want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.booleans()), max_size=12))
def test_cut_examples_cover_every_token_within_the_limits(segments):
    lengths, loss, limits = [n for n, _ in segments], [b for _, b in segments], (40, 3, 20)
    marks = [b for n, b in segments for _ in range(n)]
    pieces = packing.cut_example(lengths, loss, limits)
    at = 0
    for start, length, segs, bearing in pieces:
        assert start == at and segs <= 3 and length <= 40 and bearing <= 20
        assert bearing == sum(marks[start : start + length])
        at += length
    assert at == len(marks)


def test_examples_of_all_limits(spark):
    """Pieces hold the tokenizer's ids of every segment; each limit binds; odd rows have their defined results."""
    from pyspark.sql import functions as F

    rows = [(i, [("user words " * (1 + i % 9), False), ("an answer " * (1 + i * 7 % 11), True)] * (1 + i % 3)) for i in range(60)]
    rows += [(60, None), (61, []), (62, [("", True), (None, False)]), (None, [("no id", True)]), (None, [("no id", True)]),
             (63, [("long " * 400, True), ("x", False)]), (64, [("two ", False), ("parts", False)])]
    df = spark.createDataFrame(rows, "conv_id long, segments array<struct<text:string,loss:boolean>>").withColumn("length", F.lit("no")).repartition(2)
    limits = (120, 6, 60)
    got = packing.pack_examples(df, limits=limits).collect()
    joined = lambda segs: [("".join(t for t, _ in g), b) for b, g in ((b, list(g)) for b, g in itertools.groupby(
        [(t, b) for t, b in segs or () if t], key=lambda x: x[1]))]
    want = collections.Counter()
    for conv, segs in rows:
        ids = [x for t, _ in joined(segs) for x in ids_of([t])[0][:-1]]
        bearing = sum(len(ids_of([t])[0]) - 1 for t, b in joined(segs) if b)
        if ids:
            want[conv] += len(ids)
            pieces = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.start)
            assert {r.example_tokens for r in pieces} == {len(ids)}
            for r in pieces:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            if len(ids) <= 120 and len(joined(segs)) <= 6 and bearing <= 60 and conv is not None:
                assert [(r.length, r.segments, r.loss_tokens) for r in pieces] == [(len(ids), len(joined(segs)), bearing)]
    cover = collections.Counter()
    by_seq = collections.defaultdict(list)
    for r in got:
        cover[r.conv_id] += r.length
        by_seq[r.sequence_id].append(r)
    assert cover == want
    totals = []
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        totals.append((at, sum(r.segments for r in pieces), sum(r.loss_tokens for r in pieces)))
        assert {r.sequence_length for r in pieces} == {at}
    assert all(a <= b for t in totals for a, b in zip(t, limits))
    assert max(t[1] for t in totals) == 6 and max(t[2] for t in totals) >= 55 and max(t[0] for t in totals) >= 100
    assert packing.pack_examples(df.limit(0)).count() == 0
