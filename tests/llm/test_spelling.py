import collections
import re
import zlib

import pytest

from nearfold.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    out = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = counts(rows)
    by = collections.defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by[len(w) + k] if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def check(df):
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = spelling.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_equals_brute_force(spark, docs):
    want = check(docs)
    assert sum(r[1] is not None for r in want) > 20


def test_odd_rows(spark, odd):
    check(odd)


def test_empty_table(spark, empty):
    assert spelling.spelling_variants(empty).count() == 0


def test_chains_edits_and_long_runs(spark):
    words = {"spelling": 40, "speling": 9, "spelng": 3, "spellling": 3, "xspelling": 3, "spelljng": 4, "écolier": 12, "ècolier": 5, "a" * 90: 8, "a" * 91: 3, "b" + "a" * 89: 3, "aaaaa": 6, "aaaaaa": 3, "quote": 3, "quoted": 7}
    rows = [(i, " ".join([w.upper() if i % 3 == 0 and w.isascii() else w] * n)) for i, (w, n) in enumerate(words.items())]
    rows += [(None, "x" * 200_000 + " ×÷×÷×÷ " * 4), (90, None)]
    want = check(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {r[0]: r for r in want}
    assert by["spelng"][1:3] == ("speling", "spelling") and by["xspelling"][1] == "spelling"
    assert by["×÷×÷×÷"][3] == 4


@pytest.mark.parametrize("prefix", ["", "abc:"])
def test_hashes_equal_zlib(prefix):
    import numpy as np

    words = [b"", b"a", b"hello", "é".encode() * 9, b"q" * 47, b"q" * 48, b"q" * 500]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    data = np.frombuffer(b"".join(words), np.uint8)
    at = np.array([6, 0, 3, 1, 2, 5, 4, 2])
    got = spelling._hashes(np.full(len(at), zlib.crc32(prefix.encode()), np.uint32), at, offsets, data)
    assert got.tolist() == [zlib.crc32(prefix.encode() + words[i]) for i in at]
