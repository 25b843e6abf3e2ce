import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from nearfold.llm import collocations as C

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= 30}
    around = collections.defaultdict(int)
    for (g, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                around[g, p[i : i + k]] = max(around[g, p[i : i + k]], a)
    by = collections.defaultdict(list)
    for (g, p), a in cand.items():
        if 100 * around[g, p] >= 80 * a:
            continue
        score, k = min((2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p)))
        by[g].append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return sorted(
        (g, i + 1, p.decode(), -a, l, r, n[g], -s) for g, xs in by.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top])
    )


def check(df, **more):
    want = brute([(r.lang, r.text) for r in df.select("lang", "text").collect()], more.get("top", 2000))
    got = C.collocations(df, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = check(docs)
    assert len(want) > 200


def test_many_tries_and_a_short_list(spark, docs):
    assert len(check(docs, max_candidates=150, top=7)) > 7


def test_odd_rows(spark, odd):
    check(odd)


def test_empty_table(spark, empty):
    assert C.collocations(empty).count() == 0


def test_pieces_nesting_and_ties(spark):
    rows = [("xx", "New York City.\tnew york, city")] * 40 + [(None, "a b c d e " * 35 + "\x0b x\x01y é É")] * 2 + [("und", "b c. b\nc")] * 20
    rows += [("xx", "new york" + " york" * 50)] * 3 + [("yy", "z " * 90)]
    want = check(spark.createDataFrame(rows, "lang string, text string"))
    assert any(r[2] == "new york" for r in want) and any(r[2].count(" ") == 3 for r in want)


@pytest.mark.parametrize("seed", range(4))
def test_double_array_accepts_its_phrases_only(seed):
    rng = np.random.default_rng(seed)
    width, n_codes = 1 + seed % 4, [3, 40, 700, 9000][seed]
    codes = np.minimum(rng.zipf(1.3, (4000, width)) - 1, n_codes - 1)
    langs = rng.integers(0, 3, len(codes))
    rows = np.unique(np.column_stack([langs, codes]), axis=0)
    rows = rows[rng.permutation(len(rows))]
    trie = C.DoubleArray(rows[:, 0], rows[:, 1:], 3, n_codes)
    known = {tuple(r): i for i, r in enumerate(rows.tolist())}
    text = np.minimum(rng.zipf(1.3, 20000) - 1, n_codes - 1)
    text[rng.random(len(text)) < 0.05] = -1
    root = np.repeat(rng.integers(-1, 3, 200), 100)
    joined = rng.random(len(text)) < 0.9
    joined[99::100] = False
    at, phrase = trie.match(root, text, joined)
    got = dict(zip(at.tolist(), phrase.tolist()))
    for i in range(len(text)):
        whole = i + width <= len(text) and joined[i : i + width - 1].all()
        want = known.get((root[i], *text[i : i + width].tolist())) if whole else None
        assert got.get(i) == want


def test_tokens_split_pieces():
    t = C.tokens(pa.array(["A b,c", None, "d\te f\n\ng", "é É"]))
    words = t.vocabulary.cast(pa.large_string()).to_pylist()
    assert [words[c] for c in t.codes] == ["a", "b", "c", "d", "e", "f", "g", "é", "É"]
    assert t.joined.tolist() == [True, False, False, True, True, False, False, True, False]


@pytest.mark.parametrize("n, alone, most", [(1, False, 1), (4, False, 1), (5, False, 3), (8, False, 6), (9, True, 3)])
def test_scans_let_all_tries_meet(n, alone, most):
    """A few tries need one scan a level; more meet in pairs of groups, four in memory (F1)."""
    scans = C._groups(n, alone)
    tries = [{x for g in scan for x in g} for scan in scans]
    assert len(scans) == most and max(map(len, tries)) <= C.SCAN_TRIES
    for a in range(n):
        for b in [a] if alone else range(n):
            assert any({a, b} <= x for x in tries)


def test_several_tries_take_one_scan_a_level(spark, docs, monkeypatch):
    """Two to four tries of a level are matched in one scan of the texts (F1)."""
    words = C.phrase_counts(docs)[0].groupBy("width").count().collect()
    most = max(r["count"] for r in words)
    used, scanner = [], C._scanner
    monkeypatch.setattr(C, "_scanner", lambda tries, *a: used.append(len(tries)) or scanner(tries, *a))
    check(docs, max_candidates=int(most / 1.7))
    assert len(used) == len(words) and 1 < max(used) <= C.SCAN_TRIES
