import random

import brute
import pytest

from nearfold.llm import ngram_join as nj


def check(df):
    rows = df.select("doc_id", "text").collect()
    docs = {r.doc_id: r.text for r in rows}
    want = brute.near(docs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.ngram_join(df).collect()}
    assert len(rows) == len(docs) and got == want
    return got


def test_documents_equal_brute_force(docs):
    check(docs)


def variants(n, words, edits, rng):
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small,block", [(16, 512), (4, 8)])
def test_groups_of_near_copies(spark, monkeypatch, small, block):
    """Links at every similarity around the threshold, in groups smaller and larger than a block."""
    monkeypatch.setattr(nj, "SMALL", small)
    monkeypatch.setattr(nj, "BLOCK", block)
    rng = random.Random(7)
    texts = [t for n, w, e in ((40, 120, 6), (30, 60, 4), (12, 300, 14), (2, 8, 2)) for t in variants(n, w, e, rng)]
    texts += texts[:5] * 3 + ["one two", "one two", "one two three", "", " ", "x"]
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_long_texts_get_smaller_blocks(spark, monkeypatch):
    """60 near copies of 400 words, fewer than a block of classes: blocks are bounded by shingles too."""
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 4000, raising=False)
    in_blocks, most = nj._in_blocks, []

    def watched(df, task, schema):
        held = df.selectExpr("grp", "block", "size(shingles) AS n").groupBy("grp", "block").sum("n").collect()
        most.append(max((r["sum(n)"] for r in held), default=0))
        return in_blocks(df, task, schema)

    monkeypatch.setattr(nj, "_in_blocks", watched)
    texts = variants(60, 400, 12, random.Random(5))
    check(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert 0 < max(most) < 16_000


def test_odd_rows(odd):
    got = nj.ngram_join(odd).collect()
    assert len(got) == odd.count()
    five = [r for r in got if r.doc_id == 5]
    assert [(r.class_id, r.copies, r.n_links) for r in five] == [(5, 5, 5)] * 2
    assert [r.is_first for r in five] == [True, True]  # equal rows: the caller keeps one of them
    assert {r.class_id for r in got if r.doc_id in (6, 7, 11)} == {5}
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in got if r.n_shingles == 0)


def test_empty_table(empty):
    assert nj.ngram_join(empty).count() == 0


def test_pruning_bound_is_the_posterior():
    """P(Beta(m + 1, n - m + 1) >= t) at and below the bound, by summing the density."""
    import numpy as np

    s = (np.arange(200_000) + 0.5) / 200_000
    for n, m in nj.fewest_matches().items():
        for k, below in ((m, False), (m - 1, True)):
            if k < 0:
                continue
            density = np.exp(k * np.log(s) + (n - k) * np.log1p(-s) - (k * np.log(0.8) + (n - k) * np.log(0.2)))
            assert (density[s >= 0.8].sum() / density.sum() < nj.TOLERANCE) == below


def test_pruned_pairs_are_dropped_and_alike_ones_kept():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (4, nj.HASHES), dtype=np.uint16)
    b = a.copy()
    b[1, ::6] += 1  # 5 of 6 equal
    b[2, ::2] += 1  # half equal
    b[3] += 1
    assert nj.plausible(a, b).tolist() == [True, True, False, False]
