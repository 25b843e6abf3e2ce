import zlib

import numpy as np
import pyarrow as pa
import pytest

from nearfold.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int, text string"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return T.toxicity(docs, labels), labels, docs


def test_held_out_accuracy(scored):
    out, labels, docs = scored
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id", "left").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in rows)
    test = [r for r in rows if r.held_out and r.toxic is not None]
    hit = sum(r.predicted for r in test if r.toxic)
    assert hit >= 0.9 * sum(r.toxic for r in test)
    assert sum(r.predicted for r in test if not r.toxic) <= 0.05 * sum(1 - r.toxic for r in test)


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in T._parameters(rng).items()}
    words, index = rng.normal(size=(9, T.INPUTS)), rng.integers(0, 9, (6, 4))
    mask = np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    label, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss(p, words):
        states = np.concatenate([T._run(p, s, T._project(p, s, words), index, mask, keep=True)[0] for s in "fb"], axis=2)
        x = T._pool(p, states, mask)[0]
        return (weight * (np.logaddexp(0, x) - label * x)).sum() / weight.sum()

    g, d_words = T._gradients(p, words, index, mask, label, weight)
    for name, grad in [*g.items(), ("inputs", d_words)]:
        if name in ("chars", "words"):
            continue
        value = words if name == "inputs" else p[name]
        at = tuple(rng.integers(0, n) for n in value.shape)
        old, ends = value[at], []
        for step in (1e-2, -1e-2):
            value[at] = old + step
            ends.append(loss(p, words))
        value[at] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - grad[at]) < 2e-4, name


def test_windows_cover_every_word_and_overlap():
    first = np.concatenate([[0], np.cumsum([0, 1, 16, 64, 65, 1000, 0, 112, 113])])
    text, begin, size = T._windows(first)
    for t in range(len(first) - 1):
        own = np.flatnonzero(text == t)
        covered = {w for k in own for w in range(begin[k], begin[k] + size[k])}
        assert covered == set(range(first[t], first[t + 1])) and len(own) >= 1
        assert all(begin[b] < begin[a] + size[a] for a, b in zip(own, own[1:]))


def test_chunks_and_padding_do_not_change_logits():
    rng = np.random.default_rng(1)
    p, words, codes = T._parameters(rng), rng.normal(size=(50, T.INPUTS)).astype(np.float32), rng.integers(0, 50, 900)
    begin, size = rng.integers(0, 800, 40), rng.integers(0, 64, 40)
    whole = T._logits(p, words, codes, begin, size)
    single = [T._logits(p, words, codes, begin[i : i + 1], size[i : i + 1])[0] for i in range(40)]
    assert np.allclose(whole, single, atol=1e-4)


def toy(spark, n=160):
    bad, good = "you are vilefool today my friend", "we are walking home today my friend"
    rows = [(i, bad if i % 2 else good) for i in range(n)]
    return rows, [(i, 1, i % 2, "label") for i in range(n)]


def test_toy_words_reruns_and_late_words(spark):
    rows, labels = toy(spark)
    long = " ".join(f"w{i % 97}" for i in range(40_000))
    docs = spark.createDataFrame([*rows, (900, long + " vilefool"), (901, long), (902, "VILEFOOL!")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, LABELS)
    a, b = ({r.doc_id: r.score for r in T.toxicity(docs, lab).collect()} for _ in range(2))
    assert a == b
    assert a[900] > 0.5 > a[901] and a[902] > 0.5 > a[0]


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = toy(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = T.toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()
    flipped = [(i, q, 1 - t if held(i) else t, x) for i, q, t, x in labels]
    two = T.toxicity(docs, spark.createDataFrame(flipped, LABELS)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_odd_rows_labels_and_empty_tables(spark, odd, empty):
    n = odd.count()
    some = spark.createDataFrame([(5, 1, 1, "x"), (5, 1, 0, "x"), (4, None, None, "x"), (None, 1, 1, "x"), (6, 0, 0, "x"), (10, 0, 0, None), (1, 1, 1, "n"), (2, 1, 0, "")], LABELS)
    for labels in (some, some.limit(0), some.where("toxic = 1")):
        out = T.toxicity(odd, labels).collect()
        assert len(out) == n and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id == 5}) == 1
    assert T.toxicity(empty, some).count() == 0
    assert T.score_texts({"a": np.array(0.0), "b": np.array(0.0)}, pa.array([None, "x"])).tolist() == [0.5, 0.5]
