import collections

import brute
from pyspark.sql import functions as F

from nearfold.llm import mixing


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, all_w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / all_w > cap * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / all_w for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def check(df, **params):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(brute.words(r.text))
    want = targets(sizes)
    got = mixing.mix(df, **params).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    by_key = {}
    source_of = collections.defaultdict(set)
    for r in rows:
        source_of[(r.doc_id, len(brute.words(r.text)))].add(r.source)
    for r in got:
        sources = source_of[(r.doc_id, r["size"])]
        assert 0 <= r.taken <= 3 * r["size"]
        if len(sources) == 1:
            (s,) = sources
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
            taken[s] += r.taken
            by_key[s] = True
    for s in by_key:
        assert abs(taken[s] - want[s]) <= 1, s
    return got


def test_targets_are_met_to_the_word(docs):
    check(docs)


def test_small_blocks(docs):
    check(docs, block=16)


def test_reruns_agree(docs):
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_odd_rows(odd):
    check(odd, block=64)


def test_one_source_and_no_words(spark, empty):
    assert mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(none).collect()] == [(0, 0.0, 0)] * 2
    one = spark.createDataFrame([(1, "a b c", "a"), (2, "d", "a")], "doc_id long, text string, source string")
    assert {r.doc_id: r.taken for r in mixing.mix(one).collect()} == {1: 3, 2: 1}


def test_points_are_bit_reversed(spark):
    got = [r.u for r in spark.range(8).select(mixing.van_der_corput(F.col("id")).alias("u"), "id").orderBy("id").collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


def test_schedule_spreads_sources(spark):
    t = spark.createDataFrame([(0, "a", 8192 * 5, 5.0 * 8192), (1, "b", 8192 * 3, 3.0 * 8192)], "s_rank int, source string, source_size long, target double")
    rows = sorted((r.slot, r.s_rank, r.k) for r in mixing.schedule(t, block=8).collect())
    assert collections.Counter(r[1] for r in rows) == {0: 5120, 1: 3072}
    for cut in range(512, 8192, 512):
        here = sum(r[1] == 0 for r in rows[:cut])
        assert abs(here - cut * 5 / 8) <= 8
    for s in (0, 1):
        assert [r[2] for r in rows if r[1] == s] == list(range(sum(r[1] == s for r in rows)))
