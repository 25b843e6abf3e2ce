import collections

import brute
import pytest
from test_mixing import targets

import corpus_pipeline as cp
from nearfold.llm import quality_rules

STAGE = dict(cp.STAGES)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark, docs):
    """Each stage's result on its own predecessor's."""
    out = [docs]
    for _, f in cp.STAGES[:-1]:
        out.append(spark.createDataFrame(f(spark, out[-1], "/root/testdata/sf0.001").collect(), docs.schema))
    return out


def test_order_of_stages():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources", "packing"]


def test_quality_stage_keeps_what_the_ledger_keeps(docs, stages):
    kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").collect()}
    assert rows(stages[1]) == rows(docs.where(docs.doc_id.isin(*kept)))
    assert all(not brute.quality(r.text)["base_failed"] for r in stages[1].collect())


def test_exact_stage(stages):
    groups = collections.defaultdict(list)
    for r in stages[1].collect():
        groups[brute.norm_sha(r.text)].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in stages[2].collect()} == {min(g)[1] for g in groups.values()}


def test_near_stage(stages):
    found = brute.near({r.doc_id: r.text for r in stages[2].collect()})
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({c for c, _ in found.values()})


def test_mixing_stage_meets_targets_in_whole_documents(stages):
    sizes, longest = collections.Counter(), collections.Counter()
    for r in stages[3].collect():
        n = len(brute.words(r.text))
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    got, times = collections.Counter(), collections.Counter()
    for r in stages[4].collect():
        got[r.source] += len(brute.words(r.text))
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    for s, t in targets(sizes).items():
        assert abs(got[s] - t) <= longest[s]


def test_run_packs_the_mix(spark, stages):
    want = collections.Counter(r.doc_id for r in stages[4].collect())
    got = collections.Counter()
    for r in cp.run(spark, "/root/testdata/sf0.001").collect():
        got[r.doc_id] += r.length
    assert set(got) == set(want)
    from test_packing import ids_of

    texts = {r.doc_id: r.text for r in stages[4].collect()}
    lengths = dict(zip(texts, (len(x) for x in ids_of(list(texts.values())))))
    assert all(got[d] == n * lengths[d] for d, n in want.items())


@pytest.mark.parametrize("name", list(STAGE))
def test_odd_rows_and_empty_tables(spark, odd, empty, name):
    for df in (odd, empty):
        out = STAGE[name](spark, df, "")
        if name != "packing":
            assert out.columns == df.columns
        n = out.count()
        assert n == 0 if df is empty else n > 0


def test_repeated_rows_keep_clashing_columns(spark, odd):
    """Columns named like the stages' own (``_id``, ``_th``, ``_times``) pass through mixing unchanged."""
    from pyspark.sql import functions as F

    import corpus_pipeline as P

    docs = odd.withColumns({"_id": F.lit("mine"), "_th": F.lit("too"), "_times": F.lit(9)})
    out = P.mixed(spark, docs, "")
    assert out.columns == docs.columns
    assert {(r["_id"], r["_th"], r["_times"]) for r in out.collect()} == {("mine", "too", 9)}
