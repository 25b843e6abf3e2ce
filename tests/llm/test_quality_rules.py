import brute

from nearfold.llm import quality_rules as q


def check(spark, df):
    led = q.apply_policy(q.ledger(df)).collect()
    texts = [r.text for r in df.select("text").collect()]
    assert len(led) == len(texts)
    key = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted(tuple(brute.quality(t)[k] for k in key) for t in texts)
    assert sorted(tuple(r[k] for k in key) for r in led) == want
    for r in led:
        assert not (r.base_failed and r.kept)
    return led


def test_measures_equal_brute_force(spark, docs):
    check(spark, docs)


def test_odd_rows(spark, odd):
    led = check(spark, odd)
    assert sum(r.failed_bits & q.bit("too_short") > 0 for r in led) == 7


def test_empty_table(spark, empty):
    assert q.apply_policy(q.ledger(empty)).count() == 0


def test_junk_fails_and_prose_stays(spark):
    prose = " ".join(f"word{i} and" for i in range(40))
    rows = [(1, prose), (2, " ".join(f"word{i}###" for i in range(80))), (3, prose.upper()), (4, "\n".join(["a line of words here"] * 30)), (5, "short")]
    led = {r.doc_id: r for r in q.apply_policy(q.ledger(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [led[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert [led[i].base_failed for i in range(1, 6)] == [False, False, False, True, True]


def test_ablations_equal_direct_counts(spark, docs):
    led = q.ledger(docs)
    bits = [r.failed_bits for r in led.collect()]
    for r in q.ablations(led).collect():
        mask, bit = q.mask(r.policy), q.bit(r.rule)
        assert r.n_failed == sum(b & bit > 0 for b in bits)
        assert r.n_only_this == sum(b & mask == bit for b in bits)
        assert r.n_kept == sum(b & mask == 0 for b in bits)
        assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)


def test_policies_read_the_stored_ledger_only(spark, docs):
    led = q.stored_ledger(docs)
    plan = q.ablations(led)._jdf.queryExecution().toString() + q.apply_policy(led, "v1")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "documents.parquet" not in plan
    assert sorted(map(tuple, led.collect())) == sorted(map(tuple, q.ledger(docs).collect()))
