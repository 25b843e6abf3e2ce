import collections

import brute

from nearfold.llm import bpe
from nearfold.llm.token_counts import BPE, BYTES, WORDS, TokenLedger, change_feed
from nearfold.session import scratch_path


def expected(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_paths()[0])
    out = collections.Counter()
    for text, source, lang in docs:
        text = text or ""
        for name, n in ((WORDS, len(brute.words(text))), (BPE, len(t.encode(text, add_special_tokens=False).ids)), (BYTES, len(text.encode()))):
            out[(source, lang, name, "documents")] += 1
            out[(source, lang, name, "tokens")] += n
    return {k: v for k, v in out.items() if v}


def totals(ledger):
    out = {}
    for r in ledger.rollup().collect():
        out[(r.source, r.lang, r.tokenizer, "documents")] = r.documents
        out[(r.source, r.lang, r.tokenizer, "tokens")] = r.tokens
    return {k: v for k, v in out.items() if v}


def ledger(spark):
    return TokenLedger(spark, scratch_path(spark, "test_tokens"))


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, doc_id long, text string, source string, lang string")


def test_documents_and_feed(spark, docs):
    led = ledger(spark)
    load, fix = change_feed(docs)
    led.commit(0, load)
    rows = docs.collect()
    assert totals(led) == expected([(r.text, r.source, r.lang) for r in rows])
    led.commit(1, fix)
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r)
    want = expected([(r.text.rstrip(" \t\n\x0b\x0c\r"), r.source, r.lang) for r in first.values()])
    assert totals(led) == want
    led.commit(1, fix)
    assert totals(led) == want


def test_inserts_revisions_deletes_and_replays(spark):
    led = ledger(spark)
    led.commit(0, changes(spark, [("insert", 1, "a b", "s", "en"), ("insert", 2, "c", None, None), ("insert", 3, None, "s", "en")]))
    one = changes(spark, [("revise", 1, "a b c d", "t", "en"), ("delete", 2, None, None, None), ("delete", 99, None, None, None), ("revise", 4, "new", "s", "en")])
    led.commit(1, one)
    want = expected([("a b c d", "t", "en"), (None, "s", "en"), ("new", "s", "en")])
    assert totals(led) == want
    led.commit(1, one)
    assert totals(led) == want
    # A new driver finds the committed batches on storage.
    later = TokenLedger(spark, led.path)
    assert later.committed == {0, 1} and totals(later) == want
    later.commit(2, changes(spark, [("insert", 1, "z", "s", "en"), ("delete", 3, None, None, None), ("delete", 4, None, None, None)]))
    assert totals(later) == expected([("z", "s", "en")])
    assert {(r.added, r.retracted) for r in later.rollup().where("source = 's' AND tokenizer = 'words@1'").collect()} == {(4, 3)}


def test_odd_rows_and_empty_batches(spark, odd, empty):
    led = ledger(spark)
    led.commit(0, change_feed(empty)[0])
    assert totals(led) == {}
    led.commit(1, change_feed(odd)[0])
    rows = odd.collect()
    assert totals(led) == expected([(r.text, r.source, r.lang) for r in rows])
    led.commit(2, changes(spark, [("delete", i, None, None, None) for i in range(1, 12)]))
    assert sum(v for k, v in totals(led).items() if k[3] == "documents") == 3 * 2


def test_every_row_of_repeated_and_null_ids_counts(spark):
    rows = [(7, "a b"), (7, "a b"), (7, "c"), (None, "a b"), (None, "a b"), (None, None), (3, "c"), (9, "tail \n"), (9, "a b"), (8, "tail \n"), (None, "x ")]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string")
    led = ledger(spark)
    load, fix = change_feed(docs)
    led.commit(0, load)
    assert totals(led) == expected([(t, "s", "en") for _, t in rows])
    for _ in range(2):
        led.commit(1, fix)
        # (7, c) and (9, a b), (9, tail) have a smaller id elsewhere; white space at the end goes; null ids stay.
        left = ["a b", "a b", "a b", "a b", None, "c", "tail", "x"]
        assert totals(led) == expected([(t, "s", "en") for t in left])


def test_a_crash_leaves_the_earlier_state(spark, monkeypatch):
    led = ledger(spark)
    led.commit(0, changes(spark, [("insert", 1, "a b", "s", "en")]))
    other = changes(spark, [("insert", 2, "c d e", "s", "en")])
    monkeypatch.setattr(led.spark, "createDataFrame", lambda *a, **k: 1 / 0)  # after the entries are written
    try:
        led.commit(0, other)
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert totals(TokenLedger(spark, led.path)) == totals(led) == expected([("a b", "s", "en")])


def test_an_id_and_a_text_never_meet(spark):
    led = ledger(spark)
    led.commit(0, changes(spark, [("insert", None, "5", "s", "en"), ("insert", 5, "x", "s", "en")]))
    led.commit(1, changes(spark, [("delete", 5, None, None, None)]))
    assert totals(led) == expected([("5", "s", "en")])


def test_conflicting_rows_in_one_batch(spark):
    led = ledger(spark)
    led.commit(0, changes(spark, [("insert", 1, "a", "s", "en"), ("insert", 1, "a", "s", "en"), ("delete", 2, None, None, None), ("insert", 2, "b", "s", "en")]))
    assert totals(led) == expected([("a", "s", "en")] * 2)
    led.commit(1, changes(spark, [("revise", 1, "x", "s", "en"), ("revise", 1, "y z", "s", "en"), ("add", 3, "q", "s", "en"), ("remove", 3, "q", None, None)]))
    assert totals(led)["s", "en", WORDS, "documents"] == 2


def test_gaps_are_refused(spark):
    import pytest

    led = ledger(spark)
    with pytest.raises(ValueError):
        led.commit(3, changes(spark, [("insert", 1, "a", "s", "en")]))
