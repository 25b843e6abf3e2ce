"""Property-based checks (hypothesis) of the two rules everything else builds on."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from nearfold.operators import knn
from nearfold.operators import sampling as S


@settings(max_examples=200, deadline=None)
@given(
    rows=st.integers(1, 4),
    cols=st.integers(1, 30),
    k=st.integers(1, 12),
    seed=st.integers(0, 10_000),
)
def test_select_topk_equals_full_sort_with_ties(rows, cols, k, seed):
    rng = np.random.default_rng(seed)
    D = rng.integers(0, 4, size=(rows, cols)).astype(float)  # few values: many ties
    D[rng.random((rows, cols)) < 0.1] = np.inf
    I = rng.permutation(10 * cols)[:cols][None, :].repeat(rows, 0).astype(np.int64)
    d, i = knn.select_topk(D, I, k)
    for r in range(rows):
        # +inf marks a non-candidate: it is dropped on output, so only finite entries count
        order = [j for j in np.lexsort((I[r], D[r]))[: min(k, cols)] if np.isfinite(D[r][j])]
        fin = np.isfinite(d[r])
        assert i[r][fin].tolist() == I[r][order].tolist()
        assert d[r][fin].tolist() == D[r][order].tolist()


WS = [" ", "\t", "\n", " ", " ", "\x1c", "　", "\r\n"]
WORDS = ["a", "bb", "Ünï", "x" * 25, ".", ". ", "..", "word", "end."]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WORDS + WS), max_size=60), min_size=1, max_size=8))
def test_sentence_rule_matches_python(spark, docs):
    texts = ["".join(parts) for parts in docs]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["pos"], r["text"]) for r in S.sentences(df).orderBy("doc_id", "pos").collect()]
    exp = []
    for doc_id, text in rows:
        for pos, piece in enumerate(" ".join(text.split()).split(". ")):
            p = piece.strip()
            if 20 < len(p) < 300:
                exp.append((doc_id, pos, p))
    assert got == exp
