import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.operators import knn


def brute(X, ids, Q, k, metric):
    X = X.astype(np.float64)
    Q = Q.astype(np.float64)
    if metric == "cosine":
        D = 1 - (Q / np.linalg.norm(Q, axis=1, keepdims=True)) @ (X / np.linalg.norm(X, axis=1, keepdims=True)).T
    elif metric == "l2":
        D = np.sqrt(((Q[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    elif metric == "l1":
        D = np.abs(Q[:, None, :] - X[None, :, :]).sum(-1)
    else:
        D = -(Q @ X.T)
    D = np.round(D, 12)
    out = {}
    for i in range(len(Q)):
        order = np.lexsort((ids, D[i]))[:k]
        out[i] = [(int(ids[j]), float(D[i, j])) for j in order]
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    X = rng.integers(-3, 4, size=(400, 6)).astype(np.float32)  # small integers: many exact ties
    Q = rng.integers(-3, 4, size=(23, 6)).astype(np.float32)
    X[X.sum(1) == 0] += 1  # no zero vectors
    ids = rng.permutation(400).astype(np.int64) * 3
    items = spark.createDataFrame([(int(ids[i]), X[i].tolist()) for i in range(400)], "id bigint, embedding array<float>")
    items = items.repartition(7)
    queries = spark.createDataFrame([(i, Q[i].tolist()) for i in range(23)], "qid bigint, embedding array<float>")
    return X, ids, Q, items, queries


def _as_dict(df):
    out = {}
    for r in df.orderBy("qid", "rk").collect():
        out.setdefault(r["qid"], []).append((r["id"], r["distance"]))
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1", "dot"])
def test_block_knn_equals_brute_force_with_ties(data, metric):
    X, ids, Q, items, queries = data
    got = _as_dict(knn.knn_join(items, queries, 9, metric))
    exp = brute(X, ids, Q, 9, metric)
    for q in range(len(Q)):
        assert [i for i, _ in got[q]] == [i for i, _ in exp[q]], (metric, q)
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in exp[q]], abs=1e-9)


def test_chunked_queries_and_salted_merge_agree(data):
    X, ids, Q, items, queries = data
    one = _as_dict(knn.knn_join(items, queries, 5, "l2"))
    chunked = _as_dict(knn.knn_join(items, queries, 5, "l2", broadcast_limit_bytes=8 * 6 * 5))
    assert one == chunked
    cands = knn.block_candidates(items, np.arange(len(Q)), Q.astype(np.float64), 5, "l2")
    salted = _as_dict(knn.merge_topk(cands, ["qid"], 5, salt_buckets=4))
    assert salted == one


def test_k_larger_than_table_and_empty_queries(spark, data):
    X, ids, Q, items, queries = data
    small = items.limit(3)
    out = knn.knn_join(small, queries, 10, "cosine")
    assert out.groupBy("qid").count().agg(F.max("count")).first()[0] == 3
    empty = queries.where("false")
    assert knn.knn_join(items, empty, 5, "cosine").count() == 0


def test_null_zero_and_wrong_dims_are_not_candidates(spark):
    rows = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 1.0, 0.0]), (5, [float("nan"), 1.0, 1.0])]
    items = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "qid bigint, embedding array<float>")
    for metric in ("cosine", "l2"):
        got = [r["id"] for r in knn.knn_join(items, queries, 5, metric).collect()]
        assert got == [4] if metric == "cosine" else set(got) <= {2, 4}


def test_select_topk_ties_by_id():
    D = np.array([[0.5, 0.1, 0.5, 0.5, 0.2]])
    I = np.array([[9, 4, 3, 1, 7]])
    d, i = knn.select_topk(D, I, 3)
    assert i.tolist() == [[4, 7, 1]]
    assert d.tolist() == [[0.1, 0.2, 0.5]]


def test_cumulative_topk_is_topk_of_union(spark, data):
    X, ids, Q, items, queries = data
    slabbed = items.withColumn("slab", (F.col("id") % 3).cast("long"))
    per = knn.knn_join(slabbed, queries, 4, "l2", group_cols=["slab"])
    cum = knn.cumulative_topk(per, [0, 1, 2], 4, out_col="cut")
    for cut in range(3):
        direct = _as_dict(knn.knn_join(slabbed.where(F.col("slab") <= cut), queries, 4, "l2"))
        via = _as_dict(cum.where(F.col("cut") == cut))
        assert via == direct


def test_one_odd_query_does_not_empty_the_answer(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(6)], "id long, embedding array<double>")
    queries = spark.createDataFrame(
        [(0, [1.0, 1.0, 2.0]), (1, [4.0, 1.0, 2.0]), (2, [1.0, 1.0, 2.0, 9.0]), (3, None)], "qid long, embedding array<double>"
    )
    got = knn.knn_join(items, queries, 3, "l2").collect()
    assert {r["qid"] for r in got} == {0, 1} and len(got) == 6
    assert {(r["qid"], r["reason"]) for r in knn.misfits(queries).collect()} == {(2, "dimension"), (3, "null")}


def test_l2_of_long_near_vectors(spark):
    items = spark.createDataFrame([(i, [37000.0 + 0.001 * i, 5.0]) for i in range(1, 60)], "id long, embedding array<double>")
    got = knn.knn_single(items, [37000.0, 5.0], 4, "l2").collect()
    assert [r["id"] for r in got] == [1, 2, 3, 4]
    assert all(abs(r["distance"] - 0.001 * r["id"]) < 1e-11 for r in got)


def test_tiny_distances_do_not_tie(spark):
    items = spark.createDataFrame([(i, [(5 - i) * 1e-13]) for i in range(5)], "id long, embedding array<double>")
    for metric in ("l1", "l2"):
        assert [r["id"] for r in knn.knn_single(items, [0.0], 2, metric).collect()] == [4, 3]


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1", "dot"])
def test_running_nearest_equals_whole_product_over_blocks(metric, monkeypatch):
    """Blocks screened against the k-th distance so far keep what the whole distance matrix gives, with copies, zeros and infinities."""
    monkeypatch.setattr(knn, "QUERY_STEP", 7)
    monkeypatch.setattr(knn, "ITEM_STEP", 300)
    rng = np.random.default_rng(5)
    for shift in (0.0, 1e4):  # far from the origin single precision tells little apart
        X = np.round(rng.standard_normal((2500, 5)) * 4 + shift, 1)
        X[3], X[4], X[50:400] = 0, np.inf, X[50]
        Q = np.concatenate([X[40:60] + 0.25, np.zeros((1, 5)), rng.standard_normal((9, 5)) * 1e3])
        ids = rng.permutation(2500).astype(np.int64)
        P = knn.prepare_queries(metric, Q)
        D, I = np.full((30, 6), np.inf), np.full((30, 6), -1, np.int64)
        for s in range(0, 2500, 1100):
            knn.keep_nearest(metric, P, np.arange(30), X[s : s + 1100], ids[s : s + 1100], D, I)
        with np.errstate(invalid="ignore"):
            whole = knn.nearest_distances(metric, P, np.arange(30), X, 6)
        wd, wi = knn.select_topk(whole, np.broadcast_to(ids, whole.shape), 6)
        real = np.isfinite(wd)
        assert (np.isfinite(D) == real).all() and np.allclose(D[real], wd[real], rtol=1e-12, atol=1e-10)
        assert (I[real] == wi[real]).mean() > (0.999 if shift == 0 or metric in ("l1", "l2") else 0.0)


def test_running_nearest_keeps_small_arrays():
    """One batch of items against many queries: the memory does not follow queries x items."""
    import tracemalloc

    rng = np.random.default_rng(6)
    X, Q = rng.standard_normal((10_000, 64)), rng.standard_normal((3_000, 64))
    for metric in ("cosine", "l2"):
        state = {(): (np.full((3_000, 10), np.inf), np.full((3_000, 10), -1, np.int64))}
        P = knn.prepare_queries(metric, Q)
        tracemalloc.start()
        knn.keep_nearest(metric, P, np.arange(3_000), X, np.arange(10_000), *state[()])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 96 << 20, (metric, peak)


def test_states_of_all_groups_count_for_the_limit(data, spark, monkeypatch):
    """The running top-k of every group lies in a task: with many groups the join goes by blocks."""
    X, ids, Q, items, queries = data
    grouped = items.withColumn("g", F.pmod("id", F.lit(20)))
    want = sorted(map(tuple, knn.knn_join(grouped, queries, 3, "l2", group_cols=["g"]).collect()))
    monkeypatch.setattr(knn, "block_candidates", lambda *a, **b: pytest.fail("broadcast"))
    limit = 23 * (6 + 2 * 3) * 8  # one group's state
    got = knn.knn_join(grouped, queries, 3, "l2", group_cols=["g"], broadcast_limit_bytes=limit)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1", "dot"])
def test_copies_tie_wherever_they_stand(metric):
    """A copy in another block, or another place of one, has its twin's distance to the last digit, and follows it by id."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        X, ids = np.tile(rng.standard_normal((3_000, 64)), (2, 1)), np.arange(6_000)
        order = rng.permutation(6_000)
        Q = rng.standard_normal((600, 64))
        P = knn.prepare_queries(metric, Q)
        D, I = np.full((600, 100), np.inf), np.full((600, 100), -1, np.int64)
        knn.keep_nearest(metric, P, np.arange(600), X[order], ids[order], D, I)
        assert (D[:, 0::2] == D[:, 1::2]).all() and (I[:, 0::2] + 3_000 == I[:, 1::2]).all()


def test_candidates_leave_a_task_in_bounded_batches():
    """A task's candidates are written out some queries at a time, however many queries and groups it has."""
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(8)
    X, Q = rng.standard_normal((1_200, 4)), rng.standard_normal((3_000, 4))
    payload = knn.prepare_queries("cosine", Q) | {"qids": np.arange(3_000), "d": 4}
    rows = pa.RecordBatch.from_pydict({"slab": np.arange(1_200) % 2, "id": np.arange(1_200), "embedding": pa.array(X.tolist())})
    out = list(knn._kernel(SimpleNamespace(value=payload), 100, "cosine", "id", "embedding", ("slab",))(iter([rows])))
    assert max(b.num_rows for b in out) <= 65_536
    assert sum(b.num_rows for b in out) == 2 * 3_000 * 100
    got = {(s, q): [] for s in range(2) for q in range(3_000)}
    for b in out:
        for s, q, i in zip(*(b.column(c).to_pylist() for c in ("slab", "qid", "id")), strict=True):
            got[s, q].append(i)
    want = brute(X, np.arange(1_200), Q[:20], 1_200, "cosine")
    for s in range(2):
        for q in range(20):
            assert got[s, q] == [i for i, _ in want[q] if i % 2 == s][:100]


def test_blocks_of_wide_vectors_hold_fewer_items(data, monkeypatch):
    """A block of items is bounded by the bytes of its vectors, not by rows alone."""
    X, ids, Q, items, queries = data
    want = _as_dict(knn.knn_join(items, queries, 5, "l2"))
    monkeypatch.setattr(knn, "ITEM_BLOCK_BYTES", 4 * 6 * 50)  # 50 items: eight blocks
    per_query = knn.meet_in_blocks(items, queries, 1, "l2", 6).groupBy("qid").count().collect()
    assert len(per_query) == 23 and {r["count"] for r in per_query} == {8}
    assert _as_dict(knn.knn_join(items, queries, 5, "l2", broadcast_limit_bytes=8 * 6 * 5)) == want


def test_passes_equal_blocks_and_copy_nothing(spark, monkeypatch):
    """Above COPY_BYTES both tables are stored once and queries go by passes: the same rows, copies, odd vectors and groups too."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    x[40:80] = x[40]
    rows = [(i, i % 3, [float(v) for v in x[i]]) for i in range(300)] + [(400, 0, None), (401, 1, [0.0] * 6), (402, 2, [1.0, 2.0])]
    items = spark.createDataFrame(rows, "id long, g long, embedding array<float>")
    queries = items.where("id % 4 = 0").select(F.col("id").alias("qid"), "embedding")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    for groups in ((), ("g",)):
        for metric in ("cosine", "l2"):
            run = lambda: knn.knn_join(items, queries, 5, metric, group_cols=groups, broadcast_limit_bytes=4_000)  # noqa: B023, E731
            monkeypatch.setattr(knn, "COPY_BYTES", 1 << 60, raising=False)
            want = rows_of(run())
            with monkeypatch.context() as m:
                m.setattr(knn, "COPY_BYTES", 0, raising=False)
                m.setattr(knn, "meet_in_blocks", lambda *a, **b: pytest.fail("copies for pairs of blocks"))
                assert rows_of(run()) == want
