import duckdb
import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

FAST = ["sentences", "vec_l2", "vec_cosine", "knn_join_cosine", "knn_join_l1", "ground_truth_topk",
        "ivf_pivot_search", "recall_curve", "latency_summary", "workload_summary", "append_resume", "embed_pool"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["qid", "rk", "id", "distance"]


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", FAST)
def test_oracle_agrees_on_small_data(spark, key):
    sf = "/root/testdata/sf0.001"
    df = E.queries()[key](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    con = duck(sf)
    res = con.execute(E.oracle_sql()[key])
    err = compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert err is None, err
