"""Plan-level checks: the physical plans keep the properties the scale design relies on."""

from pyspark.sql import functions as F

from nearfold.operators import ivf, knn
from nearfold.plans import studies as ST
from nearfold.plans.splits import splits

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_knn_merge_limits_before_and_after_the_exchange_and_prunes_columns(spark):
    sp = splits(spark, SF)
    qids, Q = knn.collect_query_matrix(sp.queries, "qid", "embedding", 64)
    out = knn.merge_topk(knn.block_candidates(sp.base, qids, Q, 10, "cosine"), ["qid"], 10)
    p = plan(out)
    assert p.count("WindowGroupLimit") >= 2  # partial (map side) and final
    assert "ReadSchema: struct<id:bigint,embedding:array<float>>" in p  # only the needed columns are read
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_routed_search_prunes_unprobed_lists(spark, tmp_path):
    sp = splits(spark, SF)
    idx = ST.trained_index(sp, path=str(tmp_path / "postings"))
    p = plan(idx.postings.where(F.col("list_id").isin([0, 3])))
    assert "PartitionFilters: [list_id" in p.replace("PartitionFilters: [isnotnull(list_id", "PartitionFilters: [list_id")


def test_point_lookup_is_pushed_to_parquet(spark):
    sp = splits(spark, SF)
    p = plan(sp.tiers.where(F.col("id") == 0).select("tier", "id"))
    assert "EqualTo(id,0)" in p


def test_no_product_in_exact_or_routed_search(spark):
    sp = splits(spark, SF)
    idx = ST.pivot_index(sp)
    for df in (knn.knn_join(sp.base, sp.queries, 10, "l2"), ivf.search(idx, sp.queries, 10, 3)):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
