import pytest
from pyspark.sql import functions as F

from nearfold.operators import ivf, knn, metrics
from nearfold.plans import studies as ST
from nearfold.plans.splits import splits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sp(spark):
    return splits(spark, SF)


def test_every_row_in_exactly_one_list(sp):
    idx = ST.pivot_index(sp)
    post = idx.postings
    assert post.count() == sp.n_base
    assert post.select("id").distinct().count() == sp.n_base
    assert ivf.list_sizes(idx).agg(F.sum("n_rows")).first()[0] == sp.n_base


def test_all_probes_equal_exact(sp):
    idx = ST.pivot_index(sp)
    got = ivf.search(idx, sp.queries, 10, idx.lists).select("qid", "rk", "id").orderBy("qid", "rk").collect()
    exp = ST.exact(sp).select("qid", "rk", "id").orderBy("qid", "rk").collect()
    assert got == exp


def test_recall_non_decreasing_in_probes_and_sweep_matches_single(sp):
    idx = ST.pivot_index(sp)
    probes = [1, 3, 6, idx.lists]
    rec = {r["probes"]: r["mean_recall"] for r in ST.probe_recall(idx, sp.queries, ST.exact(sp), probes).collect()}
    vals = [rec[p] for p in probes]
    assert vals == sorted(vals) and vals[-1] == 1.0
    single = metrics.mean_recall(ST.exact(sp), ivf.search(idx, sp.queries, 10, 3), 10).first()["mean_recall"]
    assert single == pytest.approx(rec[3])


def test_scan_equals_blocks_for_any_bound(sp, spark):
    """Map-only scan and block join give the same rows, also with groups and for a sweep."""
    idx = ST.pivot_index(sp)
    for probes in (1, 4, idx.lists + 3):
        one, two = (sorted(map(tuple, ivf.search(idx, sp.queries, 10, probes, limit=x).collect())) for x in (1 << 30, 0))
        assert one == two and one
    grouped = ivf.IvfIndex(idx.centroids, idx.postings.withColumn("slab", F.col("id") % 3), idx.lists, "cosine")
    one, two = (sorted(map(tuple, ivf.search(grouped, sp.queries, 5, 4, ["slab"], limit=x).collect())) for x in (1 << 30, 0))
    assert one == two
    one, two = (sorted(map(tuple, ivf.probe_sweep(idx, sp.queries, 10, (1, 3, 9), limit=x).collect())) for x in (1 << 30, 0))
    assert one == two
    odd = sp.queries.limit(2).unionByName(spark.createDataFrame([(900, [0.0] * 64), (901, None), (902, [1.0])], sp.queries.select("qid", "embedding").schema), allowMissingColumns=True)
    assert ivf.search(idx, odd, 3, 2).select("qid").distinct().count() == 2
    assert ivf.search(idx, sp.queries.limit(0), 3, 2).count() == 0
    plan = ivf.search(idx, sp.queries.limit(1), 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan and "CoGroup" not in plan


def test_trained_lists_write_partitioned(spark, sp, tmp_path):
    path = str(tmp_path / "postings")
    idx = ST.trained_index(sp, path=path)
    back = spark.read.parquet(path)
    assert back.count() == sp.n_base
    assert "list_id" in back.columns
    plan = back.where(F.col("list_id") == 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert idx.lists == ivf.lists_for(sp.n_base)


def test_lists_rule():
    assert ivf.lists_for(300) == 17 and ivf.lists_for(1200) == 35
    assert ivf.lists_grid(1200) == [17, 35, 70]


def test_small_blocks_match_whole_lists(sp, monkeypatch):
    idx = ST.pivot_index(sp)
    one = ivf.search(idx, sp.queries, 10, 4, limit=0).orderBy("qid", "rk").collect()
    monkeypatch.setattr(knn, "ITEM_BLOCK", 5)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    many = ivf.search(idx, sp.queries, 10, 4, limit=0).orderBy("qid", "rk").collect()
    assert one == many


def test_search_reads_stored_postings_and_assigns_nothing(sp):
    idx = ST.pivot_index(sp)
    for limit, scans, joins in ((1 << 30, 1, 0), (0, 0, 1)):  # one scan of the postings, or the block join; no second kernel
        found = ivf.search(idx, sp.queries, 10, 3, limit=limit)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert any(idx.path.split("/")[-1] in f for f in found.inputFiles())
        assert (plan.count("MapInArrow"), plan.count("CoGroupsInArrow")) == (scans, joins)


def test_clamped_probes_are_reported(sp):
    rows = ST.lists_probe_sweep(sp).collect()
    assert len(rows) == 12
    assert all(r["effective_probes"] == min(r["probes"], r["lists"]) for r in rows)


def test_chunked_centroids_assign_like_one_broadcast(sp):
    idx = ST.pivot_index(sp)
    items = sp.base.select("id", "embedding")
    one = sorted((r["id"], r["list_id"]) for r in ivf.assign(items, idx.centroids).collect())
    chunked = ivf.assign(items, idx.centroids, limit=8 * 64 * 3)  # 3 centroids per broadcast
    assert sorted((r["id"], r["list_id"]) for r in chunked.collect()) == one


def test_repeated_ids_keep_their_own_lists_over_several_broadcasts(spark):
    items = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, 0.0])], "id long, embedding array<float>")
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (5, [0.0, 2.0])], "list_id long, centroid array<float>")
    for limit in (1 << 20, 16):
        rows = sorted((r["id"], r["list_id"]) for r in ivf.assign(items, cents, limit=limit).where("id = 7").collect())
        assert rows == [(7, 0), (7, 1)]
        assert ivf.assign(items, cents, limit=limit).where("id = 8").first()["list_id"] is None


def test_returned_distances_equal_recomputed(sp):
    from nearfold.functions import vectors as V
    idx = ST.pivot_index(sp)
    items = sp.base.select("id", F.col("embedding").alias("x"))
    q = sp.queries.select("qid", F.col("embedding").alias("q"))
    for res in (knn.knn_join(sp.base, sp.queries, 10, "cosine"), ivf.search(idx, sp.queries, 10, 3)):
        chk = res.join(items, "id").join(q, "qid").select(
            F.abs(F.col("distance") - V.cosine_distance("q", "x")).alias("err"))
        assert chk.agg(F.max("err")).first()[0] < 1e-9


def test_probing_all_lists_needs_no_routes(spark, monkeypatch):
    """Every query probes every list: no table of queries x lists, whatever the limit."""
    sp = splits(spark, "/root/testdata/sf0.001")
    idx = ST.pivot_index(sp)
    want = sorted((r["qid"], r["rk"], r["id"]) for r in ST.exact(sp, 10).collect())
    for name in ("routed_topk", "probe_lists"):
        monkeypatch.setattr(ivf, name, lambda *a, **b: pytest.fail("routes"))
    for limit in (1 << 26, 4_000):
        got = ivf.search(idx, sp.queries, 10, idx.lists, limit=limit)
        assert sorted((r["qid"], r["rk"], r["id"]) for r in got.collect()) == want
