import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.operators import metrics


def test_exact_percentiles_match_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    vals = rng.gamma(2.0, 10.0, 3000).round(2)
    groups = np.where(np.arange(3000) < 1000, "hot", np.where(np.arange(3000) % 2 == 0, "a", "b"))
    rows = [(int(i), str(g), float(v)) for i, (g, v) in enumerate(zip(groups, vals))]
    df = spark.createDataFrame(rows, "event_id long, g string, v double")
    got = {r["g"]: r for r in metrics.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99},
                                                          "event_id").collect()}
    for g in ("hot", "a", "b"):
        x = vals[groups == g]
        for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
            assert got[g][name] == pytest.approx(np.percentile(x, p), rel=1e-12)


def test_recall_cuts_both_sides_to_k(spark):
    truth = spark.createDataFrame([(0, r, i) for r, i in enumerate([5, 6, 7, 8], 1)], "qid long, rk int, id long")
    res = spark.createDataFrame([(0, r, i) for r, i in enumerate([8, 5, 1, 6], 1)], "qid long, rk int, id long")
    r2 = metrics.recall_per_query(truth, res, 2).first()
    assert r2["recall"] == 0.5 and r2["n_truth"] == 2  # {5,6} vs {8,5}
    r4 = metrics.recall_per_query(truth, res, 4).first()
    assert r4["recall"] == 0.75
    curve = {r["k"]: r["mean_recall"] for r in metrics.recall_curve(truth, res, (1, 2, 4)).collect()}
    assert curve == {1: 0.0, 2: 0.5, 4: 0.75}


def test_query_without_results_counts_zero(spark):
    truth = spark.createDataFrame([(0, 1, 5), (1, 1, 6)], "qid long, rk int, id long")
    res = spark.createDataFrame([(0, 1, 5)], "qid long, rk int, id long")
    assert metrics.mean_recall(truth, res, 1).first()["mean_recall"] == 0.5


def test_warmup_operations_are_timed_again(spark):
    rows = [(i, i % 2, i) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, g long, ts long")
    runs = metrics.with_warmup(df, ["g"], ["ts", "event_id"], warmup=20)
    assert sorted(r.event_id for r in runs.where("phase = 'timed'").collect()) == list(range(50))
    assert sorted(r.event_id for r in runs.where("phase = 'warmup'").collect()) == list(range(40))


def test_sketches_merge_within_the_bound(spark):
    ops = spark.range(60_000).select(
        (F.col("id") % 2).alias("g"), F.floor(F.col("id") / 500).alias("minute"), F.when(F.col("id") % 97 != 0, F.pow(F.rand(3), F.lit(4.0)) * 900).alias("latency_ms"))
    ops = ops.union(spark.createDataFrame([(7, 0, 1.5), (8, 0, None)], ops.schema)).cache()
    parts = metrics.latency_sketches(ops, ["g", "minute"])
    ps = {"p50": 0.5, "p99": 0.99}
    days = metrics.merged_quantiles(parts, ["g"], ps)
    assert {r.g: r.n for r in days.collect()} == {r.g: r.n for r in ops.groupBy("g").agg(F.count("latency_ms").alias("n")).where("n > 0").collect()}
    errors = metrics.rank_errors(ops, days.drop("n"), ["g"], ps).collect()
    assert len(errors) == 3 and all(max(r.p50_rank_error, r.p99_rank_error) <= metrics.SKETCH_RANK_ERROR for r in errors)
    assert max(r.size for r in parts.select(F.octet_length("sketch").alias("size")).collect()) < 16 * metrics.SKETCH_K
    wrong = days.withColumn("p50", F.col("p99")).drop("n")
    assert metrics.rank_errors(ops, wrong, ["g"], ps).where("g < 7 AND p50_rank_error < 0.4").count() == 0


def test_empty_read_set_gives_zero_qps_and_null_percentiles(spark):
    import datetime as dt

    from nearfold.plans.catalog import workload_summary

    t0 = dt.datetime(2024, 1, 1, 0, 0, 5)
    rows = [(1, t0, "read_heavy", True, 5.0), (2, t0, "read_heavy", True, 7.0),
            (3, t0, "balanced", False, 3.0), (4, t0 + dt.timedelta(days=1), "read_heavy", False, 1.0)]
    ops = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, profile string, is_read boolean, latency_ms double")
    out = {(r["profile"], r["window_start"].day): r for r in workload_summary(ops).collect()}
    only_writes = out[("balanced", 1)]
    assert only_writes["read_qps"] == 0.0 and only_writes["p95_read_latency_ms"] is None
    assert only_writes["total_writes"] == 1
    reads = out[("read_heavy", 1)]
    assert reads["p95_read_latency_ms"] == pytest.approx(np.percentile([5.0, 7.0], 95))
