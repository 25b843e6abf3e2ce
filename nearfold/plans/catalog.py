"""The query catalog: every operator of the inventory as a (spark, sf_dir) job.

Each entry reads the driver tables (or tables Spark derives from them) and
returns a DataFrame whose column names match the oracle SQL in
``nearfold.plans.oracle``.  Distances and other computed doubles are rounded
to 6 digits on output; integer outputs are BIGINT.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions import text as TX
from nearfold.functions import vectors as V
from nearfold.operators import embed as EM
from nearfold.operators import graph as GR
from nearfold.operators import ground_truth as GT
from nearfold.operators import ivf, knn, metrics
from nearfold.operators import sampling as S
from nearfold.operators import tables as TB
from nearfold.operators.catalog import IndexCatalog
from nearfold.operators.indexing import dense_index
from nearfold.plans import studies as ST
from nearfold.plans.corpus import corpus, staged
from nearfold.plans.splits import INSERT_ID_OFFSET, splits
from nearfold.session import reliable_checkpoint, scratch_path, spread
from nearfold.sources import fixtures, textio, timelog
from nearfold.streaming import ingest as STR

Query = Callable[[SparkSession, str], DataFrame]
K = 10
# Fixed value: duration used by the "reads / fixed duration" throughput form
# (the fixture log covers 30 days).
LOG_DURATION_SEC = 30 * 86400
DAY_SEC = 86400


def _round(df: DataFrame, *cols: str) -> DataFrame:
    """Round to 6 digits; adding 0.0 turns a rounded -0.0 into 0.0."""
    for c in cols or ("distance",):
        df = df.withColumn(c, F.round(c, 6) + F.lit(0.0))
    return df


def _long(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


# ------------------------------------------------------------------ sentences


def q_sentences(spark, sf_dir):
    docs = fixtures.load(spark, sf_dir, "documents")
    return _long(S.sentences(docs), "pos", "n_chars")


def q_sentence_pool(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return _long(c.pool.select("pool_pos", "doc_id", "pos", "text"), "pos")


def q_insert_pool(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return _long(c.inserts.select("seq", "pool_pos", "doc_id", "pos", "text"), "pos")


def q_permutation(spark, sf_dir):
    return corpus(spark, sf_dir).ranks.select("pool_pos", "perm_rank")


def q_tier_slice(spark, sf_dir):
    return _long(corpus(spark, sf_dir).tiers(), "tier")


def q_query_slice(spark, sf_dir):
    return corpus(spark, sf_dir).queries()


def q_length_stats(spark, sf_dir):
    return _long(S.length_stats(corpus(spark, sf_dir).tiers()), "tier", "min_len", "max_len")


def q_row_preview(spark, sf_dir):
    """Point lookup ``id = 0`` in every sentence tier, text cut to 80 chars."""
    tiers = corpus(spark, sf_dir).tiers()
    return _long(
        tiers.where(F.col("id") == 0).select(
            "tier", "id", "pool_pos", TX.preview(F.col("text")).alias("preview"),
            F.length("text").alias("n_chars"),
        ),
        "tier",
        "n_chars",
    )


def q_vector_preview(spark, sf_dir):
    """Point lookup ``id = 0`` in every vector tier: dims + 60-char literal."""
    sp = splits(spark, sf_dir)
    t = sp.tiers.where(F.col("id") == 0)
    return _long(
        t.select(
            "tier", "id", "pool_pos", F.size("embedding").alias("dims"),
            TX.preview(V.to_vector_text("embedding"), TX.VECTOR_PREVIEW).alias("preview"),
        ),
        "tier",
        "dims",
    )


def q_split_disjoint(spark, sf_dir):
    """Pairwise shared rows of tiers/queries/inserts, sentence and vector side."""
    c = corpus(spark, sf_dir)
    sp = splits(spark, sf_dir)
    sent = S.disjointness(
        {
            "s_tier_max": c.ranks.where(F.col("perm_rank") < c.max_tier),
            "s_queries": c.queries(),
            "s_inserts": c.inserts,
        }
    )
    vec = S.disjointness({"v_base": sp.base, "v_queries": sp.queries, "v_inserts": sp.inserts})
    return sent.unionByName(vec)


def q_csv_roundtrip(spark, sf_dir):
    """Every tier, the queries and the inserts -> ``id,text`` CSV tables -> read back."""
    c = corpus(spark, sf_dir)
    parts = {f"tier_{t}": c.tiers().where(F.col("tier") == t) for t in c.tier_sizes}
    parts |= {"queries": c.queries().withColumnRenamed("qid", "id"), "inserts": c.inserts.withColumnRenamed("seq", "id")}
    out = None
    for name, rows in parts.items():
        path = scratch_path(spark, "csv", name)
        textio.write_text_table(rows, path)
        back = textio.read_text_table(spark, path).withColumn("part", F.lit(name))
        out = back if out is None else out.unionByName(back)
    return out.select("part", "id", "text", F.length("text").cast("long").alias("n_chars"))


# ------------------------------------------------------------------ vector functions


def _pairs(spark, sf_dir):
    """Every pool vector with its successor: an equi self-join on vec_id + 1."""
    e = fixtures.load(spark, sf_dir, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


def _pair_fn(fn, name):
    def run(spark, sf_dir):
        p = _pairs(spark, sf_dir)
        return _round(p.select("vec_id", "next_id", fn("a", "b").alias(name)), name)

    return run


def q_vec_norms(spark, sf_dir):
    e = fixtures.load(spark, sf_dir, "embeddings")
    return _round(e.select("vec_id", V.norm("embedding").alias("norm")), "norm")


def q_vec_normalize(spark, sf_dir):
    e = fixtures.load(spark, sf_dir, "embeddings")
    n = e.select("vec_id", V.normalize("embedding").alias("u"))
    return _round(
        n.select(
            "vec_id",
            F.size("u").cast("long").alias("dims"),
            V.norm("u").alias("unit_norm"),
            F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x).alias("component_sum"),
        ),
        "unit_norm",
        "component_sum",
    )


def q_tier_validate(spark, sf_dir):
    sp = splits(spark, sf_dir)
    return _long(metrics.tier_validation(sp.tiers), "tier")


def q_dim_quarantine(spark, sf_dir, dim: int = 64):
    """Rows per dimension and whether the fixed dimension rejects them (V9)."""
    e = fixtures.load(spark, sf_dir, "embeddings")
    d = F.size("embedding")
    return e.groupBy(d.cast("long").alias("dims")).agg(
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("quarantined", F.col("dims") != dim)


def q_vector_tsv_roundtrip(spark, sf_dir):
    """Base, insert and query vectors -> ``id \\t [..]`` text -> parsed back."""
    sp = splits(spark, sf_dir)
    out = None
    for name, rows in {"base": sp.base, "inserts": sp.inserts.withColumnRenamed("seq", "id"), "queries": sp.queries.withColumnRenamed("qid", "id")}.items():
        path = scratch_path(spark, "tsv", name)
        textio.write_vector_tsv(rows, path)
        back = textio.read_vector_tsv(spark, path).join(rows.select("id", F.col("embedding").alias("orig")), "id").withColumn("part", F.lit(name))
        out = back if out is None else out.unionByName(back)
    err = F.array_max(F.zip_with("embedding", "orig", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return out.select(
        "part", "id", "embedding_text", F.size("embedding").cast("long").alias("dims"),
        F.round(err, 5).alias("max_abs_err"),
    )


# ------------------------------------------------------------------ search


def _knn_join(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sp = splits(spark, sf_dir)
        out = knn.knn_join(sp.base, sp.queries, K, metric)
        return _long(_round(out), "rk")

    run.__name__ = f"knn_join_{metric}"
    return run


def _first_query(sp) -> list[float]:
    row = sp.queries.where(F.col("qid") == 0).select("embedding").first()
    return list(row["embedding"])


def q_knn_single_l2(spark, sf_dir, k: int = 5):
    """``ORDER BY embedding <-> q LIMIT 5`` for query 0 (K1)."""
    sp = splits(spark, sf_dir)
    return knn.knn_single(sp.base, _first_query(sp), k, "l2").select("id")


def q_knn_with_distance(spark, sf_dir, k: int = 3):
    """``SELECT id, embedding, embedding <-> q AS distance ... LIMIT 3`` (K2)."""
    sp = splits(spark, sf_dir)
    out = knn.knn_single(sp.base, _first_query(sp), k, "l2", with_vector=True)
    return _round(out.select("id", V.to_vector_text("embedding").alias("embedding_text"), "distance"))


# ------------------------------------------------------------------ operation-log metrics


def _reads(spark, sf_dir):
    return fixtures.operation_log(spark, sf_dir).where("is_read")


def q_latency_summary(spark, sf_dir):
    """Per profile, all reads, timed after a warm-up run of the first 20 of them: n, mean, p95, p99."""
    runs = metrics.with_warmup(_reads(spark, sf_dir), ["profile"], ["ts", "event_id"])
    out = metrics.latency_summary(runs.where("phase = 'timed'"), ["profile"])
    warm = runs.where("phase = 'warmup'").groupBy("profile").agg(F.count(F.lit(1)).alias("n_warmup"))
    return _round(out.join(warm, "profile", "left"), "mean_latency_ms", "p95_latency_ms", "p99_latency_ms")


#: Quantiles kept by the latency sketches.
SKETCH_PS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def q_latency_sketch(spark, sf_dir):
    """Read latencies as one sketch per (profile, minute), stored, merged into days; are ranks within the bound?"""
    reads = _reads(spark, sf_dir).withColumn("minute", F.date_trunc("minute", "ts")).withColumn("window_start", F.date_trunc("day", "ts"))
    g = ["profile", "window_start"]
    path = scratch_path(spark, "latency_sketches")
    metrics.latency_sketches(reads, [*g, "minute"]).write.parquet(path)
    days = metrics.merged_quantiles(spark.read.parquet(path), g, SKETCH_PS)
    out = metrics.rank_errors(reads, days.drop("n"), g, SKETCH_PS)
    return out.select(*g, F.col("n").alias("n_reads"),
                      *[(F.col(f"{c}_rank_error") <= metrics.SKETCH_RANK_ERROR).alias(f"{c}_within") for c in SKETCH_PS])


def q_throughput(spark, sf_dir):
    """The three QPS forms per profile (E4): wall span, sum of latencies, fixed duration."""
    r = _reads(spark, sf_dir)
    span = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / F.lit(1e6)
    out = r.groupBy("profile").agg(
        F.count(F.lit(1)).alias("n_reads"),
        (F.count(F.lit(1)) / span).alias("qps_wall"),
        (F.count(F.lit(1)) / (F.sum("latency_ms") / 1000.0)).alias("qps_latency_sum"),
        (F.count(F.lit(1)) / F.lit(float(LOG_DURATION_SEC))).alias("qps_fixed_duration"),
    )
    return _round(out, "qps_wall", "qps_latency_sum", "qps_fixed_duration")


def workload_summary(ops: DataFrame, window: str = "1 day", window_sec: int = DAY_SEC) -> DataFrame:
    """Per (profile, window): read QPS, mean/p95/p99 read latency, writes/s, total writes."""
    w = ops.withColumn("window_start", F.window("ts", window).start)
    g = ["profile", "window_start"]
    counts = w.groupBy(*g).agg(
        F.count_if("is_read").alias("n_reads"),
        F.count_if(~F.col("is_read")).alias("total_writes"),
        F.avg(F.when(F.col("is_read"), F.col("latency_ms"))).alias("mean_read_latency_ms"),
    )
    pct = metrics.exact_percentiles(
        w.where("is_read"), g, "latency_ms",
        {"p95_read_latency_ms": 0.95, "p99_read_latency_ms": 0.99}, "event_id",
    )
    out = counts.join(pct, g, "left").select(
        *g,
        "n_reads",
        (F.col("n_reads") / F.lit(float(window_sec))).alias("read_qps"),
        "mean_read_latency_ms",
        "p95_read_latency_ms",
        "p99_read_latency_ms",
        (F.col("total_writes") / F.lit(float(window_sec))).alias("write_throughput_per_sec"),
        "total_writes",
    )
    return _round(out, "read_qps", "mean_read_latency_ms", "p95_read_latency_ms", "p99_read_latency_ms",
                  "write_throughput_per_sec")


def q_workload_summary(spark, sf_dir):
    return workload_summary(fixtures.operation_log(spark, sf_dir))


def q_metrics_log(spark, sf_dir):
    """Append the workload summary to a parquet log in two appends, read it back."""
    summary = q_workload_summary(spark, sf_dir).withColumn(
        "read_ratio", F.element_at(F.create_map(*[x for p, r in fixtures.READ_RATIOS.items()
                                                  for x in (F.lit(p), F.lit(r))]), F.col("profile"))
    ).select(
        F.lit("events").alias("table"),
        F.lit("log").alias("index_type"),
        "profile",
        "read_ratio",
        (F.lit(1.0) - F.col("read_ratio")).alias("write_ratio"),
        F.lit(DAY_SEC).alias("duration_sec"),
        F.lit(1).alias("n_workers"),
        "read_qps",
        "mean_read_latency_ms",
        "p95_read_latency_ms",
        "p99_read_latency_ms",
        "write_throughput_per_sec",
        "total_writes",
        "window_start",
    )
    path = scratch_path(spark, "workload_log")
    first = summary.where(F.col("profile") == "read_heavy")
    textio.append_log(first, path, textio.WORKLOAD_LOG)
    textio.append_log(summary.where(F.col("profile") != "read_heavy"), path, textio.WORKLOAD_LOG)
    back = textio.read_log(spark, path)
    return back.select("profile", "window_start", "read_qps", "mean_read_latency_ms", "p95_read_latency_ms",
                       "p99_read_latency_ms", "write_throughput_per_sec", "total_writes")


# ------------------------------------------------------------------ ground truth

# Probes used by the pivot-list search checks and the growth study.
PIVOT_PROBES = 20
DEGRADATION_PROBES = 20
SCALING_PROBES = 20


def q_ground_truth_topk(spark, sf_dir):
    """Exact cosine top-100 per (tier, query) in one scan, written per tier and read back."""
    sp = splits(spark, sf_dir)
    gt = GT.tier_ground_truth(ST.perm_base(sp).select("pool_pos", "perm_rank", "embedding"), sp.tiers,
                              sp.tier_sizes, sp.queries, GT.DEPTH)
    path = scratch_path(spark, "ground_truth")
    gt.write.partitionBy("tier").parquet(path)
    return _long(_round(spark.read.parquet(path)), "tier")


def _growing(sp):
    return GT.growing_ground_truth(sp.base, sp.inserts, sp.queries, sp.checkpoints, sp.n_base, INSERT_ID_OFFSET, K)


def q_growing_ground_truth(spark, sf_dir):
    """Top-10 over base ∪ first c inserts for every checkpoint c."""
    return _round(_growing(splits(spark, sf_dir)))


def q_growing_truth_incremental(spark, sf_dir):
    """The same truth kept as the table grows: after the first two checkpoints, then after all; only new slabs are scanned (K5)."""
    sp = splits(spark, sf_dir)
    path = scratch_path(spark, "growing_truth")
    for cps in (sp.checkpoints[:2], sp.checkpoints):
        out = GT.growing_ground_truth(sp.base, sp.inserts, sp.queries, cps, sp.n_base, INSERT_ID_OFFSET, K, path=path)
    return _round(out)


def q_gt_validate(spark, sf_dir):
    """Validity checks of the growing ground truth (K7)."""
    sp = splits(spark, sf_dir)
    gt = _growing(sp)
    cps = F.array(*[F.lit(int(c)).cast("long") for c in [0, *sp.checkpoints]])
    grown = ST.grown_items(sp, max(sp.checkpoints)).select("id", "seq").withColumn(
        "cumulative_inserts", F.explode(cps)
    ).where(F.col("seq").isNull() | (F.col("seq") < F.col("cumulative_inserts"))).select("cumulative_inserts", "id")
    return GT.validate_ground_truth(gt, grown, INSERT_ID_OFFSET)


# ------------------------------------------------------------------ inverted lists


def q_ivf_pivot_postings(spark, sf_dir):
    """Pivot centroids (first round(sqrt(n)) rows by rank) and the assignment of every base row (K9)."""
    sp = splits(spark, sf_dir)
    idx = ST.pivot_index(sp)
    assigned = ivf.assign(sp.base.select("id", "embedding"), idx.centroids)
    return _round(assigned.select("id", "list_id", "centroid_distance"), "centroid_distance")


def q_ivf_postings(spark, sf_dir):
    """Trained (spherical k-means) lists written partitioned by list_id; list sizes (K9)."""
    sp = splits(spark, sf_dir)
    idx = ST.trained_index(sp, path=scratch_path(spark, "postings"))
    return ivf.list_sizes(idx)


def q_ivf_trained_nearest(spark, sf_dir):
    """Every base row lies in the nearest list of its node, at the stored distance (K9)."""
    sp = splits(spark, sf_dir)
    items = sp.base.select("id", "embedding")
    cents = reliable_checkpoint(ivf.train_centroids(sp.base, ivf.lists_for(sp.n_base)))
    held = ivf.assign(items, cents)
    node = cents.select("list_id", "node")
    # the other lists of the same node, by join on the node
    near = held.join(node, "list_id").join(cents.select("node", "centroid"), "node")
    near = near.groupBy("id").agg(F.min(V.cosine_distance("embedding", "centroid")).alias("least"), F.first("centroid_distance").alias("stored"))
    out = near.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("least") - F.col("stored")) > 1e-6).alias("n_not_nearest"))
    lists = cents.agg(F.count(F.lit(1)).alias("n_lists"), F.count_distinct("list_id").alias("n_distinct"))
    one = F.lit(1).alias("_one")
    return out.select("*", one).join(lists.select("*", one), "_one").drop("_one")


def _serving_index(sp):
    return ST.pivot_index(sp, ivf.serving_lists(sp.n_base))


def q_ivf_pivot_search(spark, sf_dir):
    """Top-10 through the 20 nearest pivot lists."""
    sp = splits(spark, sf_dir)
    return _long(_round(ivf.search(_serving_index(sp), sp.queries, K, PIVOT_PROBES)), "rk")


def q_ivf_pivot_recall(spark, sf_dir):
    """Mean recall@10 of that search; at least 0.9 is asked of it."""
    sp = splits(spark, sf_dir)
    idx = _serving_index(sp)
    out = metrics.mean_recall(ST.exact(sp), ivf.search(idx, sp.queries, K, PIVOT_PROBES), K)
    return _round(out.withColumns({"lists": F.lit(idx.lists).cast("long"), "recall_ok": F.col("mean_recall") >= 0.9}), "mean_recall")


def q_ivf_search(spark, sf_dir):
    """Trained lists probed exhaustively: must equal the exact kNN."""
    sp = splits(spark, sf_dir)
    idx = ST.trained_index(sp)
    return _long(_round(ivf.search(idx, sp.queries, K, idx.lists)), "rk")


def q_ivf_recall(spark, sf_dir):
    """Recall@10 of trained lists for every probe value, one scan."""
    sp = splits(spark, sf_dir)
    idx = ST.trained_index(sp)
    out = ST.clamped_recall(idx, sp.queries, ST.exact(sp), (*ST.PROBES, idx.lists))
    return _round(out, "mean_recall")


def q_ivf_probe_sweep(spark, sf_dir):
    """lists (L/2, L, 2L) x probes grid on pivot lists: mean recall@10."""
    sp = splits(spark, sf_dir)
    return _round(ST.lists_probe_sweep(sp), "mean_recall")


def q_recall_at_k(spark, sf_dir):
    """Per-query recall@10 of the pivot-list search against the exact top-10."""
    sp = splits(spark, sf_dir)
    res = ivf.search(_serving_index(sp), sp.queries, K, PIVOT_PROBES)
    out = metrics.recall_per_query(ST.exact(sp), res, K)
    return _round(out, "recall")


def q_recall_curve(spark, sf_dir):
    """Mean recall at k = 1, 10, 50, 100 of a depth-100 pivot-list search."""
    sp = splits(spark, sf_dir)
    res = ivf.search(_serving_index(sp), sp.queries, GT.DEPTH, PIVOT_PROBES)
    out = metrics.recall_curve(ST.exact(sp, GT.DEPTH), res)
    return _long(_round(out, "mean_recall"), "k")


def q_sweep_grid(spark, sf_dir):
    """Parameter cells of both index families for this table."""
    return ST.sweep_cells(splits(spark, sf_dir).base)


def q_degradation_curve_pivot(spark, sf_dir):
    """Frozen pivot lists while the table grows 10/20/30/50 %, then rebuilt."""
    return ST.degradation_curve(splits(spark, sf_dir), DEGRADATION_PROBES)


def q_degradation_curve(spark, sf_dir):
    """Same study with trained (k-means) lists."""
    return ST.degradation_curve(splits(spark, sf_dir), DEGRADATION_PROBES, trained=True)


def q_rebuild_delta(spark, sf_dir):
    """Recall before/after rebuilding at the last checkpoint."""
    return ST.rebuild_delta(ST.degradation_curve(splits(spark, sf_dir), DEGRADATION_PROBES, trained=True))


def q_rebuild_delta_pivot(spark, sf_dir):
    """Recall before/after rebuilding at the last checkpoint, pivot lists."""
    return ST.rebuild_delta(ST.degradation_curve(splits(spark, sf_dir), DEGRADATION_PROBES))


def q_metrics_scrub(spark, sf_dir):
    """Maintenance log: append the pivot degradation rows, drop the checkpoint-0
    no_rebuild row into a new snapshot (S9, S10)."""
    curve = q_degradation_curve_pivot(spark, sf_dir)
    path = scratch_path(spark, "maintenance_log")
    textio.append_log(curve, path, textio.MAINTENANCE_LOG)
    drop = (F.col("checkpoint_pct") == 0) & (F.col("phase") == "no_rebuild")
    out = textio.scrub_log(spark, path, drop, scratch_path(spark, "maintenance_log_scrubbed"))
    return _long(out.select("index_type", "checkpoint_pct", "cumulative_inserts", "total_rows", "phase",
                            "mean_recall"), "checkpoint_pct")


def q_scaling_recall(spark, sf_dir):
    """Per tier: pivot lists by the sqrt rule, probes 20, recall@10 vs the tier's exact top-10."""
    sp = splits(spark, sf_dir)
    out = None
    for t in sp.tier_sizes:
        items = sp.tier(t)
        ranked = items.join(sp.perm.select("pool_pos", "perm_rank"), "pool_pos")
        lists = ivf.lists_for(t)
        idx = ivf.build(items.select("id", "embedding"), ivf.pivot_centroids(ranked, lists), lists)
        res = ivf.search(idx, sp.queries, K, min(SCALING_PROBES, lists))
        truth = knn.knn_join(items, sp.queries, K, "cosine")
        r = metrics.mean_recall(truth, res, K).select(
            F.lit(t).cast("long").alias("tier"), F.lit("ivf_pivot").alias("index_type"),
            F.lit(lists).cast("long").alias("lists"), F.lit(min(SCALING_PROBES, lists)).cast("long").alias("probes"),
            "mean_recall", "n_queries")
        out = r if out is None else out.unionByName(r)
    return _round(out, "mean_recall")


# ------------------------------------------------------------------ table operations


def _items_table(spark, sp, name):
    path = scratch_path(spark, name)
    TB.create_or_replace(sp.base.select("id", "pool_pos", "embedding"), path)
    return path


def _ins(sp, start, end):
    return TB.offset_range(sp.inserts, start, end, INSERT_ID_OFFSET).select("id", "pool_pos", "embedding")


def q_load_tier(spark, sf_dir):
    """Load every tier into one items table partitioned by tier and check the counts."""
    sp = splits(spark, sf_dir)
    out = TB.load_checked(sp.tiers.select("tier", "id", "pool_pos", "embedding"), scratch_path(spark, "items"),
                          {t: t for t in sp.tier_sizes}, group_col="tier")
    return out.select("tier", "n_rows", "n_expected", "count_ok")


def q_pk_violations(spark, sf_dir):
    """A load retried without the anti join duplicates keys; the check finds them (D3)."""
    sp = splits(spark, sf_dir)
    path = _items_table(spark, sp, "pk")
    for lo, hi in zip([0, *sp.checkpoints], sp.checkpoints):
        TB.append(_ins(sp, lo, hi), path)
    TB.append(_ins(sp, 0, sp.checkpoints[-2]), path)  # the retry of all ranges but the last
    return TB.pk_violations(spark.read.parquet(path))


def q_append_range(spark, sf_dir):
    """Ranged appends of the insert pool with id offset, one for each checkpoint."""
    sp = splits(spark, sf_dir)
    path = _items_table(spark, sp, "append")
    for lo, hi in zip([0, *sp.checkpoints], sp.checkpoints):
        TB.append(_ins(sp, lo, hi), path)
    return spark.read.parquet(path).select("id", "pool_pos")


def q_append_checked(spark, sf_dir):
    """A faulty load of the insert pool: rows that the dimension or the key rejects, by reason (V9, D3).

    Derived faults by ``seq % 10``: 0 cut vectors, 1 no vector, 2 sent twice, 3 an id of the base table."""
    sp = splits(spark, sf_dir)
    path = _items_table(spark, sp, "checked")
    kind = F.pmod("seq", F.lit(10))
    rows = sp.inserts.select(
        F.when(kind == 3, F.col("seq")).otherwise(F.lit(INSERT_ID_OFFSET) + F.col("seq")).alias("id"), "pool_pos",
        F.when(kind == 0, F.slice("embedding", 1, 32)).when(kind != 1, F.col("embedding")).alias("embedding"), kind.alias("kind"))
    rows = rows.unionByName(rows.where("kind = 2")).drop("kind")
    rejected = TB.append_checked(spark, rows, path, scratch_path(spark, "rejected"), EM.DIM)
    loaded = spark.read.parquet(path).select(F.lit("loaded").alias("outcome"))
    out = loaded.unionByName(rejected.select(F.col("reason").alias("outcome")))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"))


def q_append_resume(spark, sf_dir):
    """An interrupted append resumed by anti join: every key exactly once."""
    sp = splits(spark, sf_dir)
    path = _items_table(spark, sp, "resume")
    last = sp.checkpoints[-1]
    TB.append(_ins(sp, 0, sp.checkpoints[0]), path)  # the run that stopped early
    TB.append_missing(spark, _ins(sp, 0, last), path)
    TB.append_missing(spark, _ins(sp, 0, last), path)  # resuming twice adds nothing
    back = spark.read.parquet(path)
    return back.groupBy("id").agg(F.count(F.lit(1)).alias("n_copies"))


def q_delete_range(spark, sf_dir):
    """``DELETE WHERE id >= offset`` after growth, as deletion vectors: back to the base rows."""
    sp = splits(spark, sf_dir)
    path = _items_table(spark, sp, "delete")
    TB.append(_ins(sp, 0, max(sp.checkpoints)), path)
    TB.delete_rows(spark, path, F.col("id") >= INSERT_ID_OFFSET)
    return TB.read_live(spark, path).select("id", "pool_pos")


def q_delete_steps(spark, sf_dir):
    """Two overlapping deletes, an append after them and a compaction: live rows, deleted rows and rows in the files."""
    sp = splits(spark, sf_dir)
    path = _items_table(spark, sp, "delete_steps")
    live = lambda p: TB.read_live(spark, p).count()
    stored = lambda p: spark.read.parquet(p).count()
    steps = [("loaded", 0, live(path), stored(path))]
    for name, cond in (("every third", F.col("id") % 3 == 0), ("every second", F.col("id") % 2 == 0)):
        steps.append((name, TB.delete_rows(spark, path, cond), live(path), stored(path)))
    TB.append(_ins(sp, 0, sp.n_ins), path)
    steps.append(("appended", 0, live(path), stored(path)))
    packed = scratch_path(spark, "delete_compacted")
    TB.compact(spark, path, packed)
    steps.append(("compacted", 0, live(packed), stored(packed)))
    return spark.createDataFrame(steps, "step string, n_deleted long, n_live long, n_stored long")


def q_index_versions(spark, sf_dir):
    """The index catalog through builds, a replacement, a failed build and a drop: each version's list."""
    sp = splits(spark, sf_dir)
    cat = IndexCatalog(spark, scratch_path(spark, "index_catalog"))
    base = ST.perm_base(sp)
    n_lists = ivf.lists_for(sp.n_base)

    def pivot(lists, rows=sp.base):
        def write(path):
            idx = ivf.build(rows.select("id", "embedding"), ivf.pivot_centroids(base, lists), lists, path=path, kind="pivot")
            return idx.postings.count()

        return write

    cat.build("items", "ivf_pivot", {"lists": n_lists}, pivot(n_lists), sp.n_base)
    cat.build("items", "ivf_pivot", {"lists": 2 * n_lists}, pivot(2 * n_lists), sp.n_base)
    try:
        cat.build("items", "ivf_pivot", {"lists": 1}, pivot(1, sp.base.where("id % 2 = 0")), sp.n_base)
    except AssertionError:
        pass  # half of the rows: the index of 2 x lists stays active
    cat.drop("items")
    cat.build("items", "ivf_pivot", {"lists": n_lists}, pivot(n_lists), sp.n_base)
    return cat.history().select(F.col("version").cast("long").alias("version"), "table", "index_type",
                                F.col("params")["lists"].cast("long").alias("lists"), "n_rows", "status", "since", "until")


def q_table_state(spark, sf_dir):
    """count(*) and count of inserted rows after every append step."""
    sp = splits(spark, sf_dir)
    path = scratch_path(spark, "state")
    TB.create_or_replace(sp.base.select("id", "pool_pos").withColumn("slab", F.lit(0)), path)
    prev = 0
    for i, c in enumerate(sp.checkpoints):
        TB.append(_ins(sp, prev, c).select("id", "pool_pos").withColumn("slab", F.lit(i + 1)), path)
        prev = c
    cps = F.array(*[F.lit(x) for x in range(len(sp.checkpoints) + 1)])
    t = spark.read.parquet(path).withColumn("step", F.explode(F.filter(cps, lambda s: s >= F.col("slab"))))
    cp_map = F.array(*[F.lit(int(c)).cast("long") for c in [0, *sp.checkpoints]])
    st = TB.state(t, INSERT_ID_OFFSET, group_cols=["step"])
    return st.select(F.element_at(cp_map, (F.col("step") + 1).cast("int")).alias("cumulative_inserts"),
                     "n_rows", "n_inserted")


def q_compact_postings(spark, sf_dir):
    """Postings written by many small writers, then compacted: rows per list unchanged."""
    sp = splits(spark, sf_dir)
    idx = ST.pivot_index(sp)
    path = scratch_path(spark, "fragmented")
    idx.postings.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).write.mode(
        "overwrite").partitionBy("list_id").parquet(path)
    out = TB.compact(spark, path, scratch_path(spark, "compacted"), "list_id")
    return out.groupBy("list_id").agg(F.count(F.lit(1)).alias("n_rows"))


def q_index_manifest(spark, sf_dir):
    """Indexes of the base table with params, rows, lists and bytes on disk."""
    sp = splits(spark, sf_dir)
    manifest = None
    for kind in ("pivot", "trained"):
        path = scratch_path(spark, f"index_{kind}")
        lists = ivf.lists_for(sp.n_base)
        t0 = time.perf_counter()
        if kind == "pivot":
            cents = ivf.pivot_centroids(ST.perm_base(sp), lists)
        else:
            cents = ivf.train_centroids(sp.base, lists)
        idx = ivf.build(sp.base.select("id", "embedding"), cents, lists, path=path, kind=kind)
        build_sec = time.perf_counter() - t0
        row = idx.postings.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("list_id").alias("n_lists")).select(
            F.lit("items_base").alias("table"), F.lit(f"ivf_{kind}").alias("index_type"),
            F.create_map(F.lit("lists"), F.lit(lists)).alias("params"), "rows", "n_lists",
            F.lit(round(build_sec, 3)).alias("build_time_sec"),
            F.lit(TB.size_bytes(spark, path)).cast("long").alias("size_bytes"))
        manifest = row if manifest is None else manifest.unionByName(row)
    # the graph family: edge table written next to the lists
    path = scratch_path(spark, "index_graph")
    t0 = time.perf_counter()
    g = _graph(sp)
    g.edges.write.mode("overwrite").parquet(path)
    build_sec = time.perf_counter() - t0
    row = g.edges.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("src").alias("n_lists")).select(
        F.lit("items_base").alias("table"), F.lit("graph").alias("index_type"),
        F.create_map(F.lit("m"), F.lit(GRAPH_M), F.lit("ef_construction"), F.lit(GRAPH_EF_CONSTRUCTION)).alias("params"),
        "rows", F.lit(None).cast("long").alias("n_lists"),
        F.lit(round(build_sec, 3)).alias("build_time_sec"),
        F.lit(TB.size_bytes(spark, path)).cast("long").alias("size_bytes"))
    manifest = manifest.unionByName(row)
    # the build log (S9): appended, then read back
    log = scratch_path(spark, "build_log")
    textio.append_log(manifest.withColumn("params", F.to_json("params")), log, textio.BUILD_LOG)
    back = textio.read_log(spark, log)
    return back.withColumn("params", F.from_json("params", "map<string,int>"))


# ------------------------------------------------------------------ streaming

def q_stream_ingest(spark, sf_dir):
    """Insert pool arriving as a log -> ids + frozen pivot lists -> list-partitioned sink (ST1)."""
    sp = splits(spark, sf_dir)
    d = STR.scratch(spark, "ingest")
    timelog.write_log(sp.inserts.select("seq", "embedding"), d["log"], "seq")
    cents = ivf.pivot_centroids(ST.perm_base(sp), ivf.lists_for(sp.n_base))
    STR.ingest(spark, d["log"], cents, d["out"], d["checkpoint"], INSERT_ID_OFFSET, sp.n_ins)
    out = spark.read.parquet(d["out"])
    return _round(out.select("id", "list_id", "centroid_distance"), "centroid_distance")


# Fixed value: id offset of rows written by the mixed workload.
WORKLOAD_ID_OFFSET = 900_000_000


def q_stream_cyclic_ingest(spark, sf_dir):
    """Every write of the operation log, in time order, inserts insert-pool vector
    ``counter mod pool`` with id offset + counter, through the stream (ST1, §1.4-13)."""
    sp = splits(spark, sf_dir)
    d = STR.scratch(spark, "cyclic")
    writes = fixtures.operation_log(spark, sf_dir).where(~F.col("is_read")).select("event_id", "ts")
    counters = dense_index(writes, ["ts", "event_id"], "counter").select("counter", "event_id")
    timelog.write_log(counters, d["log"], "counter")
    cents = ivf.pivot_centroids(ST.perm_base(sp), ivf.lists_for(sp.n_base))
    STR.cyclic_ingest(spark, d["log"], sp.inserts.select("seq", "embedding"), cents, d["out"], d["checkpoint"],
                      WORKLOAD_ID_OFFSET)
    out = spark.read.parquet(d["out"])
    return _round(out.select("id", "vec_ix", "list_id", "centroid_distance"), "centroid_distance")


def _stream_lookup(spark, sf_dir):
    sp = splits(spark, sf_dir)
    d = STR.scratch(spark, "lookup")
    idx_path = scratch_path(spark, "lookup_index")
    lists = ivf.serving_lists(sp.n_base)
    cents = ivf.pivot_centroids(ST.perm_base(sp), lists)
    ivf.build(sp.base.select("id", "embedding"), cents, lists, path=idx_path)
    timelog.write_log(sp.queries.select("qid", "embedding"), d["log"], "qid")
    STR.lookups(spark, d["log"], idx_path, cents, lists, d["out"], d["checkpoint"], K, PIVOT_PROBES)
    return sp, spark.read.parquet(d["out"]).select("qid", "rk", "id", "distance")


def q_stream_lookup(spark, sf_dir):
    """Queries arriving while the index serves: foreachBatch pivot-list search (ST2)."""
    return _long(_round(_stream_lookup(spark, sf_dir)[1]), "rk")


def q_stream_lookup_recall(spark, sf_dir):
    """Mean recall@10 of the streamed lookups; at least 0.9 is asked of them (ST2, E1)."""
    sp, found = _stream_lookup(spark, sf_dir)
    out = metrics.mean_recall(ST.exact(sp), found, K)
    return _round(out.withColumn("recall_ok", F.col("mean_recall") >= 0.9), "mean_recall")


def q_stream_workload_windows(spark, sf_dir):
    """Operation log as a stream: 1-minute watermark, 60 s windows per profile, all events (ST3)."""
    d = STR.scratch(spark, "windows")
    ops = fixtures.operation_log(spark, sf_dir).select(STR.to_micros("ts").alias("t"), "profile", "is_read", "latency_ms")
    timelog.write_log(ops, d["log"])
    out = STR.windows(spark, d["log"], d["out"], d["checkpoint"])
    return _round(out, "mean_read_latency_ms", "p95_read_latency_ms", "p99_read_latency_ms", "max_latency_ms", "read_qps",
                  "write_throughput_per_sec")


# ------------------------------------------------------------------ embedding stage


def _largest_tier_texts(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.tiers().where(F.col("tier") == c.max_tier).select("id", "text")


def _embedding_summary(df):
    return _round(df.select("id", *EM.embedding_checksum("embedding")), "norm", "checksum")


def q_embed_pool(spark, sf_dir):
    """Largest sentence tier -> 64-d hashed bag-of-words vectors, JVM-side."""
    t = spread(_largest_tier_texts(spark, sf_dir))
    return _embedding_summary(t.select("id", EM.hashed_embedding("text").alias("embedding")))


def q_embed_pool_batched(spark, sf_dir):
    """Same stage through the pluggable encoder in Arrow batches of 256."""
    t = _largest_tier_texts(spark, sf_dir)
    return _embedding_summary(EM.embed_batches(t, "text", EM.numpy_hashed_encoder(), EM.DIM))


def q_embedding_rate(spark, sf_dir):
    """All sentences embedded and written once; rows, batches and rate as the write observed them."""
    texts = corpus(spark, sf_dir).numbered.select(F.col("pool_pos").alias("id"), "text")
    path = scratch_path(spark, "embedding_rate")
    got = EM.embed_and_measure(texts, "text", EM.numpy_hashed_encoder(), EM.DIM, path)
    stored = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_stored"))
    return stored.select(F.lit(got["rows"]).alias("n_observed"), "n_stored",
                         F.lit(got["rows"] <= got["batches"] * EM.BATCH_SIZE).alias("batches_cover"),
                         F.lit(got["rows_per_sec"] > 0).alias("rate_positive"))


def q_stage_cache(spark, sf_dir):
    """Every corpus stage asked for three times: rows read, and how often it was built."""
    c = corpus(spark, sf_dir)
    parts = {"numbered": lambda: c.numbered, "pool": lambda: c.perm, "tiers": lambda: c.tiers(), "inserts": lambda: c.inserts}
    out = []
    for name, source in parts.items():
        path, built = scratch_path(spark, "stage_cache", name), []

        def build():
            built.append(1)
            return source()

        counts = {staged(spark, path, build).count() for _ in range(3)}
        out.append((name, counts.pop(), len(built), not counts))
    return spark.createDataFrame(out, "stage string, n_rows long, n_builds long, same_rows boolean")


def q_text_items(spark, sf_dir):
    """Vectors of every sentence tier, the queries and the inserts, from one stored embedding pass."""
    c = corpus(spark, sf_dir)
    rows = c.parts().join(c.vectors, "pool_pos")
    return _round(rows.select("part", "id", "pool_pos", *EM.embedding_checksum("embedding")), "norm", "checksum")


def _text_queries(c):
    return c.query_ids().join(c.vectors, "pool_pos").select("qid", "embedding")


def q_text_ground_truth(spark, sf_dir):
    """Exact cosine top-10 of the held-out sentences in every sentence tier (K4, S6): written once, read back."""
    c = corpus(spark, sf_dir)
    base = c.ranks.where(F.col("perm_rank") < c.max_tier).select("pool_pos", "perm_rank").join(c.vectors, "pool_pos")
    path = scratch_path(spark, "text_ground_truth")
    GT.tier_ground_truth(base, c.tier_ids(), c.tier_sizes, _text_queries(c), K).write.partitionBy("tier").parquet(path)
    return _long(_round(spark.read.parquet(path)), "tier")


def q_text_knn(spark, sf_dir):
    """Top-10 of the held-out sentences through the lists of the largest sentence tier, all probed."""
    c = corpus(spark, sf_dir)
    items = c.tier_ids().where(F.col("tier") == c.max_tier).select("id", "pool_pos").join(c.vectors, "pool_pos")
    lists = ivf.lists_for(c.max_tier)
    cents = ivf.pivot_centroids(items.join(c.ranks.select("pool_pos", "perm_rank"), "pool_pos"), lists)
    idx = ivf.build(items.select("id", "embedding"), cents, lists)
    return _long(_round(ivf.search(idx, _text_queries(c), K, lists)), "rk")


# ------------------------------------------------------------------ neighbour graph

# The cell of the scaling and degradation studies, its default beam, and the recall it must reach.
GRAPH_M = 32
GRAPH_EF_CONSTRUCTION = 128
GRAPH_EF_SEARCH = 40
GRAPH_RECALL = 0.98


def _graph(sp, m=GRAPH_M, efc=GRAPH_EF_CONSTRUCTION, metric="cosine"):
    return GR.laid_out(_graph_cells(sp, [(m, efc)], metric).one(0))


def _graph_cells(sp, cells, metric="cosine"):
    lists = ivf.lists_for(sp.n_base)
    pb = ST.perm_base(sp)
    cents = ivf.pivot_centroids(pb, lists)
    assigned = ivf.assign(sp.base.select("id", "embedding"), cents, metric).select("id", "list_id")
    entry = pb.where(F.col("perm_rank") < lists).select("id")
    return GR.build_cells(sp.base.select("id", "embedding"), assigned, cells, entry, metric=metric)


def q_graph_degradation_curve(spark, sf_dir):
    """Graph grown by batched inserts to +10/20/30/50 % without rebuild, then rebuilt."""
    return ST.graph_degradation_curve(splits(spark, sf_dir), GRAPH_M, GRAPH_EF_CONSTRUCTION, GRAPH_EF_SEARCH)


def q_graph_scaling_recall(spark, sf_dir):
    """Per tier: graph m=32/ef_construction=128, beam 40, recall@10 vs the tier's exact top-10."""
    sp = splits(spark, sf_dir)
    out = None
    for t in sp.tier_sizes:
        items = sp.tier(t)
        g = ST.graph_index(items, sp.perm, GRAPH_M, GRAPH_EF_CONSTRUCTION)
        res = GR.search(g, items.select("id", "embedding"), sp.queries, K, GRAPH_EF_SEARCH)
        truth = knn.knn_join(items, sp.queries, K, "cosine")
        r = metrics.mean_recall(truth, res, K).select(
            F.lit(t).cast("long").alias("tier"), F.lit("graph").alias("index_type"),
            F.lit(GRAPH_M).cast("long").alias("m"), F.lit(GRAPH_EF_SEARCH).cast("long").alias("ef_search"),
            "mean_recall", "n_queries")
        out = r if out is None else out.unionByName(r)
    return _round(out, "mean_recall")


def q_graph_edges(spark, sf_dir):
    """Graph m=32, ef_construction=128 as an edge table."""
    g = _graph(splits(spark, sf_dir))
    return _round(g.edges.select("src", "dst", F.col("d").alias("distance")))


def q_graph_search(spark, sf_dir):
    """Beam search with ef_search=40 over the graph, all queries together."""
    sp = splits(spark, sf_dir)
    g = _graph(sp)
    return _long(_round(GR.search(g, sp.base, sp.queries, K, GRAPH_EF_SEARCH)), "rk")


def q_graph_search_l2(spark, sf_dir):
    """L2 graph searched with a beam as wide as the table: must equal the exact kNN."""
    sp = splits(spark, sf_dir)
    g = _graph(sp, metric="l2")
    return _long(_round(GR.search(g, sp.base, sp.queries, K, sp.n_base)), "rk")


def q_graph_validate(spark, sf_dir):
    """Nodes of the graph and violations of its rules: self edges, repeated edges, degrees, stored distances."""
    sp = splits(spark, sf_dir)
    g = _graph(sp)
    side = lambda c: sp.base.select(F.col("id").alias(c), F.col("embedding").alias(f"_{c}"))
    edges = knn.pair_distances(g.edges.join(side("src"), "src").join(side("dst"), "dst"), "_src", "_dst", "cosine", "again")
    per = edges.groupBy("src").agg(
        F.count(F.lit(1)).alias("degree"), F.countDistinct("dst").alias("n_dst"),
        F.count_if(F.col("src") == F.col("dst")).alias("n_self"), F.max(F.abs(F.col("d") - F.col("again"))).alias("err"))
    out = per.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("n_self").alias("n_self_edges"),
        F.sum(F.col("degree") - F.col("n_dst")).alias("n_repeated_edges"),
        F.count_if(F.col("degree") > 2 * g.m).alias("n_over_degree"), F.max("err").alias("max_error"))
    return _round(out, "max_error")


def q_graph_recall(spark, sf_dir):
    """Recall@10 in all 40 cells m x ef_construction x ef_search, built and searched together (E7 for the graph family)."""
    sp = splits(spark, sf_dir)
    g = _graph_cells(sp, ST.graph_builds())
    return _round(ST.graph_sweep(g, sp.base, sp.queries, ST.exact(sp), ST.GRAPH_EF_SEARCH), "mean_recall")


def q_graph_recall_floor(spark, sf_dir):
    """Whether the graph m=32, ef_construction=128 reaches its recall@10 at beam 40 over all queries."""
    sp = splits(spark, sf_dir)
    got = ST.graph_sweep(_graph_cells(sp, [(GRAPH_M, GRAPH_EF_CONSTRUCTION)]), sp.base, sp.queries, ST.exact(sp), [GRAPH_EF_SEARCH])
    return got.select("m", "ef_construction", "ef_search", (F.col("mean_recall") >= GRAPH_RECALL).alias("recall_ok"), "n_queries")


def q_graph_reachable(spark, sf_dir):
    """Per cell of the sweep: nodes, nodes that no path from the entry points reaches, nodes above 2m edges."""
    sp = splits(spark, sf_dir)
    g = _graph_cells(sp, ST.graph_builds())
    cells = spark.createDataFrame([(i, m, efc) for i, (m, efc) in enumerate(g.cells)], "cell int, m long, ef_construction long")
    each = F.explode(F.array(*[F.lit(i) for i in range(len(g.cells))]))
    nodes = sp.base.select("id", each.alias("cell")).join(F.broadcast(cells), "cell")
    seen = GR.reached(g.edges, g.entry, len(g.cells)).withColumn("seen", F.lit(1))
    degree = g.edges.groupBy("cell", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    per = nodes.join(seen, ["cell", "id"], "left").join(degree, ["cell", "id"], "left")
    return per.groupBy("m", "ef_construction").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("seen").isNull()).alias("n_unreached"),
        F.count_if(F.coalesce("degree", F.lit(0)) > 2 * F.col("m")).alias("n_over_degree"))


def queries() -> dict[str, Query]:
    return {
        # text preparation and sampling
        "sentences": q_sentences,
        "sentence_pool": q_sentence_pool,
        "insert_pool": q_insert_pool,
        "permutation": q_permutation,
        "tier_slice": q_tier_slice,
        "query_slice": q_query_slice,
        "length_stats": q_length_stats,
        "row_preview": q_row_preview,
        "vector_preview": q_vector_preview,
        "split_disjoint": q_split_disjoint,
        "csv_roundtrip": q_csv_roundtrip,
        # vector functions
        "vec_l2": _pair_fn(V.l2_distance, "distance"),
        "vec_cosine": _pair_fn(V.cosine_distance, "distance"),
        "vec_l1": _pair_fn(V.l1_distance, "distance"),
        "vec_dot": _pair_fn(V.dot, "dot"),
        "vec_norms": q_vec_norms,
        "vec_normalize": q_vec_normalize,
        "tier_validate": q_tier_validate,
        "dim_quarantine": q_dim_quarantine,
        "vector_tsv_roundtrip": q_vector_tsv_roundtrip,
        # search
        "knn_single_l2": q_knn_single_l2,
        "knn_with_distance": q_knn_with_distance,
        "knn_join_cosine": _knn_join("cosine"),
        "knn_join_l2": _knn_join("l2"),
        "knn_join_l1": _knn_join("l1"),
        # operation-log metrics
        "latency_summary": q_latency_summary,
        "latency_sketch": q_latency_sketch,
        "throughput": q_throughput,
        "workload_summary": q_workload_summary,
        "metrics_log": q_metrics_log,
        # ground truth
        "ground_truth_topk": q_ground_truth_topk,
        "growing_ground_truth": q_growing_ground_truth,
        "growing_truth_incremental": q_growing_truth_incremental,
        "gt_validate": q_gt_validate,
        # inverted lists and evaluation
        "ivf_pivot_postings": q_ivf_pivot_postings,
        "ivf_postings": q_ivf_postings,
        "ivf_trained_nearest": q_ivf_trained_nearest,
        "ivf_pivot_search": q_ivf_pivot_search,
        "ivf_pivot_recall": q_ivf_pivot_recall,
        "ivf_search": q_ivf_search,
        "ivf_recall": q_ivf_recall,
        "ivf_probe_sweep": q_ivf_probe_sweep,
        "recall_at_k": q_recall_at_k,
        "recall_curve": q_recall_curve,
        "sweep_grid": q_sweep_grid,
        "scaling_recall": q_scaling_recall,
        "degradation_curve_pivot": q_degradation_curve_pivot,
        "degradation_curve": q_degradation_curve,
        "rebuild_delta": q_rebuild_delta,
        "rebuild_delta_pivot": q_rebuild_delta_pivot,
        "metrics_scrub": q_metrics_scrub,
        # table operations
        "load_tier": q_load_tier,
        "pk_violations": q_pk_violations,
        "append_range": q_append_range,
        "append_resume": q_append_resume,
        "append_checked": q_append_checked,
        "delete_range": q_delete_range,
        "delete_steps": q_delete_steps,
        "index_versions": q_index_versions,
        "table_state": q_table_state,
        "compact_postings": q_compact_postings,
        "index_manifest": q_index_manifest,
        # embedding stage
        "embed_pool": q_embed_pool,
        "embed_pool_batched": q_embed_pool_batched,
        "stage_cache": q_stage_cache,
        "embedding_rate": q_embedding_rate,
        # corpus to search
        "text_items": q_text_items,
        "text_ground_truth": q_text_ground_truth,
        "text_knn": q_text_knn,
        # neighbour graph
        "graph_edges": q_graph_edges,
        "graph_search": q_graph_search,
        "graph_search_l2": q_graph_search_l2,
        "graph_validate": q_graph_validate,
        "graph_recall": q_graph_recall,
        "graph_recall_floor": q_graph_recall_floor,
        "graph_reachable": q_graph_reachable,
        "graph_degradation_curve": q_graph_degradation_curve,
        "graph_scaling_recall": q_graph_scaling_recall,
        # streaming
        "stream_ingest": q_stream_ingest,
        "stream_lookup": q_stream_lookup,
        "stream_lookup_recall": q_stream_lookup_recall,
        "stream_cyclic_ingest": q_stream_cyclic_ingest,
        "stream_workload_windows": q_stream_workload_windows,
    }
