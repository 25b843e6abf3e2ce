"""Studies built from the operators (K13, E6-E10): sweeps, scaling, degradation.

Each study is a handful of Spark jobs over whole tables: an exact kNN join for
the truth, one index build per configuration, and one scan per build that
answers every probe value at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators import ground_truth as GT
from nearfold.operators import ivf, knn, metrics
from nearfold.plans.corpus import staged
from nearfold.plans.splits import INSERT_ID_OFFSET, Splits
from nearfold.session import scratch_path

# Fixed values of the reference's sweeps: graph m x ef_construction x ef_search
# (cells with ef_construction < 2*m are skipped), and probe values for lists.
GRAPH_M = (16, 32, 64)
GRAPH_EF_CONSTRUCTION = (64, 128, 200)
GRAPH_EF_SEARCH = (10, 20, 40, 80, 160)
PROBES = (1, 5, 10, 20)
K = 10


def graph_grid() -> list[tuple[int, int, int]]:
    """(m, ef_construction, ef_search) cells, constraint ef_construction >= 2m."""
    return [
        (m, efc, efs)
        for m in GRAPH_M
        for efc in GRAPH_EF_CONSTRUCTION
        if efc >= 2 * m
        for efs in GRAPH_EF_SEARCH
    ]


def graph_builds() -> list[tuple[int, int]]:
    """The valid (m, ef_construction) builds of the grid."""
    return sorted({(m, efc) for m, efc, _ in graph_grid()})


def sweep_cells(items: DataFrame) -> DataFrame:
    """The cells of both families for a table, derived from its row count by Spark."""
    fixed = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    n = items.agg(F.count(F.lit(1)).alias("n_rows"))
    none = F.lit(None).cast("long")
    graph = (
        n.withColumn("m", F.explode(fixed(GRAPH_M)))
        .withColumn("ef_construction", F.explode(fixed(GRAPH_EF_CONSTRUCTION)))
        .where(F.col("ef_construction") >= 2 * F.col("m"))
        .withColumn("ef_search", F.explode(fixed(GRAPH_EF_SEARCH)))
        .select(F.lit("graph").alias("index_type"), "m", "ef_construction", "ef_search", none.alias("lists"),
                none.alias("probes"), none.alias("effective_probes"), "n_rows")
    )
    rule = F.greatest(F.lit(1), F.bround(F.sqrt("n_rows"), 0).cast("long"))
    grid = F.array_distinct(F.array(F.greatest(F.lit(1), F.floor(rule / 2)), rule, 2 * rule))
    lists = (
        n.withColumn("lists", F.explode(grid)).withColumn("probes", F.explode(fixed(PROBES)))
        .select(F.lit("ivf").alias("index_type"), none.alias("m"), none.alias("ef_construction"), none.alias("ef_search"),
                "lists", "probes", F.least("probes", "lists").alias("effective_probes"), "n_rows")
    )
    return graph.unionByName(lists)


def check_graph_params(m: int, ef_construction: int) -> None:
    if ef_construction < 2 * m:
        raise ValueError(f"ef_construction={ef_construction} < 2*m={2 * m}")


def perm_base(sp: Splits) -> DataFrame:
    """Base rows with their permutation rank and base-local id."""
    return sp.base.join(sp.perm.select("pool_pos", "perm_rank"), "pool_pos")


def pivot_index(sp: Splits, lists: int | None = None) -> ivf.IvfIndex:
    lists = lists or ivf.lists_for(sp.n_base)
    items = perm_base(sp)
    cents = ivf.pivot_centroids(items, lists)
    return ivf.build(items.select("id", "embedding"), cents, lists, kind="pivot")


def trained_index(sp: Splits, lists: int | None = None, path: str | None = None) -> ivf.IvfIndex:
    lists = lists or ivf.lists_for(sp.n_base)
    cents = ivf.train_centroids(sp.base, lists)
    return ivf.build(sp.base.select("id", "embedding"), cents, lists, path=path, kind="trained")


def exact(sp: Splits, k: int = K) -> DataFrame:
    """The stored exact top-k of the held-out queries: ``rk <= k`` of one depth-100 table that all studies read."""
    path = f"{sp.meta['root']}/truth"
    truth = staged(sp.perm.sparkSession, path, lambda: knn.knn_join(sp.base, sp.queries, GT.DEPTH, "cosine"))
    return truth.where(F.col("rk") <= k)


def probe_recall(index: ivf.IvfIndex, queries: DataFrame, truth: DataFrame, probe_values: Sequence[int],
                 k: int = K) -> DataFrame:
    """Mean recall@k per probe value, one postings scan for all of them."""
    res = ivf.probe_sweep(index, queries, k, probe_values)
    arr = F.array(*[F.lit(int(p)).cast("long") for p in sorted(set(probe_values))])
    truth_p = truth.withColumn("probes", F.explode(arr))
    return metrics.mean_recall(truth_p, res, k, keys=["probes"])


def clamped_recall(index: ivf.IvfIndex, queries: DataFrame, truth: DataFrame, probe_values: Sequence[int],
                   k: int = K) -> DataFrame:
    """:func:`probe_recall` for every requested value; ``effective_probes`` is at most the number of lists."""
    real = {p: min(p, index.lists) for p in probe_values}
    cells = F.array(*[F.struct(F.lit(p).cast("long").alias("probes"), F.lit(e).cast("long").alias("effective_probes"))
                      for p, e in sorted(real.items())])
    out = probe_recall(index, queries, truth, sorted(set(real.values())), k)
    out = out.withColumn("_c", F.explode(F.filter(cells, lambda c: c["effective_probes"] == F.col("probes"))))
    return out.select("_c.probes", "_c.effective_probes", "mean_recall", "n_queries")


def lists_probe_sweep(sp: Splits, probe_values: Sequence[int] = PROBES, k: int = K,
                      trained: bool = False) -> DataFrame:
    """lists in (L//2, L, 2L) x probes: mean recall@k per cell."""
    truth = exact(sp, k)
    out = None
    for lists in ivf.lists_grid(sp.n_base):
        idx = trained_index(sp, lists) if trained else pivot_index(sp, lists)
        r = clamped_recall(idx, sp.queries, truth, probe_values, k).withColumn("lists", F.lit(lists).cast("long"))
        out = r if out is None else out.unionByName(r)
    return out


def grown_items(sp: Splits, cumulative: int) -> DataFrame:
    """Base ∪ first ``cumulative`` inserts with remapped ids."""
    ins = sp.inserts.where(F.col("seq") < cumulative).select(
        (F.lit(INSERT_ID_OFFSET) + F.col("seq")).alias("id"), "pool_pos", "embedding", "seq"
    )
    return sp.base.withColumn("seq", F.lit(None).cast("long")).unionByName(ins)


def degradation_curve(sp: Splits, probes: int, trained: bool = False, k: int = K) -> DataFrame:
    """Recall with a frozen index while the table grows, then after a rebuild.

    The frozen centroids assign every insert slab in one map-only pass; one
    postings scan keeps a top-k per (slab, query), and checkpoint c merges the
    slabs it contains.  Returns F9-shaped rows (without timings)."""
    lists = ivf.lists_for(sp.n_base)
    cps = [0, *sp.checkpoints]
    truth = GT.growing_ground_truth(sp.base, sp.inserts, sp.queries, sp.checkpoints, sp.n_base,
                                    INSERT_ID_OFFSET, k)
    if trained:
        cents = ivf.train_centroids(sp.base, lists)
    else:
        cents = ivf.pivot_centroids(perm_base(sp), lists)
    everything = grown_items(sp, max(cps))
    slab = F.when(F.col("seq").isNull(), F.lit(0)).otherwise(GT.slab_of("seq", sp.checkpoints) + 1)
    path = scratch_path(everything.sparkSession, "frozen_postings")
    ivf.write_postings(ivf.assign(everything.withColumn("slab", slab), cents), path, keep=["slab"])
    frozen = everything.sparkSession.read.parquet(path)
    idx = ivf.IvfIndex(cents, frozen, lists, "cosine", path, kind="trained" if trained else "pivot")
    per_slab = ivf.search(idx, sp.queries, k, probes, group_cols=["slab"])
    res = knn.cumulative_topk(per_slab, list(range(len(cps))), k, out_col="cp_ix")
    cp_map = F.array(*[F.lit(int(c)).cast("long") for c in cps])
    res = res.withColumn("cumulative_inserts", F.element_at(cp_map, (F.col("cp_ix") + 1).cast("int")))
    before = metrics.mean_recall(truth, res, k, keys=["cumulative_inserts"]).withColumn(
        "phase", F.lit("no_rebuild"))
    # rebuild on the grown table, lists by the rule on the grown size
    c = max(cps)
    lists2 = ivf.lists_for(sp.n_base + c)
    if trained:
        cents2 = ivf.train_centroids(everything, lists2)
    else:
        ranked = everything.join(sp.perm.select("pool_pos", "perm_rank"), "pool_pos")
        cents2 = ivf.pivot_centroids(ranked, lists2)
    idx2 = ivf.build(everything.select("id", "embedding"), cents2, lists2, kind="rebuilt")
    res2 = ivf.search(idx2, sp.queries, k, probes).withColumn("cumulative_inserts", F.lit(c).cast("long"))
    after = metrics.mean_recall(truth.where(F.col("cumulative_inserts") == c), res2, k,
                                keys=["cumulative_inserts"]).withColumn("phase", F.lit("post_rebuild"))
    out = before.unionByName(after)
    return out.select(
        F.lit("ivf_" + ("trained" if trained else "pivot")).alias("index_type"),
        GT.checkpoint_pct("cumulative_inserts", sp.n_base).cast("long").alias("checkpoint_pct"),
        "cumulative_inserts",
        (F.col("cumulative_inserts") + sp.n_base).alias("total_rows"),
        "phase",
        F.round("mean_recall", 6).alias("mean_recall"),
        "n_queries",
    )


def graph_index(items: DataFrame, perm: DataFrame, m: int, ef_construction: int):
    """Graph over ``items`` (id, pool_pos, embedding): start lists and entry points are
    the first round(sqrt(n)) rows of ``items`` by permutation rank."""
    from nearfold.operators import graph as GR

    ranked = items.join(perm.select("pool_pos", "perm_rank"), "pool_pos")
    lists = ivf.lists_for(items.count())
    piv = ivf.pivot_centroids(ranked, lists)
    assigned = ivf.assign(items.select("id", "embedding"), piv).select("id", "list_id")
    entry = ranked.where(F.col("perm_rank") < lists).select("id")
    return GR.build(items.select("id", "embedding"), assigned, m, ef_construction, entry)


def graph_sweep(g, items: DataFrame, queries: DataFrame, truth: DataFrame, beams: Sequence[int], k: int = K) -> DataFrame:
    """Mean recall@k of every cell of ``g`` at every beam, in one batched search."""
    from nearfold.operators import graph as GR

    grid = [(c, ef) for c in range(len(g.cells)) for ef in beams]
    res = GR.search_runs(GR.laid_out(g), items.select("id", "embedding"), queries, k, grid)
    truth_r = truth.withColumn("run", F.explode(F.array(*[F.lit(r) for r in range(len(grid))])))
    rec = metrics.mean_recall(truth_r, res, k, keys=["run"])
    names = F.array(*[F.struct(F.lit(g.cells[c][0]).cast("long").alias("m"), F.lit(g.cells[c][1]).cast("long").alias("ef_construction"),
                               F.lit(ef).cast("long").alias("ef_search")) for c, ef in grid])
    return rec.withColumn("_c", F.element_at(names, F.col("run") + 1)).select("_c.*", "mean_recall", "n_queries")


def graph_degradation_curve(sp: Splits, m: int, ef_construction: int, ef_search: int, k: int = K) -> DataFrame:
    """E9/E10 for the graph family: insert each slab into the built graph (no
    rebuild), search at every checkpoint, then rebuild on the grown table."""
    from nearfold.operators import graph as GR

    cps = [0, *sp.checkpoints]
    truth = GT.growing_ground_truth(sp.base, sp.inserts, sp.queries, sp.checkpoints, sp.n_base,
                                    INSERT_ID_OFFSET, k)
    g = graph_index(sp.base, sp.perm, m, ef_construction)
    current = sp.base.select("id", "pool_pos", "embedding")
    out = None
    prev = 0
    for c in cps:
        if c > prev:
            slab = sp.inserts.where((F.col("seq") >= prev) & (F.col("seq") < c)).select(
                (F.lit(INSERT_ID_OFFSET) + F.col("seq")).alias("id"), "pool_pos", "embedding")
            g = GR.insert(g, current.select("id", "embedding"), slab.select("id", "embedding"))
            current = current.unionByName(slab)
            prev = c
        res = GR.search(g, current.select("id", "embedding"), sp.queries, k, ef_search)
        r = metrics.mean_recall(truth.where(F.col("cumulative_inserts") == c), res, k).select(
            F.lit(c).cast("long").alias("cumulative_inserts"), F.lit("no_rebuild").alias("phase"),
            "mean_recall", "n_queries")
        out = r if out is None else out.unionByName(r)
    g2 = graph_index(current, sp.perm, m, ef_construction)
    res2 = GR.search(g2, current.select("id", "embedding"), sp.queries, k, ef_search)
    r2 = metrics.mean_recall(truth.where(F.col("cumulative_inserts") == prev), res2, k).select(
        F.lit(prev).cast("long").alias("cumulative_inserts"), F.lit("post_rebuild").alias("phase"),
        "mean_recall", "n_queries")
    out = out.unionByName(r2)
    return out.select(
        F.lit("graph").alias("index_type"),
        GT.checkpoint_pct("cumulative_inserts", sp.n_base).cast("long").alias("checkpoint_pct"),
        "cumulative_inserts",
        (F.col("cumulative_inserts") + sp.n_base).alias("total_rows"),
        "phase",
        F.round("mean_recall", 6).alias("mean_recall"),
        "n_queries",
    )


def benchmark_run(search_fn, truth: DataFrame, table: str, index_type: str, param: int, k: int,
                  n_queries: int, log_path: str | None = None, params: dict | None = None) -> DataFrame:
    """One query-benchmark log row (F7) for a batched search.

    ``search_fn()`` returns the (qid, rk, id, distance) result; it is run to
    completion (noop sink) and timed.  qps = queries / job wall time (the batch
    form of the throughput definitions); per-query latencies do not exist in a
    batch job, so the latency columns stay NULL.  The row is appended to
    ``log_path`` when given (S9) and carries the build params and a run id."""
    import time
    import uuid

    t0 = time.perf_counter()
    res = search_fn()
    res.write.format("noop").mode("overwrite").save()
    wall = time.perf_counter() - t0
    spark = truth.sparkSession
    rec = metrics.mean_recall(truth, res, k)
    row = rec.select(
        F.lit(table).alias("table"), F.lit(index_type).alias("index_type"), F.lit(param).alias("param"),
        F.lit(k).alias("k"), F.lit(n_queries).alias("n_queries"), F.lit(n_queries / wall).alias("qps"),
        F.lit(None).cast("double").alias("mean_latency_ms"), F.lit(None).cast("double").alias("p95_latency_ms"),
        F.lit(None).cast("double").alias("p99_latency_ms"), "mean_recall",
        F.lit(uuid.uuid4().hex).alias("run_id"),
        F.lit(",".join(f"{a}={b}" for a, b in (params or {}).items())).alias("params"),
        F.lit(wall).alias("wall_sec"),
    )
    if log_path:
        from nearfold.sources import textio

        textio.append_log(row, log_path, textio.QUERY_LOG)
        return spark.read.parquet(log_path)
    return row


def rebuild_delta(curve: DataFrame) -> DataFrame:
    """no_rebuild vs post_rebuild at the last checkpoint, with the recall delta."""
    last = curve.where(F.col("phase") == "post_rebuild").select(
        "index_type", "checkpoint_pct", F.col("mean_recall").alias("recall_post_rebuild")
    )
    before = curve.where(F.col("phase") == "no_rebuild").select(
        "index_type", "checkpoint_pct", F.col("mean_recall").alias("recall_no_rebuild")
    )
    j = before.join(last, ["index_type", "checkpoint_pct"], "inner")
    return j.withColumn("recall_delta",
                        F.round(F.col("recall_post_rebuild") - F.col("recall_no_rebuild"), 6) + F.lit(0.0))
