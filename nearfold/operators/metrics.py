"""Evaluation metrics as aggregations.

* recall is an equi join of result and truth on (qid, id), both cut to k;
* percentiles are exact (linear interpolation, like ``np.percentile``) and
  computed from global ranks: values are range-partitioned by (group, value)
  and numbered with ``dense_index``, so a group holding a third of all rows
  is still spread over many tasks, never buffered in one;
* a run's warm-up repeats the first W operations per group, found with a
  windowed top-W (``WindowGroupLimit`` trims each partition before the shuffle);
* where exact ranks are not needed, latencies are kept as KLL sketches of
  bounded size per minute, which merge into any longer window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.operators.indexing import dense_index

# Recall depths reported by the curve; warm-up length.
RECALL_KS = (1, 10, 50, 100)
WARMUP = 20


def recall_per_query(truth: DataFrame, result: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """|result_k ∩ truth_k| / |truth_k| per query (E1, U2); |truth_k| = min(k, n)."""
    keys = list(keys)
    t = truth.where(F.col("rk") <= k).select(*keys, "qid", "id")
    r = result.where(F.col("rk") <= k).select(*keys, "qid", "id", F.lit(1).alias("_hit"))
    j = t.join(r, [*keys, "qid", "id"], "left")
    return j.groupBy(*keys, "qid").agg(
        (F.count("_hit") / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("n_truth")
    )


def mean_recall(truth: DataFrame, result: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    per_q = recall_per_query(truth, result, k, keys)
    return per_q.groupBy(*keys).agg(
        F.avg("recall").alias("mean_recall"), F.count(F.lit(1)).alias("n_queries")
    )


def recall_curve(truth: DataFrame, result: DataFrame, ks: Sequence[int] = RECALL_KS,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Mean recall at several k in one pass (E2): rows join every k >= their rank."""
    arr = F.array(*[F.lit(int(k)) for k in ks])
    keys = list(keys)

    def cut(df):
        return df.withColumn("k", F.explode(F.filter(arr, lambda k: k >= F.col("rk"))))

    t = cut(truth.select(*keys, "qid", "rk", "id")).drop("rk")
    r = cut(result.select(*keys, "qid", "rk", "id")).drop("rk").withColumn("_hit", F.lit(1))
    per_q = (
        t.join(r, [*keys, "k", "qid", "id"], "left")
        .groupBy(*keys, "k", "qid")
        .agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("depth"))
    )
    return per_q.groupBy(*keys, "k").agg(
        F.avg("recall").alias("mean_recall"),
        F.count(F.lit(1)).alias("n_queries"),
        F.max("depth").cast("long").alias("depth"),
    )


def exact_percentiles(df: DataFrame, group_cols: Sequence[str], value_col: str, ps: dict[str, float],
                      tiebreak: str | None = None) -> DataFrame:
    """Exact linearly interpolated percentiles per group, from global ranks.

    Returns group cols + one column per entry of ``ps`` (name -> fraction)."""
    g = list(group_cols)
    order = [value_col] + ([tiebreak] if tiebreak else [])
    vals = df.select(*g, *order).where(F.col(value_col).isNotNull())
    ranked = dense_index(vals, order, "_nf_r", partition_cols=g)
    counts = vals.groupBy(*g).agg(F.count(F.lit(1)).alias("_nf_n"))
    # ranks each group needs: floor and ceil of p*(n-1) for every p
    need = counts
    for name, p in ps.items():
        pos = F.lit(float(p)) * (F.col("_nf_n") - 1)
        need = need.withColumn(f"{name}__pos", pos)
    wanted = need.select(
        *g,
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.array(
                        *[
                            F.array(F.floor(f"{n}__pos").cast("long"), F.ceil(f"{n}__pos").cast("long"))
                            for n in ps
                        ]
                    )
                )
            )
        ).alias("_nf_r"),
    )
    picked = ranked.join(wanted, [*g, "_nf_r"], "left_semi").select(*g, "_nf_r", value_col)
    at = picked.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("_nf_r", value_col))).alias("_nf_m"))
    out = need.join(at, g, "inner")
    cols = []
    for n in ps:
        pos = F.col(f"{n}__pos")
        lo = F.element_at("_nf_m", F.floor(pos).cast("long"))
        hi = F.element_at("_nf_m", F.ceil(pos).cast("long"))
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(n))
    return out.select(*g, *cols)


def with_warmup(ops: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], warmup: int = WARMUP) -> DataFrame:
    """The operations of a benchmark run (E5): the first ``warmup`` of every group run once
    untimed (``phase`` warmup), then all of them are timed, these included (``phase`` timed)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    first = ops.withColumn("_nf_w", F.row_number().over(w)).where(F.col("_nf_w") <= warmup).drop("_nf_w")
    return first.withColumn("phase", F.lit("warmup")).unionByName(ops.withColumn("phase", F.lit("timed")))


#: Size parameter of a latency sketch, and the rank error that its quantiles stay within.
SKETCH_K, SKETCH_RANK_ERROR = 400, 0.02


def latency_sketches(ops: DataFrame, group_cols: Sequence[str], latency_col: str = "latency_ms") -> DataFrame:
    """One mergeable quantile sketch (KLL) per group, of bounded size: group cols, ``n``, ``sketch``."""
    seen = ops.where(F.col(latency_col).isNotNull())
    return seen.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(latency_col, F.lit(SKETCH_K)).alias("sketch")
    )


def merged_quantiles(sketches: DataFrame, group_cols: Sequence[str], ps: dict[str, float]) -> DataFrame:
    """Quantiles of the union of the groups' sketches (E3, E12): group cols, ``n``, one column per entry of ``ps``."""
    merged = sketches.groupBy(*group_cols).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("_s"))
    return merged.select(*group_cols, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(c) for c, p in ps.items()])


def rank_errors(ops: DataFrame, quantiles: DataFrame, group_cols: Sequence[str], ps: dict[str, float], latency_col: str = "latency_ms") -> DataFrame:
    """Per group: how far each quantile's exact rank lies from the asked one (0 where it holds the rank)."""
    both = ops.where(F.col(latency_col).isNotNull()).join(quantiles, list(group_cols))
    n = F.count(F.lit(1))
    error = {
        c: F.greatest(F.lit(0.0), F.count_if(F.col(latency_col) < F.col(c)) / n - p, p - F.count_if(F.col(latency_col) <= F.col(c)) / n)
        for c, p in ps.items()
    }
    return both.groupBy(*group_cols).agg(n.alias("n"), *[e.alias(f"{c}_rank_error") for c, e in error.items()])


def latency_summary(ops: DataFrame, group_cols: Sequence[str], latency_col: str = "latency_ms",
                    id_col: str = "event_id") -> DataFrame:
    """count, mean, p95, p99 of latency per group."""
    g = list(group_cols)
    base = ops.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n_ops"), F.avg(latency_col).alias("mean_latency_ms")
    )
    pct = exact_percentiles(ops, g, latency_col, {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}, id_col)
    return base.join(pct, g, "inner")


def tier_validation(tiers: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Per tier: rows, dimension range, NaN rows, norm range."""
    from nearfold.functions import vectors as V

    nrm = V.norm(vec_col)
    return tiers.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size(vec_col)).cast("long").alias("min_dim"),
        F.max(F.size(vec_col)).cast("long").alias("max_dim"),
        F.count_if(V.has_nan(vec_col)).alias("n_nan"),
        F.count_if(F.col(vec_col).isNull()).alias("n_null"),
        F.round(F.min(nrm), 6).alias("min_norm"),
        F.round(F.max(nrm), 6).alias("max_norm"),
    )
