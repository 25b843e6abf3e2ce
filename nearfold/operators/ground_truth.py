"""Exact ground truth for nested tiers and for growing tables.

Nested tiers and growth checkpoints are both "prefix" sets: tier t is the
union of slabs 0..t.  One scan computes the top-k per (slab, query); every
tier/checkpoint is then a merge of at most (#slabs x k) rows per query, since
the top-k of a union is the top-k of the members' top-k lists.

For a growing table the slabs' lists are stored, one partition per slab, and a
later checkpoint scans only the slabs that are not there yet (``extend_truth``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators import knn
from nearfold.session import path_exists

# Fixed value: depth of stored ground truth (supports recall@1..@100).
DEPTH = 100


def slab_of(rank_col: str, bounds: Sequence[int]):
    """Index of the first bound the rank falls under (bounds ascending)."""
    expr = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        expr = F.when(F.col(rank_col) < bounds[i], F.lit(i)).otherwise(expr)
    return expr


def tier_ground_truth(perm_base: DataFrame, tiers: DataFrame, tier_sizes: Sequence[int], queries: DataFrame,
                      k: int = DEPTH, metric: str = "cosine") -> DataFrame:
    """Top-k per (tier, query) for nested tiers: (tier, qid, rk, id, pool_pos, distance).

    ``perm_base`` holds (pool_pos, perm_rank, embedding) of the largest tier;
    ids in the output are the tier-local ids from ``tiers``."""
    items = perm_base.withColumn("slab", slab_of("perm_rank", tier_sizes)).select(
        "slab", F.col("pool_pos").alias("id"), "embedding"
    )
    per_slab = knn.knn_join(items, queries, k, metric, group_cols=["slab"])
    merged = knn.cumulative_topk(per_slab, list(range(len(tier_sizes))), k, out_col="tier_ix")
    tier_map = F.array(*[F.lit(int(t)) for t in tier_sizes])
    merged = merged.withColumn("tier", F.element_at(tier_map, (F.col("tier_ix") + 1).cast("int")).cast("long"))
    local = tiers.select(F.col("tier").cast("long").alias("tier"), F.col("id").alias("local_id"),
                         F.col("pool_pos").alias("id"))
    out = merged.join(local, ["tier", "id"], "inner")
    return out.select("tier", "qid", F.col("rk").cast("long").alias("rk"), F.col("local_id").alias("id"),
                      F.col("id").alias("pool_pos"), "distance")


def remap_ids(pos_col: str, n_base: int, offset: int):
    """Grown-corpus id (K6): positions below n_base keep their id, later ones get offset + (pos - n_base)."""
    return F.when(F.col(pos_col) < n_base, F.col(pos_col)).otherwise(F.lit(offset) + F.col(pos_col) - n_base)


def checkpoint_pct(count_col, n_base: int):
    """round(c / n * 100), rounding half to even."""
    return F.bround(F.col(count_col) * 100.0 / n_base, 0).cast("int")


def extend_truth(items: DataFrame, queries: DataFrame, path: str, k: int, metric: str = "cosine") -> list[int]:
    """Add the top-k lists of the slabs of ``items`` (slab, id, embedding) that ``path`` does not hold yet; returns these slabs.

    ``path`` belongs to one table of queries, one ``k`` and metric.  ``topk`` has a
    partition per slab, ``done`` names the finished ones; a slab that a crash
    left behind is written again as a whole."""
    spark = items.sparkSession
    done = {r["slab"] for r in spark.read.parquet(f"{path}/done").collect()} if path_exists(spark, f"{path}/done") else set()
    new = sorted({r["slab"] for r in items.select("slab").distinct().collect()} - done)  # one row per checkpoint
    if new:
        found = knn.knn_join(items.where(F.col("slab").isin(new)), queries, k, metric, group_cols=["slab"])
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slab").parquet(f"{path}/topk")
        spark.createDataFrame([(s,) for s in new], "slab int").coalesce(1).write.mode("append").parquet(f"{path}/done")
    return new


def growing_ground_truth(base: DataFrame, inserts: DataFrame, queries: DataFrame, checkpoints: Sequence[int],
                         n_base: int, offset: int, k: int = 10, metric: str = "cosine", path: str | None = None) -> DataFrame:
    """Top-k over base ∪ first c inserts for c in (0, *checkpoints).

    With a ``path`` the slabs' lists are kept there, and only slabs that an earlier run (whose checkpoints these
    continue) has not stored are scanned.
    Returns (checkpoint_pct, cumulative_inserts, qid, rk, id, distance)."""
    cps = [0, *checkpoints]
    grown = base.select(F.col("id").alias("gpos"), "embedding").withColumn("slab", F.lit(0)).unionByName(
        inserts.where(F.col("seq") < max(cps)).select(
            (F.col("seq") + n_base).alias("gpos"), "embedding", (slab_of("seq", list(checkpoints)) + 1).alias("slab")
        )
    )
    items = grown.select("slab", remap_ids("gpos", n_base, offset).alias("id"), "embedding")
    if path is None:
        per_slab = knn.knn_join(items, queries, k, metric, group_cols=["slab"])
    else:
        extend_truth(items, queries, path, k, metric)
        per_slab = base.sparkSession.read.schema("slab long, qid long, rk int, id long, distance double").parquet(f"{path}/topk")
    merged = knn.cumulative_topk(per_slab, list(range(len(cps))), k, out_col="cp_ix")
    cp_map = F.array(*[F.lit(int(c)) for c in cps])
    merged = merged.withColumn("cumulative_inserts", F.element_at(cp_map, (F.col("cp_ix") + 1).cast("int")).cast("long"))
    return merged.select(
        checkpoint_pct("cumulative_inserts", n_base).cast("long").alias("checkpoint_pct"),
        "cumulative_inserts", "qid", F.col("rk").cast("long").alias("rk"), "id", "distance",
    )


def validate_ground_truth(gt: DataFrame, grown_ids: DataFrame, offset: int) -> DataFrame:
    """Per checkpoint: NaN distances, negative ids, ids beyond offset + c, ids absent
    from the grown table (K7).  ``grown_ids`` has (cumulative_inserts, id)."""
    missing = gt.join(grown_ids, ["cumulative_inserts", "id"], "left_anti").groupBy("cumulative_inserts").agg(
        F.count(F.lit(1)).alias("n_missing")
    )
    checks = gt.groupBy("checkpoint_pct", "cumulative_inserts").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.isnan("distance") | F.col("distance").isNull()).alias("n_nan"),
        F.count_if(F.col("id") < 0).alias("n_negative"),
        F.count_if((F.col("cumulative_inserts") > 0) & (F.col("id") >= F.lit(offset) + F.col("cumulative_inserts"))).alias(
            "n_out_of_range"
        ),
    )
    return checks.join(missing, "cumulative_inserts", "left").fillna(0, ["n_missing"])
