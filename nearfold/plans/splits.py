"""Splits of the vector pool (base, nested tiers, insert pool, held-out queries).

The pool is ranked once by a seeded hash permutation (T6); every split is a
range of that rank, so tiers nest, and queries and inserts are disjoint from
the base by construction (U3 checks it).  Within a tier rows are re-numbered
``0..n-1`` in pool order (T7); queries keep permutation order (T8).

The two tables that need a global numbering (``perm`` and ``tiers``) are
written once per session as a stage cache under the shared checkpoint folder
and read back (S8), so every later job starts from parquet, not from lineage.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.operators.indexing import dense_index
from nearfold.session import path_exists, scratch_path
from nearfold.sources import fixtures

# Fixed values of the sampling scheme.
SEED = 42
BASE_SHARE = (6, 10)  # base = perm_rank < 0.6 N
INSERT_SHARE = (3, 10)  # insert pool = next 0.3 N (50 % of base)
TIER_SHARES = (10, 50, 100)  # tiers in percent of base
CHECKPOINT_SHARES = (10, 20, 30, 50)  # cumulative inserts in percent of base
INSERT_ID_OFFSET = 800_000_000  # ids of grown rows: offset + insert sequence

_MEMO: dict = {}


def permutation_key(pos_col: str = "pool_pos"):
    """md5 of '<seed>:<position>' as the sort key of the seeded permutation."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.col(pos_col).cast("string")))


def permute(df: DataFrame, pos_col: str = "pool_pos", rank_col: str = "perm_rank") -> DataFrame:
    """Add the 0-based permutation rank (T6): rank of the md5 key, ties by position."""
    keys = df.select(pos_col, permutation_key(pos_col).alias("_nf_pkey"))
    ranks = dense_index(keys, ["_nf_pkey", pos_col], rank_col).drop("_nf_pkey")
    return df.join(ranks, pos_col)  # only keys are sorted; the rows move once


@dataclass
class Splits:
    n: int
    n_base: int
    n_ins: int
    n_q: int
    perm: DataFrame  # pool_pos, perm_rank, embedding, label
    tiers: DataFrame  # tier, id, pool_pos, perm_rank, embedding
    meta: dict = field(default_factory=dict)

    @property
    def tier_sizes(self) -> list[int]:
        return [self.n_base * s // 100 for s in TIER_SHARES]

    @property
    def checkpoints(self) -> list[int]:
        return [self.n_base * s // 100 for s in CHECKPOINT_SHARES]

    @property
    def base(self) -> DataFrame:
        """The full base tier: (id, pool_pos, embedding)."""
        return self.tiers.where(F.col("tier") == self.n_base).select("id", "pool_pos", "embedding")

    def tier(self, size: int) -> DataFrame:
        return self.tiers.where(F.col("tier") == size).select("id", "pool_pos", "embedding")

    @property
    def inserts(self) -> DataFrame:
        """Insert pool in insertion order: (seq, pool_pos, embedding)."""
        lo, hi = self.n_base, self.n_base + self.n_ins
        return self.perm.where((F.col("perm_rank") >= lo) & (F.col("perm_rank") < hi)).select(
            (F.col("perm_rank") - lo).alias("seq"), "pool_pos", "embedding"
        )

    @property
    def queries(self) -> DataFrame:
        """Held-out queries in permutation order: (qid, pool_pos, embedding)."""
        lo = self.n_base + self.n_ins
        return self.perm.where(F.col("perm_rank") >= lo).select(
            (F.col("perm_rank") - lo).alias("qid"), "pool_pos", "embedding"
        )


def sizes(n: int) -> tuple[int, int, int]:
    n_base = n * BASE_SHARE[0] // BASE_SHARE[1]
    n_ins = n * INSERT_SHARE[0] // INSERT_SHARE[1]
    return n_base, n_ins, n - n_base - n_ins


def tier_slices(perm: DataFrame, tier_sizes: list[int]) -> DataFrame:
    """All nested tiers at once (T7): a row joins every tier whose size exceeds
    its rank; ids restart at 0 in each tier, in pool order."""
    arr = F.array(*[F.lit(int(t)) for t in tier_sizes])
    keys = perm.select("pool_pos", F.explode(F.filter(arr, lambda t: t > F.col("perm_rank"))).alias("tier"))
    return dense_index(keys, ["pool_pos"], "id", partition_cols=["tier"]).join(perm, "pool_pos")


def splits(spark: SparkSession, sf_dir: str) -> Splits:
    files = fixtures.fingerprint(spark, sf_dir, "embeddings")
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key in _MEMO:
        return _MEMO[key]
    pool = fixtures.vectors(spark, sf_dir)
    n = pool.count()
    n_base, n_ins, n_q = sizes(n)
    tag = hashlib.sha1(f"{sf_dir}:{files}".encode()).hexdigest()[:12]
    root = scratch_path(spark, "splits", tag, fresh=False)
    perm_path, tiers_path = f"{root}/perm", f"{root}/tiers"
    if not path_exists(spark, perm_path):
        permute(pool).write.mode("overwrite").parquet(perm_path)
    perm = spark.read.parquet(perm_path)
    sp = Splits(n, n_base, n_ins, n_q, perm, perm)
    if not path_exists(spark, tiers_path):
        base_rows = perm.where(F.col("perm_rank") < n_base)
        (
            tier_slices(base_rows, sp.tier_sizes)
            .select("tier", "id", "pool_pos", "perm_rank", "embedding")
            .repartitionByRange("tier", "id")
            .write.mode("overwrite")
            .partitionBy("tier")
            .parquet(tiers_path)
        )
    sp.tiers = spark.read.parquet(tiers_path)
    sp.meta["root"] = root
    _MEMO[key] = sp
    return sp
