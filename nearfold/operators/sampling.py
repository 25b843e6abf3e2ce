"""Corpus -> sentence pool -> nested samples.

All steps are narrow transformations over the document scan except the two
global numberings (pool order and permutation rank), which use
``dense_index`` (range partitioning + prefix sums, no single-task window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions import text as TX
from nearfold.operators.indexing import dense_index, in_order, numbered_rows
from nearfold.plans.splits import permute
from nearfold.session import path_exists, spread

# Pool cut and insert pool as shares of all sentences (pool 2/3,
# inserts the remaining 1/3 = half the pool); the largest tier is pool*10/11,
# tiers are 10/50/100 % of it; queries are the held-out rest of the pool.
POOL_SHARE = (2, 3)
MAX_TIER_SHARE = (10, 11)
TIER_SHARES = (10, 50, 100)


def sentences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, text, n_chars) for every sentence that passes the length rule."""
    clean = TX.collapse_whitespace(F.col(text_col))
    pieces = spread(docs.where(F.col(text_col).isNotNull())).select(
        F.col(id_col).alias("doc_id"), F.posexplode(TX.split_sentences(clean)).alias("pos", "raw")
    )
    s = F.trim(F.col("raw"))
    return pieces.select("doc_id", "pos", s.alias("text")).where(TX.length_ok(F.col("text"))).withColumn(
        "n_chars", F.length("text")
    )


def numbered(sents: DataFrame) -> DataFrame:
    """Pool order: consecutive ``pool_pos`` over (doc_id, pos) (T4)."""
    return dense_index(sents, ["doc_id", "pos"], "pool_pos")


def numbered_from(spark, path: str, sents) -> DataFrame:
    """:func:`numbered`, with the ordered sentences stored once at ``path`` (if missing, from ``sents()``) and numbered as they are read."""
    if not path_exists(spark, path):
        in_order(sents(), ["doc_id", "pos"], lambda df: df.write.mode("overwrite").parquet(path))
    return numbered_rows(spark.read.parquet(path), "pool_pos")


def pool_size(total: int) -> int:
    return total * POOL_SHARE[0] // POOL_SHARE[1]


def sentence_pool(numbered_sents: DataFrame, size: int) -> DataFrame:
    """The first ``size`` sentences in corpus order (T4)."""
    return numbered_sents.where(F.col("pool_pos") < size)


def insert_pool(numbered_sents: DataFrame, skip: int, take: int) -> DataFrame:
    """Skip the first ``skip`` sentences, take the next ``take`` (T5)."""
    return numbered_sents.where((F.col("pool_pos") >= skip) & (F.col("pool_pos") < skip + take)).withColumn(
        "seq", F.col("pool_pos") - skip
    )


def max_tier(pool_rows: int) -> int:
    return pool_rows * MAX_TIER_SHARE[0] // MAX_TIER_SHARE[1]


def tier_sizes(pool_rows: int) -> list[int]:
    m = max_tier(pool_rows)
    return [m * s // 100 for s in TIER_SHARES]


def permuted(pool: DataFrame) -> DataFrame:
    """Seeded permutation rank over the pool."""
    return permute(pool, "pool_pos", "perm_rank")


def tier_slice(perm: DataFrame, sizes: list[int]) -> DataFrame:
    """Nested tiers: (tier, id, pool_pos, text), ids 0..n-1 in pool order."""
    arr = F.array(*[F.lit(int(t)) for t in sizes])
    keys = perm.select("pool_pos", F.explode(F.filter(arr, lambda t: t > F.col("perm_rank"))).alias("tier"))
    return dense_index(keys, ["pool_pos"], "id", partition_cols=["tier"]).join(perm, "pool_pos")


def query_slice(perm: DataFrame, start: int, count: int | None = None) -> DataFrame:
    """Held-out queries: ranks [start, start+count), numbered in permutation order."""
    cond = F.col("perm_rank") >= start
    if count is not None:
        cond = cond & (F.col("perm_rank") < start + count)
    return perm.where(cond).withColumn("qid", F.col("perm_rank") - start)


def length_stats(tiers: DataFrame, text_col: str = "text") -> DataFrame:
    """Per tier: rows, min/max length and rows shorter than the minimum."""
    n = F.length(text_col)
    return tiers.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(n).alias("min_len"),
        F.max(n).alias("max_len"),
        F.count_if(n < TX.MIN_LEN).alias("n_short"),
    )


def disjointness(parts: dict[str, DataFrame], key: str = "pool_pos") -> DataFrame:
    """Rows shared by every pair of named parts (U3); all zero when disjoint.

    Each pair is a semi join on the key (an equi join, never a product)."""
    names = sorted(parts)
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared = parts[a].select(key).join(parts[b].select(key), key, "left_semi")
            row = shared.agg(F.count(F.lit(1)).alias("n_shared")).select(
                F.lit(a).alias("part_a"), F.lit(b).alias("part_b"), "n_shared"
            )
            out = row if out is None else out.unionByName(row)
    return out
