"""Consecutive 0-based row numbers at scale (``dense_index``).

``row_number()`` over an unpartitioned window would pull every row into one
task, and ``monotonically_increasing_id`` alone leaves gaps.  We range-partition
on the order keys, sort inside each partition, and number rows locally; a tiny
table of per-partition counts is prefix-summed and joined back.  The ranged
data is checkpointed between the two passes so both see identical partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.session import reliable_checkpoint

_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id: record number lives in the low 33 bits


def dense_index(
    df: DataFrame,
    order_cols: Sequence[str],
    index_col: str = "idx",
    partition_cols: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``index_col`` = 0-based position of each row in ``order_cols`` order,
    restarting for every value of ``partition_cols``.  ``order_cols`` must make
    the order total (include a unique key)."""
    rows = in_order(df, [*partition_cols, *order_cols], reliable_checkpoint, num_partitions)
    return numbered_rows(rows, index_col, partition_cols)


def in_order(df: DataFrame, keys: Sequence[str], store, num_partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, as ``store`` (DataFrame -> stored DataFrame) keeps it, with the place of every row."""
    # range partitioning samples its input in a separate job: persist the input
    # so the upstream plan runs once, not once for the sample and once for the shuffle
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    # without an explicit count AQE sizes the ranges (initial partition number,
    # then coalescing of adjacent ranges to the advisory size); coalesced
    # partitions stay contiguous and ordered, so local numbering stays correct
    ranged_src = src.repartitionByRange(num_partitions, *keys) if num_partitions else src.repartitionByRange(*keys)
    try:
        return store(ranged_src.sortWithinPartitions(*keys).withColumn("_nf_mid", F.monotonically_increasing_id()))
    finally:
        src.unpersist()


def numbered_rows(ranged: DataFrame, index_col: str = "idx", partition_cols: Sequence[str] = ()) -> DataFrame:
    """The stored rows of :func:`in_order` with their positions; nothing is shuffled or stored again."""
    part = list(partition_cols)
    tagged = ranged.withColumn("_nf_pid", F.shiftright("_nf_mid", 33)).withColumn(
        "_nf_loc", F.col("_nf_mid").bitwiseAND(F.lit(_LOW_BITS))
    )
    stats = tagged.groupBy(*part, "_nf_pid").agg(
        F.count(F.lit(1)).alias("_nf_cnt"), F.min("_nf_loc").alias("_nf_first")
    )
    w = Window.partitionBy(*part).orderBy("_nf_pid") if part else Window.orderBy("_nf_pid")
    # one row per (group, input partition): small, so the window stays cheap and the join is a broadcast
    stats = stats.withColumn("_nf_off", F.sum("_nf_cnt").over(w) - F.col("_nf_cnt")).drop("_nf_cnt")
    out = tagged.join(F.broadcast(stats), on=[*part, "_nf_pid"], how="inner")
    out = out.withColumn(index_col, F.col("_nf_off") + F.col("_nf_loc") - F.col("_nf_first"))
    return out.drop("_nf_mid", "_nf_pid", "_nf_loc", "_nf_first", "_nf_off")
