"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition first reduces its own rows to a *run*: one entry per
digest, with the best row and the number of rows.  Runs then meet in binomial
rounds: in each round 2**b runs with neighbouring numbers go to one, entries
of equal digest are merged, and the verified best row is kept, until a single
run is left.  A run is spread over as many tasks as there are shuffle
partitions (by digest), so no round has a task for a whole run, and a group
of copies, however large, reaches a round as one entry per run.

Entries are equal only if the 64-bit digest that runs are ordered by, the
full SHA-256 and the length of the normalised text all agree (the
verification of every level).

Each row has a number of its own, the last item of the order, so the best row
of a group is one row.  Rows then learn their group's best row: groups with a
thousandth of all rows or more, of which there are at most a thousand, are
broadcast, so a hot group stays where its rows are read; the others meet
their rows by digest.

Defined results: a null text counts as empty; all texts without other
characters than white space are equal; a null ``doc_id`` comes after every
other one; of repeated rows (same text, same id) exactly one is kept; an
empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import SPACES, row_id, staged

_KEY = ["_digest", "_sha", "_len"]
#: A group with at least one of so many rows is hot: there are no more hot groups than this.
HOT_GROUPS = 1000


def digests(docs: DataFrame, run_bits: int) -> DataFrame:
    """One slim row per document: normalised text's digests, its place in the order, its run."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), *row_id())
        .select("doc_id", "_id", "_th", F.monotonically_increasing_id().alias("_row"), F.char_length("_text").cast("long").alias("_chars"), F.translate("_text", SPACES, "").alias("_norm"))
        .select(
            "doc_id",
            "_id",
            "_th",
            "_row",
            "_chars",
            F.xxhash64("_norm").alias("_digest"),
            F.unhex(F.sha2("_norm", 256)).alias("_sha"),
            F.octet_length("_norm").alias("_len"),
            F.pmod(F.spark_partition_id(), F.lit(1 << run_bits)).alias("_run"),
        )
    )


def _order():
    """Smallest first: most code points, then smallest id, null ids last; repeated rows by their number."""
    return F.struct((-F.col("_chars")).alias("neg"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "_row")


def tree_merge(rows: DataFrame, run_bits: int, round_bits: int) -> DataFrame:
    """One entry per digest: best row and number of rows, merged over binomial rounds of runs."""
    level = rows.groupBy("_run", *_KEY).agg(F.min(_order()).alias("_best"), F.count(F.lit(1)).alias("_size"))
    left = run_bits
    while left > 0:
        step = min(round_bits, left)
        left -= step
        level = (
            level.withColumn("_run", F.shiftright("_run", step))
            .groupBy("_run", *_KEY)
            .agg(F.min("_best").alias("_best"), F.sum("_size").alias("_size"))
        )
    return level.drop("_run")


def exact_dedup(docs: DataFrame, run_bits: int = 6, round_bits: int = 3) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` (and ``_id, _th``): one row per row of ``docs``."""
    rows = staged(digests(docs, run_bits), "digest_runs")
    best = staged(tree_merge(rows, run_bits, round_bits), "digest_groups")
    is_hot = F.col("_size") * HOT_GROUPS >= F.lit(rows.count())
    hot = F.broadcast(best.where(is_hot))
    met = rows.join(hot, _KEY).unionByName(rows.join(hot, _KEY, "left_anti").join(best.where(~is_hot), _KEY))
    return met.select(
        "doc_id",
        F.col("_best.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        "_id",
        "_th",
    )
