"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Each source's documents are shuffled by a hash and cut into blocks of equal
numbers of words.  Slot n of the mix takes the van der Corput point of n
through the sources' cumulative shares, which names the slot's source; slots
are ranked within their source, and the k-th slot takes block k of that
source's endless repetition of blocks.  A source gets as many slots as its
target needs, the last one cut to length, so the words taken equal the target
to within a word.  The sequence leaves a source at most some tens of slots
short; those follow after the last point.

Prefix sums are two-level (bucket or chunk totals first), so a source with a
third of all rows is spread over ``BUCKETS`` groups.  Tables with one row per
source are small: the number of sources, not of documents, bounds them.

Defined results: a null text has size 0; documents of size 0 are in no block
and take 0; a null source is a source of its own, after all others; repeated
rows count as rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm.common import n_words, row_id, staged

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives each of its words at most this often.
MAX_EPOCHS = 3
#: Words of a block (the last block of a source is shorter).
BLOCK = 2048
#: Groups that a source's rows are shuffled in, and slots that are ranked together.
BUCKETS, CHUNK = 1024, 1024
#: Cells of [0, 1) in which a point looks for its source.
CELLS = 4096


def van_der_corput(n: Column) -> Column:
    """Base-2 radical inverse of the low 32 bits of ``n``, in [0, 1)."""
    x = n.cast("long").bitwiseAND(F.lit((1 << 32) - 1))
    for shift, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        x = F.shiftleft(x.bitwiseAND(F.lit(mask).cast("long")), shift).bitwiseOR(
            F.shiftright(x, shift).bitwiseAND(F.lit(mask).cast("long"))
        )
    return x.cast("double") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target, s_rank``: shares by weight, capped, the excess shared again.

    The final target is min(cap * size, level * weight) for one common level.
    Sources sorted by cap * size / weight reach their caps in that order, so
    running sums give the level, with no rounds."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = total.withColumn("s_rank", F.row_number().over(by_code) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "s_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0))
    ) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0)))
    # Going up that order, a source is capped while the level of those left reaches its cap.
    ranked = ranked.withColumn("_level", level)
    ranked = ranked.withColumn("_free", F.col("_level") * F.col("_w") < F.col("_cap"))
    final = F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("_w")).alias("ratio"), "s_rank", "_level"))).over(whole)["_level"]
    target = F.when(F.coalesce(F.sum("_cap").over(whole), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
        F.least(F.col("_cap"), F.coalesce(final * F.col("_w"), F.col("_cap")))
    )
    return ranked.select("source", "source_size", target.alias("target"), F.col("s_rank").cast("int").alias("s_rank"))


def _prefix(df: DataFrame, group: list[str], cell: str, value: str, out: str) -> DataFrame:
    """Per (group, cell): sum of ``value`` over the cells before."""
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(*group, cell).agg(F.sum(value).alias("_v")).select(
        *group, cell, F.coalesce(F.sum("_v").over(before), F.lit(0)).cast("long").alias(out)
    )


def shuffled_positions(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``_bucket``, ``_n`` (unique together with ``s_rank``) and ``_start``: the words before it in its source."""
    h = F.xxhash64("_id", "_th", F.lit(seed))
    rows = rows.withColumn("_h", h).withColumn("_bucket", F.pmod(F.col("_h"), F.lit(BUCKETS)).cast("int"))
    base = _prefix(rows, ["s_rank"], "_bucket", "size", "_base")
    inside = Window.partitionBy("s_rank", "_bucket").orderBy("_h", "_id", "_th")
    return (
        rows.withColumn("_n", F.row_number().over(inside))
        .withColumn("_start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(base, ["s_rank", "_bucket"])
        .withColumn("_start", F.col("_start") + F.col("_base"))
        .drop("_base", "_h")
    )


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot, s_rank, k``: which source a slot belongs to and its rank among that source's slots."""
    spark = targets.sparkSession
    words = F.round("target").cast("long")
    epochs, rest = F.floor(words / F.col("source_size")), words % F.col("source_size")
    quota = epochs * F.ceil(F.col("source_size") / block) + F.ceil(rest / block)
    need = targets.where("target > 0").select("s_rank", "target", quota.cast("long").alias("_quota"))
    ordered = Window.orderBy("s_rank").rowsBetween(Window.unboundedPreceding, 0)
    shares = need.withColumn("_hi", F.sum("target").over(ordered) / F.sum("target").over(Window.partitionBy()))
    shares = shares.withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("s_rank")), F.lit(0.0)))
    n_slots = need.agg(F.sum("_quota")).first()[0] or 0
    points = spark.range(n_slots).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") * CELLS).cast("int"))
    cells = shares.withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col("_lo") * CELLS).cast("int"), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1)).cast("int"))),
    ).select("_cell", "s_rank", "_lo", "_hi", "_quota")
    drawn = points.join(cells, "_cell").where("_u >= _lo AND _u < _hi").select(
        "slot", "s_rank", "_quota", F.floor(F.col("slot") / CHUNK).cast("long").alias("_chunk"), F.lit(1).alias("_one")
    )
    base = _prefix(drawn, ["s_rank"], "_chunk", "_one", "_base")
    inside = Window.partitionBy("s_rank", "_chunk").orderBy("slot")
    ranked = drawn.withColumn("_r", F.row_number().over(inside) - 1).join(base, ["s_rank", "_chunk"])
    ranked = ranked.withColumn("k", F.col("_r") + F.col("_base")).where("k < _quota").select("slot", "s_rank", "k")
    got = drawn.groupBy("s_rank").agg(F.count(F.lit(1)).alias("_got"))
    late = (
        need.join(got, "s_rank", "left")
        .withColumn("_got", F.coalesce("_got", F.lit(0)))
        .where("_got < _quota")
        .select("s_rank", F.explode(F.sequence(F.col("_got"), F.col("_quota") - 1)).alias("k"))
        .select((F.lit(n_slots) + F.col("k")).alias("slot"), "s_rank", "k")
    )
    return ranked.unionByName(late)


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_EPOCHS, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (and ``_id, _th, source``): one row per row of ``docs``."""
    sizes = staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *row_id()),
        "mix_sizes",
    )
    targets = staged(source_targets(sizes, weights, cap), "mix_targets")
    rows = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = shuffled_positions(rows, seed)
    last = F.when(F.col("size") > 0, F.floor((F.col("_start") + F.col("size") - 1) / block)).otherwise(F.lit(-1))
    first = F.when(F.col("size") > 0, F.floor(F.col("_start") / block)).otherwise(F.lit(-1))
    pieces = placed.withColumn("_block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    # Slot k of a source is its block k modulo the number of blocks; the last slot is cut to the target.
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    short = F.col("source_size") - (blocks - 1) * block  # words of the last block
    words = F.round("target").cast("long")
    per_epoch = F.col("source_size")
    slots = schedule(targets, block).join(targets.select("s_rank", "source_size", "target"), "s_rank")
    slots = slots.withColumn("_block", F.col("k") % blocks).withColumn(
        "_from", F.floor(F.col("k") / blocks) * per_epoch + F.col("_block") * block
    )
    width = F.when(F.col("_block") == blocks - 1, short).otherwise(F.lit(block))
    slots = slots.withColumn("_cut", F.greatest(F.lit(0), F.least(width, words - F.col("_from")))).select("s_rank", "_block", "_cut")
    begin = F.greatest(F.col("_start"), F.col("_block") * block) - F.col("_block") * block
    stop = F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * block) - F.col("_block") * block
    hit = F.greatest(F.lit(0), F.least(stop, F.coalesce("_cut", F.lit(0))) - begin)
    return (
        pieces.join(slots, ["s_rank", "_block"], "left")
        .groupBy("s_rank", "_bucket", "_n")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "_id", "_th")],
            F.sum(F.when(F.col("_block") >= 0, hit).otherwise(F.lit(0))).cast("long").alias("taken"),
        )
        .select("doc_id", "size", "source_size", "target", "taken", "_id", "_th")
    )
