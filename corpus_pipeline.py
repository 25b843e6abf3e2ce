"""Corpus pipeline: quality rules, exact dedup, near dedup, source mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return
the columns of ``docs``.  Each stage's result is written as Parquet to the
cluster's shared folder and read again by the next one, so a lost executor
costs the stage at hand only.  A stage's decisions are joined back to the
documents by id and text hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from nearfold.llm.common import keep_rows, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    led = quality_rules.apply_policy(quality_rules.ledger(docs))
    return keep_rows(docs, led.where("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return keep_rows(docs, exact_dedup.exact_dedup(docs).where("kept"), once=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return keep_rows(docs, ngram_join.ngram_join(docs).where("is_first"), once=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole documents."""
    plan = mixing.mix(docs).withColumn("_times", F.round(F.col("taken") / F.col("size")).cast("int"))
    return repeat_rows(docs, plan.where("size > 0 AND _times > 0"))


def repeat_rows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``plan`` (``_id, _th, _times``) says."""
    times = plan.groupBy(F.col("_id").alias("__nf0"), F.col("_th").alias("__nf1")).agg(
        F.sum("_times").alias("__nf2"), F.count(F.lit(1)).alias("__nf3")
    )
    out = docs.select("*", *[c.alias(f"__nf{i}") for i, c in enumerate(mixing.row_id())]).join(times, ["__nf0", "__nf1"])
    copies = F.expr("explode(array_repeat(0, int(ceil(__nf2 / __nf3))))").alias("__nf4")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], copies).drop("__nf4")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mixed),
    ("packing", packed),
]

#: SQL cannot express byte-level BPE ids; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_").replace("-", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
