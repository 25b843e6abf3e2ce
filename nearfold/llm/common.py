"""Helpers shared by the operators: tables, staged results, bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.session import scratch_path, ship_package

#: White space of the word rule ``[^\x20\x09-\x0D]+``: these six ASCII characters and nothing else.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch handed to a Python worker, whatever the length of the rows.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    This cuts the lineage at a table that survives lost executors, and lets
    several later steps read one result instead of computing it again."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound the Arrow batches by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_id(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``(_id, _th)``: identifies a row by its id and a hash of its text.

    Ids may be null (sorted last) or repeated; equal rows get equal keys."""
    return [
        F.coalesce(F.col(doc_id), F.lit((1 << 63) - 1)).cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"),
    ]


def keep_rows(docs: DataFrame, keep: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose :func:`row_id` is in ``keep``; ``once``: each such row a single time."""
    key = [c.alias(f"__nf{i}") for i, c in enumerate(row_id())]
    out = docs.select("*", *key).join(
        keep.select(F.col("_id").alias("__nf0"), F.col("_th").alias("__nf1")), ["__nf0", "__nf1"], "left_semi"
    )
    if once:
        out = out.dropDuplicates(["__nf0", "__nf1"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
