"""Readers for the driver tables (``{sf_dir}/{name}.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def fingerprint(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Names, lengths and times of a table's files as one hash: replaced data gets a new one.

    Reads the file listing only, not the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(table_path(sf_dir, name))
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x")).first()
    return f"{row['n']}-{(row['x'] or 0) & (1 << 64) - 1:016x}"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector pool: ``pool_pos`` (= ``vec_id``), ``embedding``, ``label``."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pool_pos"), "embedding", "label"
    )


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as an operation log of reads and writes with latencies.

    Fixed mapping: view/click are reads, every other type is a write; ``value``
    is the latency in ms; ``profile`` = ``user_id % 3`` in the order below."""
    ev = load(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.col("value").alias("latency_ms"),
        F.col("event_type").isin("view", "click").alias("is_read"),
        F.element_at(F.array(*[F.lit(p) for p in PROFILES]), (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias(
            "profile"
        ),
    )


# Workload profiles in user_id % 3 order, with their read ratios.
PROFILES = ("read_heavy", "balanced", "write_heavy")
READ_RATIOS = {"read_heavy": 0.9, "balanced": 0.5, "write_heavy": 0.3}
