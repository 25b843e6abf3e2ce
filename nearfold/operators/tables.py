"""Vector tables as parquet folders.

Create/replace is an overwrite of the directory; appends add files.  A delete
adds deletion vectors: bitmaps over the row positions of a file, one row per
32,768 positions that hold a deleted row, in ``_deletes`` beside the data.  It
writes bytes in proportion to the deleted rows and no data file; ``read_live``
merges the bitmaps into a scan, ``compact`` folds them in.  Key uniqueness,
which a database enforces on insert, becomes a checked invariant here, and
idempotent appends use an anti join on the key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfold.functions import vectors as V
from nearfold.session import path_exists, reliable_checkpoint

TARGET_FILE_BYTES = 128 << 20


def create_or_replace(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as the only content of ``path`` (D1) and return the read-back table."""
    w = df.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def load_checked(df: DataFrame, path: str, expected: dict | int | None = None,
                 group_col: str | None = None) -> DataFrame:
    """Bulk load, then count what landed.

    Returns (group, n_rows, n_expected, count_ok); raises when a count differs."""
    spark = df.sparkSession
    back = create_or_replace(df, path, [group_col] if group_col else ())
    if group_col:
        counts = back.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_rows"))
    else:
        counts = back.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_g", F.lit(0))
        group_col = "_g"
    if isinstance(expected, int):
        expected = {0: expected}
    exp = spark.createDataFrame([(int(k), int(v)) for k, v in (expected or {}).items()],
                                f"{group_col} long, n_expected long")
    out = counts.withColumn(group_col, F.col(group_col).cast("long")).join(exp, group_col, "full")
    out = out.withColumn("count_ok", F.coalesce(F.col("n_rows") == F.col("n_expected"), F.lit(False)))
    bad = out.where(~F.col("count_ok")).limit(1).collect()
    if bad:
        raise AssertionError(f"load count mismatch at {path}: {bad[0].asDict()}")
    return out


def pk_violations(df: DataFrame, key: str = "id") -> DataFrame:
    """Keys held by more than one row (D3)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") > 1)


def append(df: DataFrame, path: str) -> None:
    """Plain append."""
    df.write.mode("append").parquet(path)


def append_checked(spark: SparkSession, rows: DataFrame, path: str, rejected_path: str, dim: int,
                   key: str = "id", vec: str = "embedding") -> DataFrame:
    """Append the rows that a vector column of ``dim`` components under a primary key admits (V9, D3).

    The others go to ``rejected_path`` with a ``reason``, the first that holds:
    ``null_key``, ``null``, ``dimension``, ``nan``, ``repeated_key`` (of the
    good rows of one key the first by vector hash stays), ``known_key`` (the
    table has it).  Returns the rejected table."""
    fault = (
        F.when(F.col(key).isNull(), "null_key")
        .when(F.col(vec).isNull(), "null")
        .when(F.size(vec) != dim, "dimension")
        .when(V.has_nan(vec), "nan")
    )
    # faulty rows, null keys among them, are dealt by their hash: only good rows of one key need to meet
    part = F.when(F.col("reason").isNotNull(), F.xxhash64(*rows.columns))
    one = Window.partitionBy(key, F.col("reason").isNull(), part).orderBy(F.xxhash64(vec))
    judged = rows.withColumn("reason", fault).withColumn("_nf_nth", F.row_number().over(one))
    known = spark.read.parquet(path).select(F.col(key).alias("_nf_known"))
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(F.col("_nf_nth") > 1, "repeated_key"))).drop("_nf_nth")
    judged = judged.join(known.distinct(), F.col(key) == F.col("_nf_known"), "left")
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(F.col("_nf_known").isNotNull(), "known_key"))).drop("_nf_known")
    # both writes read one result, made before the table changes
    judged = reliable_checkpoint(judged)
    judged.where(F.col("reason").isNotNull()).write.mode("append").parquet(rejected_path)
    append(judged.where(F.col("reason").isNull()).drop("reason"), path)
    return spark.read.schema(judged.schema).parquet(rejected_path)


def offset_range(inserts: DataFrame, start: int, end: int, offset: int, seq_col: str = "seq") -> DataFrame:
    """Insert-pool rows [start, end) with ids offset + seq."""
    return inserts.where((F.col(seq_col) >= start) & (F.col(seq_col) < end)).withColumn(
        "id", F.lit(offset) + F.col(seq_col)
    )


def append_missing(spark: SparkSession, rows: DataFrame, path: str, key: str = "id") -> int:
    """Idempotent (resumable) append (D6): only rows whose key is not yet in the table.

    Safe after a partial earlier run and with gaps, unlike resuming from a count;
    of incoming rows with one key, one is appended.
    Returns the number of rows appended."""
    existing = spark.read.parquet(path).select(key)
    todo = rows.dropDuplicates([key]).join(existing, key, "left_anti")
    # materialise the anti join before writing into the table it reads from
    todo = reliable_checkpoint(todo)
    n = todo.count()
    if n:
        append(todo, path)
    return n


#: Bytes of bitmaps that a scan may broadcast; more are joined by file and bucket.
MAX_BITMAP_BYTES = 64 << 20
#: Bytes of one bitmap of Spark's ``bitmap_construct_agg``.
_BITMAP = 4096
_DELETES = "file string, bucket long, bits binary"


def _deletes(spark: SparkSession, path: str) -> DataFrame | None:
    """One bitmap per file and bucket over all deletes so far; None without any."""
    folder = f"{path}/_deletes"
    if not path_exists(spark, folder):
        return None
    return spark.read.schema(_DELETES).parquet(folder).groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _with_positions(spark: SparkSession, path: str) -> DataFrame:
    row = F.col("_metadata.row_index")
    return spark.read.parquet(path).select(
        "*",
        F.col("_metadata.file_path").alias("_nf_file"),
        F.bitmap_bucket_number(row).alias("_nf_bucket"),
        F.bitmap_bit_position(row).alias("_nf_bit"),
    )


def _live(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The rows that no bitmap marks, with their positions."""
    rows, dead = _with_positions(spark, path), _deletes(spark, path)
    if dead is None:
        return rows
    dead = dead.select(F.col("file").alias("_nf_file"), F.col("bucket").alias("_nf_bucket"), F.col("bits").alias("_nf_bits"))
    if spark.read.parquet(f"{path}/_deletes").count() * _BITMAP <= limit:
        dead = F.broadcast(dead)
    octet = F.conv(F.hex(F.expr("substring(_nf_bits, cast(_nf_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = F.expr("shiftright(_nf_octet, cast(_nf_bit % 8 as int)) & 1") == 1
    joined = rows.join(dead, ["_nf_file", "_nf_bucket"], "left").withColumn("_nf_octet", octet)
    return joined.where(F.col("_nf_bits").isNull() | ~marked).drop("_nf_bits", "_nf_octet")


def read_live(spark: SparkSession, path: str, limit: int = MAX_BITMAP_BYTES) -> DataFrame:
    """The table without its deleted rows."""
    if not path_exists(spark, f"{path}/_deletes"):
        return spark.read.parquet(path)
    return _live(spark, path, limit).drop("_nf_file", "_nf_bucket", "_nf_bit")


def delete_rows(spark: SparkSession, path: str, cond: Column, limit: int = MAX_BITMAP_BYTES) -> int:
    """``DELETE WHERE cond`` (D7): adds deletion vectors; returns the number of rows that are now gone.

    A condition that is null for a row keeps it.  Files are only read where
    their statistics let the condition hold."""
    # both the count and the write read one result, made before the table changes
    gone = reliable_checkpoint(
        _live(spark, path, limit)
        .where(F.coalesce(cond, F.lit(False)))
        .groupBy(F.col("_nf_file").alias("file"), F.col("_nf_bucket").alias("bucket"))
        .agg(F.bitmap_construct_agg("_nf_bit").alias("bits"))
    )
    n = gone.agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0
    if n:
        gone.write.mode("append").parquet(f"{path}/_deletes")
    return n


def state(df: DataFrame, offset: int, key: str = "id", group_cols: Sequence[str] = ()) -> DataFrame:
    """``count(*)`` and ``count(*) WHERE id >= offset``."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(key) >= offset).alias("n_inserted")
    )


def compact(spark: SparkSession, path: str, out_path: str, partition_col: str | None = None,
            target_file_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """Rewrite a table without its deleted rows into files of about ``target_file_bytes``.

    The writer count comes from the bytes on disk; a range repartition on
    (partition_col, id) keeps each partition's rows together and contiguous,
    so most tasks write a single file, and a huge partition is still cut over
    several writers instead of one."""
    df = read_live(spark, path)
    n = max(1, math.ceil(size_bytes(spark, path) / target_file_bytes))
    keys = ([partition_col] if partition_col else []) + ["id"]
    w = df.repartitionByRange(n, *keys).write.mode("overwrite")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(out_path)
    return spark.read.parquet(out_path)


def file_count(df: DataFrame) -> int:
    return len(df.inputFiles())


def size_bytes(spark: SparkSession, path: str) -> int:
    """Sum of data file lengths under ``path`` via the binaryFile reader (content not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(path)
    return int(files.agg(F.sum("length")).first()[0] or 0)
