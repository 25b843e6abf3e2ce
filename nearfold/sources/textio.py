"""Text-table, vector-TSV and metrics-log sinks and scans.

All writers go through the DataFrame writer (one file per task, no driver
round trip); readers always pass an explicit schema, since the logs of the
reference come both with and without a header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.functions import vectors as V

TEXT_SCHEMA = "id BIGINT, text STRING"
VECTOR_TSV_SCHEMA = "id BIGINT, embedding_text STRING"

# Fixed log schemas (query benchmark, workload and maintenance logs), in the
# reference's column order, plus our run_id/params columns.
QUERY_LOG = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("index_type", T.StringType()),
        T.StructField("param", T.IntegerType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("n_queries", T.IntegerType()),
        T.StructField("qps", T.DoubleType()),
        T.StructField("mean_latency_ms", T.DoubleType()),
        T.StructField("p95_latency_ms", T.DoubleType()),
        T.StructField("p99_latency_ms", T.DoubleType()),
        T.StructField("mean_recall", T.DoubleType()),
    ]
)
WORKLOAD_LOG = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("index_type", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("read_ratio", T.DoubleType()),
        T.StructField("write_ratio", T.DoubleType()),
        T.StructField("duration_sec", T.IntegerType()),
        T.StructField("n_workers", T.IntegerType()),
        T.StructField("read_qps", T.DoubleType()),
        T.StructField("mean_read_latency_ms", T.DoubleType()),
        T.StructField("p95_read_latency_ms", T.DoubleType()),
        T.StructField("p99_read_latency_ms", T.DoubleType()),
        T.StructField("write_throughput_per_sec", T.DoubleType()),
        T.StructField("total_writes", T.LongType()),
    ]
)
MAINTENANCE_LOG = T.StructType(
    [
        T.StructField("index_type", T.StringType()),
        T.StructField("checkpoint_pct", T.IntegerType()),
        T.StructField("cumulative_inserts", T.LongType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("phase", T.StringType()),
        T.StructField("mean_recall", T.DoubleType()),
        T.StructField("qps", T.DoubleType()),
        T.StructField("mean_latency_ms", T.DoubleType()),
        T.StructField("p95_latency_ms", T.DoubleType()),
        T.StructField("p99_latency_ms", T.DoubleType()),
    ]
)
BUILD_LOG = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("index_type", T.StringType()),
        T.StructField("params", T.StringType()),
        T.StructField("build_time_sec", T.DoubleType()),
        T.StructField("size_bytes", T.LongType()),
    ]
)

_CSV_OPTS = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_text_table(df: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    """``id,text`` CSV with header, RFC-4180 quoting."""
    (
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .write.mode("overwrite")
        .options(header="true", **_CSV_OPTS)
        .csv(path)
    )


def read_text_table(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Scan an ``id,text`` CSV with an explicit schema (S3)."""
    return (
        spark.read.schema(TEXT_SCHEMA)
        .options(header=str(header).lower(), multiLine="true", **_CSV_OPTS)
        .csv(path)
    )


def write_vector_tsv(df: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding") -> None:
    """``id \\t [v1,...]`` text export, one file per task."""
    (
        df.select(F.col(id_col).alias("id"), V.to_vector_text(vec_col).alias("embedding_text"))
        .write.mode("overwrite")
        .options(sep="\t", header="false", quote="")
        .csv(path)
    )


def read_vector_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Read the text export back and parse the vectors."""
    raw = spark.read.schema(VECTOR_TSV_SCHEMA).options(sep="\t", header="false", quote="").csv(path)
    return raw.withColumn("embedding", V.from_vector_text("embedding_text"))


def append_log(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Append rows to a parquet metrics log with a fixed schema."""
    if schema is not None:
        # fields the run did not measure (e.g. timings of a batch job) stay NULL
        df = df.select(
            *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
              for f in schema.fields],
            *[c for c in df.columns if c not in schema.fieldNames()],
        )
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv_log(spark: SparkSession, path: str, schema: T.StructType, header: bool) -> DataFrame:
    """The reference's CSV logs, with or without header, under a fixed schema."""
    return spark.read.schema(schema).options(header=str(header).lower(), **_CSV_OPTS).csv(path)


def scrub_log(spark: SparkSession, path: str, drop_when, out_path: str) -> DataFrame:
    """Drop rows matching ``drop_when`` into a new snapshot (S10); the old one stays."""
    kept = read_log(spark, path).where(~F.coalesce(drop_when, F.lit(False)))
    kept.write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)
