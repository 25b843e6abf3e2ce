"""Stream-shaped behaviours as Structured Streaming jobs (ST1-ST3).

All of them follow a time log (:mod:`nearfold.sources.timelog`), slice by slice.

* ``ingest``: each micro-batch of vectors gets its id (offset + counter) and its
  list (nearest frozen centroid, stateless map) and is appended to the postings,
  partitioned by list; the checkpoint makes a restart add nothing twice.
* ``lookups``: queries arrive; ``foreachBatch`` searches each micro-batch
  against the postings committed so far and appends the results.
* ``windows``: an operation log, a 1-minute watermark and 60-second windows per
  profile, kept in state by ``transformWithState`` and written when an event-time
  timer closes them.  The log's end marker fires the timers that are left, so the
  report covers every event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from nearfold.operators import ivf
from nearfold.session import scratch_path
from nearfold.sources import timelog

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _postings_sink(rows: DataFrame, centroids: DataFrame, out_path: str, checkpoint: str):
    assigned = ivf.assign(rows, centroids).select("list_id", "id", "vec_ix", "embedding", "centroid_distance")
    return (
        assigned.writeStream.format("parquet")
        .option("checkpointLocation", f"{checkpoint}/query")
        .partitionBy("list_id")
        .trigger(availableNow=True)
        .start(out_path)
    )


def ingest(spark: SparkSession, log: str, centroids: DataFrame, out_path: str, checkpoint: str, offset: int,
           pool_size: int, slice_bytes: int = timelog.SLICE_BYTES) -> int:
    """ST1: stream the log's vectors (``t`` is the insert counter) into list-partitioned postings."""

    def start(stream: DataFrame):
        rows = stream.select(
            (F.lit(offset) + F.col("t")).alias("id"),
            F.pmod(F.col("t"), F.lit(pool_size)).alias("vec_ix"),  # cyclic reuse of the pool
            "embedding",
        )
        return _postings_sink(rows, centroids, out_path, checkpoint)

    return timelog.follow(spark, log, checkpoint, start, slice_bytes)


def cyclic_ingest(spark: SparkSession, log: str, pool: DataFrame, centroids: DataFrame, out_path: str,
                  checkpoint: str, offset: int, slice_bytes: int = timelog.SLICE_BYTES) -> int:
    """ST1 with cyclic vectors: a stream of write counters (``t``) picks vector
    ``counter mod pool_size`` from the static pool (stream-static equi join on
    the pool index), gets id ``offset + counter`` and its list, and is appended
    to the list-partitioned sink.  ``pool`` has (seq, embedding), seq 0..n-1."""
    n_pool = pool.count()

    def start(stream: DataFrame):
        writes = stream.select(F.col("t").alias("counter"), F.pmod(F.col("t"), F.lit(n_pool)).alias("seq"))
        rows = writes.join(pool.select("seq", "embedding"), "seq").select(
            (F.lit(offset) + F.col("counter")).alias("id"), F.col("seq").alias("vec_ix"), "embedding")
        return _postings_sink(rows, centroids, out_path, checkpoint)

    return timelog.follow(spark, log, checkpoint, start, slice_bytes)


def lookups(spark: SparkSession, log: str, index_path: str, centroids: DataFrame, lists: int,
            out_path: str, checkpoint: str, k: int, probes: int, slice_bytes: int = timelog.SLICE_BYTES) -> int:
    """ST2: every micro-batch of queries (``t`` is the query id) is searched against the committed postings."""

    def search_batch(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        # the file sink's metadata log lists committed files only
        post = spark.read.parquet(index_path).select("list_id", "id", "embedding")
        idx = ivf.IvfIndex(centroids, post, lists, "cosine", path=index_path)
        res = ivf.search(idx, batch.select(F.col("t").alias("qid"), "embedding"), k, probes)
        # a batch that runs again replaces what its first run left
        res.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    def start(stream: DataFrame):
        return (
            stream.writeStream.foreachBatch(search_batch)
            .option("checkpointLocation", f"{checkpoint}/query")
            .trigger(availableNow=True)
            .start()
        )

    return timelog.follow(spark, log, checkpoint, start, slice_bytes)


def to_micros(col: str = "ts"):
    """TIMESTAMP_NTZ -> microseconds since the epoch, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {col})")


#: Length of the time range whose windows share one state, and the number of states a profile's range is dealt to.
STATE_RANGE_SECONDS = 7 * 86_400
STATE_PARTS = 4
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = "window_us long, profile string, is_read boolean, latency_ms double, n long"


class WindowCounts(StatefulProcessor):
    """Counts of (window, read or write, latency) of the open windows of one profile, time range and part.

    State: one row per distinct value of an open window.  A timer stands at the
    end of the earliest open window; when it fires, all windows that the
    watermark has passed are written out and the next timer is set."""

    columns = ["window_us", "is_read", "latency_ms"]

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "window_us array<long>, is_read array<boolean>, latency_ms array<double>, n array<long>")

    def _held(self) -> pd.DataFrame:
        held = self.open.get() or ([], [], [], [])
        return pd.DataFrame(dict(zip([*self.columns, "n"], map(list, held))))

    def _keep(self, rows: pd.DataFrame) -> None:
        """Store the open windows and set the timer of the earliest one (a timer left over finds nothing to write)."""
        if not len(rows):
            self.open.clear()
            return
        latency = [None if pd.isna(x) else float(x) for x in rows["latency_ms"]]
        self.open.update((rows["window_us"].astype("int64").tolist(), rows["is_read"].astype(bool).tolist(), latency, rows["n"].astype("int64").tolist()))
        self.handle.registerTimer((int(rows["window_us"].min()) + self.window_us) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        fresh = pd.concat([r[self.columns].assign(n=1) for r in rows])
        if key[0] is None:  # an end marker
            return iter([])
        held = self._held()
        both = pd.concat([held, fresh]) if len(held) else fresh
        self._keep(both.groupby(self.columns, dropna=False, as_index=False)["n"].sum())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = self._held()
        closed = held["window_us"] + self.window_us <= timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(held[~closed])
        out = held[closed]
        if len(out):
            yield out.assign(profile=key[0])[["window_us", "profile", "is_read", "latency_ms", "n"]].astype({"window_us": "int64", "n": "int64"})


def window_counts(stream: DataFrame, window_seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """ST3 as stateful processing: rows (``t`` in microseconds, ``profile, is_read, latency_ms``) to
    the counts of the windows that close.  Rows without profile (end markers) only move the watermark;
    a filter would be pushed below the watermark, so the processor drops them."""
    size = window_seconds * 1_000_000
    rows = (
        stream.withColumn("event_time", F.timestamp_micros("t"))
        .withWatermark("event_time", delay)
        .select(
            "profile",
            F.floor(F.col("t") / (STATE_RANGE_SECONDS * 1_000_000)).cast("long").alias("range"),
            F.pmod(F.xxhash64("t", "latency_ms"), F.lit(STATE_PARTS)).cast("long").alias("part"),
            "event_time",
            (F.col("t") - F.pmod("t", F.lit(size))).alias("window_us"),
            "is_read",
            "latency_ms",
        )
    )
    return rows.groupBy("profile", "range", "part").transformWithStateInPandas(
        statefulProcessor=WindowCounts(size), outputStructType=COUNTS, outputMode="append", timeMode="eventTime"
    )


def window_report(counts: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Per (window, profile): reads, writes, their rates and exact read latencies, from the windows' counts."""
    read = F.when(F.col("is_read"), F.col("latency_ms"))
    n_read = F.sum(F.when(F.col("is_read") & F.col("latency_ms").isNotNull(), F.col("n")))
    agg = counts.groupBy("window_us", "profile").agg(
        F.sum(F.when(F.col("is_read"), F.col("n")).otherwise(0)).alias("n_reads"),
        F.sum(F.when(F.col("is_read"), 0).otherwise(F.col("n"))).alias("n_writes"),
        (F.sum(read * F.col("n")) / n_read).alias("mean_read_latency_ms"),
        F.percentile(read, 0.95, F.col("n")).alias("p95_read_latency_ms"),
        F.percentile(read, 0.99, F.col("n")).alias("p99_read_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )
    return agg.select(
        F.expr(f"timestampadd(MICROSECOND, window_us, {EPOCH_NTZ})").alias("window_start"),
        "profile", "n_reads", "n_writes", "mean_read_latency_ms", "p95_read_latency_ms", "p99_read_latency_ms", "max_latency_ms",
        (F.col("n_reads") / window_seconds).alias("read_qps"), (F.col("n_writes") / window_seconds).alias("write_throughput_per_sec"),
    )


def windows(spark: SparkSession, log: str, out_path: str, checkpoint: str, window_seconds: int = 60,
            delay_seconds: int = 60, slice_bytes: int = timelog.SLICE_BYTES) -> DataFrame:
    """ST3: follow the operation log to its end; returns the report over all of its windows."""

    def start(stream: DataFrame):
        return (
            window_counts(stream, window_seconds, f"{delay_seconds} seconds")
            .writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{checkpoint}/query")
            .trigger(availableNow=True)
            .start(out_path)
        )

    key = "spark.sql.streaming.stateStore.providerClass"  # timers need this store
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        timelog.follow(spark, log, checkpoint, start, slice_bytes, marker_after=(window_seconds + delay_seconds + 1) * 1_000_000)
    finally:
        spark.conf.set(key, before)
    return window_report(spark.read.schema(COUNTS).parquet(out_path), window_seconds)


def scratch(spark: SparkSession, name: str) -> dict:
    """Fresh log / output / checkpoint folders under the shared checkpoint dir."""
    root = scratch_path(spark, "stream", name)
    return {"log": f"{root}/log", "out": f"{root}/out", "checkpoint": f"{root}/_checkpoint"}

