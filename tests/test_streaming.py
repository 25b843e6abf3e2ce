import duckdb
from pyspark.sql import functions as F

from nearfold.operators import ivf
from nearfold.plans import studies as ST
from nearfold.plans.splits import INSERT_ID_OFFSET, splits
from nearfold.session import scratch_path
from nearfold.sources import fixtures, timelog
from nearfold.streaming import ingest as STR

SF = "/root/testdata/sf0.001"


def operations(spark):
    ops = fixtures.operation_log(spark, SF)
    return ops.select("event_id", STR.to_micros("ts").alias("t"), "profile", "is_read", "latency_ms")


def test_log_is_read_once_in_slices_and_a_restart_reads_nothing(spark):
    log = timelog.write_log(operations(spark), scratch_path(spark, "log"), ranges=6)
    d = STR.scratch(spark, "test_log")
    sizes = [f.bytes for f in spark.read.parquet(f"{log}/files").collect()]
    assert len(sizes) == 6
    batches = []

    def start(stream):
        q = stream.writeStream.format("parquet").option("checkpointLocation", d["checkpoint"] + "/q").trigger(availableNow=True).start(d["out"])
        batches.append(q)
        return q

    assert timelog.follow(spark, log, d["checkpoint"], start, slice_bytes=2 * min(sizes)) >= 3
    out = spark.read.parquet(d["out"])
    assert sorted(r.event_id for r in out.select("event_id").collect()) == sorted(r.event_id for r in operations(spark).select("event_id").collect())
    assert timelog.follow(spark, log, d["checkpoint"], start) == 0
    # A crash after the stream's commit and before the progress row: the slice runs again and reads nothing.
    again = scratch_path(spark, "again")
    assert timelog.follow(spark, log, again, lambda s: start(s)) == 1
    assert spark.read.parquet(d["out"]).count() == out.count()


def test_partitions_follow_bytes_and_ranges(spark):
    log = timelog.write_log(operations(spark), scratch_path(spark, "log"), ranges=6)
    files = spark.read.parquet(f"{log}/files").orderBy("t_min").collect()
    reader = timelog.TimeLogReader({"path": log, "until": str(files[-1].t_max + 1), "split_bytes": str(files[0].bytes * 2 + 600)}, None)
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    assert sum(len(p.files) for p in parts) == 6 and 2 <= len(parts) < 6
    middle = reader.partitions({"t": files[2].t_min}, {"t": files[3].t_min})
    assert [p.files for p in middle] == [[files[2].file]]
    assert reader.partitions(end, end) == []


def test_log_grows_between_runs_and_empty_log(spark):
    rows = spark.range(100).select(F.col("id").alias("t"), (F.col("id") * 2).alias("v"))
    log, d = scratch_path(spark, "log"), STR.scratch(spark, "grow")
    start = lambda s: s.writeStream.format("parquet").option("checkpointLocation", d["checkpoint"] + "/q").trigger(availableNow=True).start(d["out"])
    timelog.write_log(rows.where("t < 60"), log)
    timelog.follow(spark, log, d["checkpoint"], start)
    more = timelog.write_log(rows.where("t >= 60"), scratch_path(spark, "log"))
    spark.read.parquet(f"{more}/files").write.mode("append").parquet(f"{log}/files")
    assert timelog.follow(spark, log, d["checkpoint"], start) == 1
    assert sorted(r.v for r in spark.read.parquet(d["out"]).collect()) == [2 * i for i in range(100)]
    empty = timelog.write_log(rows.where("t < 0"), scratch_path(spark, "log"))
    assert timelog.follow(spark, empty, scratch_path(spark, "none"), start) == 0


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    sp = splits(spark, SF)
    d = STR.scratch(spark, "test_ingest")
    log = timelog.write_log(sp.inserts.select(F.col("seq").alias("t"), "embedding"), d["log"], ranges=4)
    cents = ivf.pivot_centroids(ST.perm_base(sp), ivf.lists_for(sp.n_base))
    assert STR.ingest(spark, log, cents, d["out"], d["checkpoint"], INSERT_ID_OFFSET, sp.n_ins, slice_bytes=1) == 4
    got = spark.read.parquet(d["out"]).select("id", "list_id")
    batch = ivf.assign(sp.inserts.select((F.lit(INSERT_ID_OFFSET) + F.col("seq")).alias("id"), "embedding"),
                       cents).select("id", "list_id")
    assert sorted(got.collect()) == sorted(batch.collect())
    assert STR.ingest(spark, log, cents, d["out"], d["checkpoint"], INSERT_ID_OFFSET, sp.n_ins) == 0
    assert spark.read.parquet(d["out"]).count() == sp.n_ins


def test_window_report_covers_every_event(spark):
    d = STR.scratch(spark, "test_windows")
    ops = operations(spark)
    log = timelog.write_log(ops, d["log"], ranges=4)
    rep = STR.windows(spark, log, d["out"], d["checkpoint"], window_seconds=36_000, slice_bytes=1)
    rows = {(r.window_start, r.profile): r for r in rep.collect()}
    assert sum(r.n_reads + r.n_writes for r in rows.values()) == ops.count()
    want = duckdb.sql(f"""
      SELECT time_bucket(INTERVAL 36000 second, ts, TIMESTAMP '1970-01-01') AS w, ['read_heavy', 'balanced', 'write_heavy'][user_id % 3 + 1] AS p,
        count_if(event_type IN ('view', 'click')) AS r, count(*) AS n,
        quantile_cont(value, 0.95) FILTER (WHERE event_type IN ('view', 'click')) AS q
      FROM '{SF}/events.parquet' GROUP BY ALL""").fetchall()
    assert len(want) == len(rows)
    for w, p, r, n, q in want:
        got = rows[w, p]
        assert (got.n_reads, got.n_reads + got.n_writes) == (r, n)
        assert (got.p95_read_latency_ms is None) == (q is None)
        assert q is None or abs(got.p95_read_latency_ms - q) < 1e-9
    # every window is written by one flush of its state: a second run adds nothing
    before = spark.read.parquet(d["out"]).count()
    STR.windows(spark, log, d["out"], d["checkpoint"], window_seconds=36_000)
    assert spark.read.parquet(d["out"]).count() == before


def test_ingest_over_several_centroid_broadcasts(spark, monkeypatch):
    sp = splits(spark, SF)
    d = STR.scratch(spark, "test_ingest_chunks")
    log = timelog.write_log(sp.inserts.select(F.col("seq").alias("t"), "embedding"), d["log"])
    cents = ivf.pivot_centroids(ST.perm_base(sp), ivf.lists_for(sp.n_base))
    rows = sp.inserts.select((F.lit(INSERT_ID_OFFSET) + F.col("seq")).alias("id"), "embedding")
    batch = ivf.assign(rows, cents).select("id", "list_id").collect()
    assign = ivf.assign
    monkeypatch.setattr(ivf, "assign", lambda items, c, **kw: assign(items, c, limit=8 * 64 * 3, **kw))
    STR.ingest(spark, log, cents, d["out"], d["checkpoint"], INSERT_ID_OFFSET, sp.n_ins)
    assert sorted(spark.read.parquet(d["out"]).select("id", "list_id").collect()) == sorted(batch)
