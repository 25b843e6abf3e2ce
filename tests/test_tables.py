from pyspark.sql import functions as F

from nearfold.operators import knn
from nearfold.operators import tables as TB


def test_toy_insert_then_knn(spark, toy, tmp_path):
    """D4 on the toy table: literal inserts, then the golden L2 query."""
    path = str(tmp_path / "toy")
    TB.create_or_replace(toy.limit(0), path)
    TB.append(toy, path)
    items = spark.read.parquet(path)
    assert [r["id"] for r in knn.knn_single(items, [3, 1, 2], 5, "l2").collect()] == [2, 1, 4, 8, 10]
    assert TB.pk_violations(items).count() == 0


def test_append_missing_is_idempotent(spark, toy, tmp_path):
    path = str(tmp_path / "t")
    TB.create_or_replace(toy.where("id <= 4"), path)
    assert TB.append_missing(spark, toy.where("id <= 7"), path) == 3
    assert TB.append_missing(spark, toy, path) == 3
    assert TB.append_missing(spark, toy, path) == 0
    back = spark.read.parquet(path)
    assert back.count() == 10 and TB.pk_violations(back).count() == 0


def test_append_checked_rejects_by_reason(spark, toy, tmp_path):
    path = str(tmp_path / "c")
    TB.create_or_replace(toy.where("id <= 2"), path)
    nan = float("nan")
    rows = [(1, [1.0, 2.0, 3.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (4, None), (5, [nan, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
            (6, [1.0, 1.0, 1.0]), (6, [2.0, 1.0, 1.0])]
    bad = TB.append_checked(spark, spark.createDataFrame(rows, toy.schema), path, str(tmp_path / "bad"), 3)
    assert sorted((r["id"] or 0, r["reason"]) for r in bad.collect()) == [
        (0, "null_key"), (1, "known_key"), (3, "dimension"), (4, "null"), (5, "nan"), (6, "repeated_key")]
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 6]
    empty = spark.createDataFrame([], toy.schema)
    assert TB.append_checked(spark, empty, path, str(tmp_path / "none"), 3).count() == 0


def test_load_checked_raises_on_mismatch(spark, toy, tmp_path):
    out = TB.load_checked(toy, str(tmp_path / "ok"), 10)
    assert out.first()["count_ok"]
    try:
        TB.load_checked(toy, str(tmp_path / "bad"), 11)
    except AssertionError:
        pass
    else:
        raise AssertionError("mismatch not detected")


def folder_bytes(path):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_deletes_write_bitmaps_only_and_reads_honour_them(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.range(200_000).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("embedding"))
    TB.create_or_replace(rows.repartition(3), path)
    data = folder_bytes(path)
    assert TB.delete_rows(spark, path, F.col("id") < 0) == 0 and folder_bytes(path) == data
    assert TB.delete_rows(spark, path, F.col("id") == 77) == 1
    assert folder_bytes(path) - data < 20_000
    assert TB.delete_rows(spark, path, F.col("id").isin(77, 78) | (F.col("id") >= 150_000)) == 50_001
    assert TB.delete_rows(spark, path, F.when(F.col("id") < 5, None).otherwise(F.col("id") < 10)) == 5
    assert folder_bytes(path) - data < 100_000
    want = [i for i in range(150_000) if i not in (77, 78) and not 5 <= i < 10]
    for limit in (1 << 30, 0):  # broadcast bitmaps, or joined by file and bucket
        live = TB.read_live(spark, path, limit)
        assert live.columns == ["id", "embedding"]
        assert sorted(r.id for r in live.select("id").collect()) == want
    assert spark.read.parquet(path).count() == 200_000
    TB.append(rows.where("id < 10"), path)  # new files have no bitmaps
    assert TB.read_live(spark, path).count() == len(want) + 10
    packed = TB.compact(spark, path, str(tmp_path / "packed"))
    assert packed.count() == len(want) + 10 and TB.read_live(spark, str(tmp_path / "packed")).count() == len(want) + 10


def test_deletes_in_partitioned_and_empty_tables(spark, toy, tmp_path):
    path = str(tmp_path / "p")
    TB.create_or_replace(toy.withColumn("list_id", F.col("id") % 3).coalesce(1), path, ["list_id"])
    assert TB.delete_rows(spark, path, (F.col("list_id") == 1) & (F.col("id") > 4)) == 2
    assert sorted(r.id for r in TB.read_live(spark, path).collect()) == [1, 2, 3, 4, 5, 6, 8, 9]
    none = str(tmp_path / "none")
    TB.create_or_replace(toy.limit(0), none)
    assert TB.delete_rows(spark, none, F.lit(True)) == 0 and TB.read_live(spark, none).count() == 0


def test_compaction_keeps_rows(spark, toy, tmp_path):
    frag = str(tmp_path / "frag")
    toy.withColumn("list_id", F.col("id") % 2).repartition(10).write.partitionBy("list_id").parquet(frag)
    before = TB.file_count(spark.read.parquet(frag))
    comp = TB.compact(spark, frag, str(tmp_path / "comp"), "list_id")
    assert comp.count() == 10 and TB.file_count(comp) < before
    st = TB.state(toy, 6).first()
    assert (st["n_rows"], st["n_inserted"]) == (10, 5)


def test_index_catalog_swaps_versions(spark, toy, tmp_path):
    from nearfold.operators.catalog import ConcurrentCommit, IndexCatalog

    cat = IndexCatalog(spark, str(tmp_path / "cat"))
    assert cat.version() == 0 and cat.active("a") is None and cat.history().count() == 0 and not cat.drop("a")

    def write(rows):
        def run(path):
            rows.write.parquet(path)
            return rows.count()

        return run

    one = cat.build("a", "lists", {"lists": 3}, write(toy), 10)
    other = cat.build("b", "graph", {"m": 16}, write(toy), 10)
    assert cat.active("a").index_id == one.index_id and one.size_bytes > 0
    for bad in (write(toy.limit(4)), lambda path: 1 / 0):
        try:
            cat.build("a", "lists", {"lists": 5}, bad, 10)
        except (AssertionError, ZeroDivisionError):
            pass
        else:
            raise AssertionError("a failed build was committed")
        assert cat.version() == 2 and cat.active("a").index_id == one.index_id
    two = cat.build("a", "graph", {"m": 8}, write(toy), 10)
    assert cat.active("a").index_id == two.index_id and cat.active("a", 2).index_id == one.index_id
    assert spark.read.parquet(cat.active("a", 1).path).count() == 10  # older versions stay readable
    assert cat.drop("a") and cat.active("a") is None and cat.active("b").index_id == other.index_id
    status = {r.index_id: (r.status, r.since, r.until) for r in cat.snapshot().collect()}
    assert status == {one.index_id: ("replaced", 1, 3), two.index_id: ("dropped", 3, 4), other.index_id: ("active", 2, None)}
    assert cat.history().groupBy("version", "table").agg(F.count_if(F.col("status") == "active").alias("n")).where("n > 1").count() == 0
    try:
        cat._commit(2, cat.snapshot(2))
    except ConcurrentCommit:
        pass
    else:
        raise AssertionError("an old writer overwrote a version")


def test_logs_with_and_without_header(spark, tmp_path):
    """The reference's CSV logs come with and without a header: an explicit schema reads both."""
    from nearfold.sources import textio

    rows = [("ivf", 0, 0, 300, "no_rebuild", 0.61, None, None, None, None),
            ("ivf", 50, 150, 450, "post_rebuild", 0.6, None, None, None, None)]
    df = spark.createDataFrame(rows, textio.MAINTENANCE_LOG)
    for header in (True, False):
        path = str(tmp_path / f"log_{header}")
        df.write.options(header=str(header).lower()).csv(path)
        back = textio.read_csv_log(spark, path, textio.MAINTENANCE_LOG, header)
        assert sorted(back.collect()) == sorted(df.collect())
    build = spark.createDataFrame([("items_1m", "graph", "m=32,ef_construction=128", 1.5, 10)], textio.BUILD_LOG)
    path = str(tmp_path / "build")
    build.write.options(header="true", quote='"', escape='"').csv(path)
    assert textio.read_csv_log(spark, path, textio.BUILD_LOG, True).first()["params"] == "m=32,ef_construction=128"


def test_benchmark_run_appends_query_log(spark, tmp_path):
    from nearfold.plans import studies as ST
    from nearfold.plans.splits import splits

    sp = splits(spark, "/root/testdata/sf0.001")
    idx = ST.pivot_index(sp)
    from nearfold.operators import ivf

    log = str(tmp_path / "qlog")
    truth = ST.exact(sp)
    ST.benchmark_run(lambda: ivf.search(idx, sp.queries, 10, idx.lists), truth, "items", "ivf_pivot", idx.lists, 10,
                     sp.n_q, log)
    out = ST.benchmark_run(lambda: ivf.search(idx, sp.queries, 10, 1), truth, "items", "ivf_pivot", 1, 10, sp.n_q, log)
    rows = {r["param"]: r for r in out.collect()}
    assert len(rows) == 2 and rows[idx.lists]["mean_recall"] == 1.0 and rows[1]["mean_recall"] < 1.0
    assert rows[1]["qps"] > 0 and rows[1]["p95_latency_ms"] is None


def test_stage_cache_reuses_a_finished_snapshot(spark, toy, tmp_path):
    """A stage with _SUCCESS is read back, not recomputed."""
    from nearfold.plans.corpus import staged

    path = str(tmp_path / "stage")
    first = staged(spark, path, lambda: toy)
    assert first.count() == 10

    def must_not_run():
        raise AssertionError("stage recomputed although its snapshot exists")

    again = staged(spark, path, must_not_run)
    assert sorted(again.collect()) == sorted(first.collect())


def test_spread_only_touches_under_partitioned_scans(spark):
    from nearfold.session import spread

    cores = spark.sparkContext.defaultParallelism
    few = spark.range(100).coalesce(1)
    assert spread(few).rdd.getNumPartitions() == cores
    many = spark.range(100).repartition(cores * 2)
    assert spread(many) is many


def test_path_exists_needs_the_success_marker(spark, tmp_path):
    from nearfold.session import path_exists

    p = str(tmp_path / "snap")
    assert not path_exists(spark, p)
    spark.range(3).write.parquet(p)
    assert path_exists(spark, p) and path_exists(spark, "file://" + p)
    import os

    half = str(tmp_path / "half")  # a folder with data files but no _SUCCESS: a job that did not finish
    os.makedirs(half)
    with open(os.path.join(half, "part-00000.parquet"), "wb") as f:
        f.write(b"PAR1")
    assert not path_exists(spark, half) and not path_exists(spark, "file://" + half)
