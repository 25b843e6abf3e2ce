import math

from pyspark.sql import functions as F

from nearfold.operators import embed as EM


def test_sql_and_numpy_encoders_agree(spark):
    texts = ["Hello world. Hello again!", "", "über straße 42 x", "a", None, "¿Qué tal? 你好 世界"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    a = {r["id"]: r["embedding"] for r in df.select("id", EM.hashed_embedding("text").alias("embedding")).collect()}
    b = {r["id"]: r["embedding"] for r in EM.embed_batches(df, "text", EM.numpy_hashed_encoder(), EM.DIM).collect()}
    for i, t in enumerate(texts):
        if t is None:
            continue
        assert list(a[i]) == list(b[i]), t
        n = math.sqrt(sum(x * x for x in a[i]))
        assert len(a[i]) == EM.DIM and (n == 0 or abs(n - 1) < 1e-6)
    assert all(x == 0 for x in a[1])  # no token: zero vector


def test_rate_and_determinism(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    rate = EM.embed_and_measure(docs, "text", EM.numpy_hashed_encoder(), EM.DIM, str(tmp_path / "e"), batch_size=7)
    assert rate["rows"] == docs.count() == spark.read.parquet(str(tmp_path / "e")).count() and rate["rows_per_sec"] > 0
    assert rate["batches"] * 7 >= rate["rows"]
    none = EM.embed_and_measure(docs.limit(0), "text", EM.numpy_hashed_encoder(), EM.DIM, str(tmp_path / "none"))
    assert (none["rows"], none["batches"], none["rows_per_sec"]) == (0, 0, 0.0)
    one = docs.select("id", EM.hashed_embedding("text").alias("e")).orderBy("id").collect()
    two = docs.select("id", EM.hashed_embedding("text").alias("e")).orderBy("id").collect()
    assert one == two
    assert not any(any(math.isnan(x) for x in r["e"]) for r in one)


def test_jvm_embedding_keeps_pace_with_batches(spark):
    """The norm and the buckets are not computed again for every component (F8)."""
    import time

    from nearfold.session import spread

    texts = spread(spark.range(20_000).selectExpr("id", "concat_ws(' ', transform(sequence(1, 15), j -> concat('w', (id * j) % 997))) text")).cache()
    texts.count()

    def seconds(df):
        took = []
        for _ in range(2):
            begin = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - begin)
        return min(took)

    batches = seconds(EM.embed_batches(texts, "text", EM.numpy_hashed_encoder(), EM.DIM))
    assert seconds(texts.select("id", EM.hashed_embedding("text").alias("embedding"))) < 2.5 * batches + 0.5


def test_odd_texts_embed_alike(spark):
    texts = ["... --", "a a a a", "Ünï cödé 漢字 ١٢ x́y 𝒜b", "word " * 500, "a\x00b", "٣٤"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for dim in (3, 64):
        a = {r["id"]: r["e"] for r in df.select("id", EM.hashed_embedding("text", dim).alias("e")).collect()}
        b = {r["id"]: r["embedding"] for r in EM.embed_batches(df, "text", EM.numpy_hashed_encoder(dim), dim).collect()}
        assert a == {i: list(v) for i, v in b.items()}
    assert spark.sql("select cast(null as string) text").select(EM.hashed_embedding("text").alias("e")).first()["e"] is None
