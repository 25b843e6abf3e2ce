from pyspark.sql import Window
from pyspark.sql import functions as F

from nearfold.operators import sampling as S
from nearfold.operators.indexing import dense_index
from nearfold.plans.splits import sizes


def python_rule(rows):
    """The reference's rule in plain Python: collapse whitespace, split on ". ", strip, 20 < len < 300."""
    out = []
    for doc_id, text in rows:
        if text is None:
            continue
        for pos, piece in enumerate(" ".join(text.split()).split(". ")):
            p = piece.strip()
            if 20 < len(p) < 300:
                out.append((doc_id, pos, p))
    return out


def test_boundary_sentences(spark):
    """only trimmed lengths 21..299 survive; whitespace collapses like str.split()."""
    text1 = ". ".join(["a" * n for n in (19, 20, 21, 299, 300)])
    text2 = "word\tword\n\nword\u00a0word \u2003 " + "b" * 25 + ". "  # tabs, blank lines, no-break/em spaces
    text3 = "c" * 30 + "." + "d" * 30  # a dot without a space does not split
    text4 = "\x1cx" * 12 + ". " + "e" * 22  # information separators are whitespace to str.split()
    rows = [(1, text1), (2, text2), (3, text3), (4, ""), (5, None), (6, text4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["pos"], r["text"]) for r in S.sentences(docs).orderBy("doc_id", "pos").collect()]
    assert got == python_rule(rows)
    assert [len(t) for d, _p, t in got if d == 1] == [21, 299]


def test_python_rule_on_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = python_rule([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])
    got = [(r["doc_id"], r["pos"], r["text"]) for r in S.sentences(docs).orderBy("doc_id", "pos").collect()]
    assert got == expected


def test_dense_index_is_consecutive_and_restarts_per_group(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    out = dense_index(df, ["k"], "idx", num_partitions=6).orderBy("k").collect()
    assert [r["idx"] for r in out] == list(range(5000))
    grouped = dense_index(df, ["k"], "idx", partition_cols=["g"], num_partitions=5)
    w = Window.partitionBy("g").orderBy("k")
    check = grouped.withColumn("rn", F.row_number().over(w) - 1).where(F.col("rn") != F.col("idx")).count()
    assert check == 0


def test_split_sizes_and_nesting():
    assert sizes(500) == (300, 150, 50)
    assert sizes(2000) == (1200, 600, 200)


def test_tiers_nest_and_queries_disjoint(spark):
    from nearfold.plans.splits import splits

    sp = splits(spark, "/root/testdata/sf0.001")
    t = {n: set(r["pool_pos"] for r in sp.tier(n).collect()) for n in sp.tier_sizes}
    a, b, c = sp.tier_sizes
    assert t[a] <= t[b] <= t[c] and [len(t[x]) for x in (a, b, c)] == [a, b, c]
    q = set(r["pool_pos"] for r in sp.queries.collect())
    ins = set(r["pool_pos"] for r in sp.inserts.collect())
    assert not (q & t[c]) and not (ins & t[c]) and not (q & ins)
    ids = sorted(r["id"] for r in sp.tier(b).collect())
    assert ids == list(range(b))


def test_only_the_stages_asked_for_are_stored(spark, tmp_path):
    """The permutation stores positions, not texts, and no tiers; texts are stored once, in corpus order."""
    from nearfold.plans import catalog
    from nearfold.plans.corpus import corpus
    from nearfold.session import path_exists

    rows = [(i % 37, f"Sentence number {i} goes here. And another one, {i * 7}, follows it closely! Is a third one {i} long enough?") for i in range(60)]
    spark.createDataFrame([*rows, (None, rows[0][1]), (99, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["permutation"](spark, str(tmp_path)).collect()
    c = corpus(spark, str(tmp_path))
    assert sorted(r["pool_pos"] for r in got) == sorted(r["perm_rank"] for r in got) == list(range(c.pool_rows))
    assert not path_exists(spark, f"{c.root}/tiers") and spark.read.parquet(f"{c.root}/ranks").columns == ["pool_pos", "perm_rank"]
    numbered = c.numbered.orderBy("pool_pos").collect()
    assert [r["pool_pos"] for r in numbered] == list(range(c.n_sentences))
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0, r["pos"]) for r in numbered]
    assert keys == sorted(keys)
    text = {r["pool_pos"]: r["text"] for r in numbered}
    tiers = c.tiers().collect()
    assert path_exists(spark, f"{c.root}/tiers") and all(text[r["pool_pos"]] == r["text"] for r in tiers)
    assert len(tiers) == sum(c.tier_sizes) and {r["tier"] for r in tiers} == set(c.tier_sizes)
