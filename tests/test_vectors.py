import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions import vectors as V
from nearfold.operators import knn


def test_toy_l2_limit5(toy):
    out = knn.knn_single(toy, [3, 1, 2], 5, "l2").collect()
    assert [r["id"] for r in out] == [2, 1, 4, 8, 10]
    assert [round(r["distance"] ** 2) for r in out] == [6, 33, 114, 249, 438]


def test_toy_l2_with_distance(toy):
    out = knn.knn_single(toy, [1, 2, 3], 3, "l2", with_vector=True).collect()
    assert [r["id"] for r in out] == [2, 1, 4]
    assert [round(r["distance"] ** 2) for r in out] == [0, 27, 108]
    assert list(out[0]["embedding"]) == [1.0, 2.0, 3.0]


def test_pair_functions_match_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((20, 5)).astype(np.float32)
    b = rng.standard_normal((20, 5)).astype(np.float32)
    df = spark.createDataFrame([(a[i].tolist(), b[i].tolist()) for i in range(20)], "a array<float>, b array<float>")
    got = df.select(V.l2_distance("a", "b").alias("l2"), V.l1_distance("a", "b").alias("l1"),
                    V.cosine_distance("a", "b").alias("cos"), V.dot("a", "b").alias("dot"),
                    V.norm("a").alias("n")).collect()
    A, B = a.astype(np.float64), b.astype(np.float64)
    for i, r in enumerate(got):
        assert r["l2"] == pytest.approx(np.linalg.norm(A[i] - B[i]), rel=1e-12)
        assert r["l1"] == pytest.approx(np.abs(A[i] - B[i]).sum(), rel=1e-12)
        cos = 1 - A[i] @ B[i] / (np.linalg.norm(A[i]) * np.linalg.norm(B[i]))
        assert r["cos"] == pytest.approx(cos, rel=1e-9, abs=1e-12)
        assert r["dot"] == pytest.approx(A[i] @ B[i], rel=1e-12)
        assert r["n"] == pytest.approx(np.linalg.norm(A[i]), rel=1e-12)


def test_boundary_vectors(spark):
    """NULL, zero vector, NaN, wrong dimensions."""
    rows = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [float("nan"), 1.0, 1.0]), (4, [1.0, 2.0]),
            (5, [1.0, 2.0, 3.0, 4.0]), (6, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    q = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    got = {r["id"]: r for r in df.select("id", V.cosine_distance("embedding", q).alias("c"),
                                          V.l2_distance("embedding", q).alias("l2"),
                                          V.has_nan("embedding").alias("nan"),
                                          V.dims("embedding").alias("d")).collect()}
    assert got[1]["c"] is None and got[1]["l2"] is None
    assert got[2]["c"] is None  # zero vector: undefined cosine
    assert got[2]["l2"] == pytest.approx(1.0)
    assert got[3]["nan"] is True and math.isnan(got[3]["l2"])
    assert got[4]["l2"] is None and got[5]["l2"] is None  # dimension mismatch
    assert got[6]["c"] == pytest.approx(0.0)
    assert [got[i]["d"] for i in (4, 5, 6)] == [2, 4, 3]


def test_vector_text_roundtrip(spark):
    df = spark.createDataFrame([([0.1234564, -2.5, 0.0, 1e-7],)], "v array<float>")
    r = df.select(V.to_vector_text("v").alias("t")).select("t", V.from_vector_text("t").alias("back")).first()
    expected = "[" + ",".join(f"{x:.6f}" for x in np.array([0.1234564, -2.5, 0.0, 1e-7], dtype=np.float32)) + "]"
    assert r["t"] == expected
    assert list(r["back"]) == pytest.approx([0.123456, -2.5, 0.0, 0.0], abs=1e-6)
