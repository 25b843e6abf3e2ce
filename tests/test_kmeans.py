import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.operators import ivf, kmeans


@pytest.fixture(scope="module")
def table(spark):
    """1,500 rows around 12 directions, and rows that are no vectors."""
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(12, 8))
    X = heads[rng.integers(0, 12, 1500)] * rng.uniform(0.5, 3, (1500, 1)) + rng.normal(size=(1500, 8)) * 0.15
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(X)]
    rows += [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] * 8), (9003, [1.0, 2.0])]
    return X, spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5).cache()


def test_shares_add_up():
    assert kmeans._shares({0: 10, 1: 1, 2: 89}, 20) == {0: 3, 1: 1, 2: 16}
    for lists in (3, 4, 7, 50):
        assert sum(kmeans._shares({0: 5, 1: 1000, 2: 3}, lists).values()) == lists
    assert kmeans._shares({}, 5) == {}


def test_training_is_deterministic_and_blocks_make_no_difference(table, monkeypatch):
    _, df = table
    one = sorted(map(tuple, kmeans.train(df, 16).collect()))
    assert [r[0] for r in one] == list(range(16)) and len({r[2] for r in one}) == 4
    monkeypatch.setattr(kmeans, "BLOCK_ROWS", 50)
    two = sorted(map(tuple, kmeans.train(df.repartition(3), 16).collect()))
    assert np.allclose([r[1] for r in one], [r[1] for r in two], atol=1e-5)
    assert np.allclose(np.linalg.norm([r[1] for r in one], axis=1), 1, atol=1e-5)


def test_assignment_goes_through_the_upper_level(table):
    X, df = table
    cents = kmeans.train(df, 16).cache()
    held = {r.id: (r.list_id, r.centroid_distance) for r in ivf.assign(df, cents).collect()}
    for limit in (1 << 20, 8 * 8 * 3):  # one broadcast, or the nodes over several
        assert {r.id: r.list_id for r in ivf.assign(df, cents, limit=limit).collect()} == {i: x[0] for i, x in held.items()}
    assert 9000 not in held and 9003 not in held and held[9001] == held[9002] == (None, None)
    rows = cents.collect()
    unit = X.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    upper = {r.node: np.array(r.upper, float) for r in rows}
    nodes = sorted(upper)
    best = np.argmax(unit @ np.array([upper[u] / np.linalg.norm(upper[u]) for u in nodes]).T, axis=1)
    for i in range(len(X)):
        own = [r for r in rows if r.node == nodes[best[i]]]
        dist = {r.list_id: 1 - unit[i] @ np.array(r.centroid, float) / np.linalg.norm(r.centroid) for r in own}
        assert abs(min(dist.values()) - held[i][1]) < 1e-6 and abs(dist[held[i][0]] - held[i][1]) < 1e-6
    # clustered rows lie near their centers
    assert np.mean([x[1] for i, x in held.items() if i < 1500]) < 0.05


def test_fewer_rows_than_lists_and_no_rows(spark, table):
    _, df = table
    few = kmeans.train(df.where("id < 3"), 16)
    assert 1 <= few.count() <= 16 and ivf.assign(df.where("id < 3"), few).where("list_id IS NULL").count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(40)], "id long, embedding array<float>")
    assert kmeans.train(same, 9).count() == 1
    assert kmeans.train(df.limit(0), 4).count() == 0
