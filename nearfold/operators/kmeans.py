"""Two-level spherical k-means as Spark jobs (training of inverted lists, K9).

The upper level has about the square root of the lists, so n^(1/4) centers for
n rows under the rule of sqrt(n) lists.  It is trained on all rows, map-only:
its few centers are broadcast, tasks send one sum per center.  Every row then
belongs to one upper node, and the lists of a node are trained on its rows
only: rows (in blocks of bounded size) and centers meet by node in cogrouped
Arrow tasks, which send one sum per center and block.  Lower centers are rows
of a table at all times and never pass through the driver.  A row is compared
with n^(1/4) upper centers and with the n^(1/4) lists of one node, not with all
sqrt(n) lists.

Seeds are the rows with the smallest keyed hash (of all rows, then of each
node), so training is deterministic.  A level has converged when a round lowers
the total distance by less than ``TOLERANCE`` of it; distances only fall, so
this ends.  Centers without rows stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.functions import vectors as V
from nearfold.session import reliable_checkpoint, ship_package

SEED = 42
#: Least relative fall of the total distance for which another round runs.
TOLERANCE = 5e-3
#: Rows of a node that one task holds.
BLOCK_ROWS = 16_384

_SUMS = "node long, center long, total array<double>, n long, cost double"


def unit_rows(X: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return X / np.sqrt((X * X).sum(axis=1))[:, None]


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _sums(node: int, ids: np.ndarray, X: np.ndarray, C: np.ndarray, state: dict) -> None:
    """Add the rows of ``X`` to the sums of their nearest centers (ties: the first)."""
    S = X @ C.T
    near = np.argmax(S, axis=1)
    cost = np.maximum(0.0, 1.0 - S[np.arange(len(X)), near])  # rounding never makes it negative, so rounds end
    for c in np.unique(near):
        rows = near == c
        total, n, spent = state.get((node, int(ids[c])), (0.0, 0, 0.0))
        state[node, int(ids[c])] = (total + X[rows].sum(axis=0), n + int(rows.sum()), spent + float(cost[rows].sum()))


def _as_batch(state: dict) -> pa.RecordBatch:
    keys = sorted(state)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.int64()),
            pa.array([k[1] for k in keys], pa.int64()),
            pa.array([state[k][0].tolist() for k in keys], pa.list_(pa.float64())),
            pa.array([state[k][1] for k in keys], pa.int64()),
            pa.array([state[k][2] for k in keys], pa.float64()),
        ],
        names=["node", "center", "total", "n", "cost"],
    )


def _moved(sums: DataFrame, centers: DataFrame, d: int) -> DataFrame:
    """``node, center, c, cost``: centers at the mean direction of their rows."""
    parts = sums.select("node", "center", "n", "cost", F.posexplode("total").alias("i", "x")).groupBy("node", "center", "i")
    total = parts.agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    rows = total.groupBy("node", "center").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("t"), F.max("cost").alias("cost")
    )
    joined = centers.select("node", "center", F.col("c").alias("_old")).join(rows, ["node", "center"], "left")
    norm = V.norm("t")
    return joined.select("node", "center", F.when(norm > 0, F.transform("t", lambda x: x / norm)).otherwise(F.col("_old")).alias("c"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def _until_converged(centers: DataFrame, step) -> DataFrame:
    """Lloyd rounds ``step(centers) -> moved centers with the cost before the move``."""
    before = math.inf
    while True:
        centers = reliable_checkpoint(step(centers))
        cost = centers.agg(F.sum("cost")).first()[0] or 0.0
        if not cost < before - TOLERANCE * before:
            return centers.select("node", "center", "c")
        before = cost


def _shares(sizes: dict[int, int], lists: int) -> dict[int, int]:
    """Lists of each node in proportion to its rows: at least one, ``lists`` together (largest remainders)."""
    rest, total = max(0, lists - len(sizes)), max(1, sum(sizes.values()))
    exact = {u: rest * n / total for u, n in sizes.items()}
    out = {u: 1 + int(x) for u, x in exact.items()}
    for u in sorted(exact, key=lambda u: (int(exact[u]) - exact[u], u))[: max(0, lists - sum(out.values()))]:
        out[u] += 1
    return out


def train(items: DataFrame, lists: int, seed: int = SEED, vec_col: str = "embedding") -> DataFrame:
    """``list_id, centroid, node, upper``: the lists, each with its node and the node's center.

    Rows without a usable vector (null, NaN, zero, another dimension than most) are left out;
    with fewer distinct rows than lists there are fewer lists."""
    from nearfold.operators import knn

    spark = items.sparkSession
    ship_package(spark)
    d = knn.query_stats(items, vec_col)[1]
    rows = knn._valid_vectors(items, vec_col, d).where(V.norm(vec_col) > 0)
    rank = F.xxhash64(F.lit(seed), F.col(vec_col))
    rows = reliable_checkpoint(rows.select(V.normalize(vec_col).alias("x"), rank.alias("h")))
    n_upper = max(1, round(math.sqrt(lists)))
    seeds = rows.dropDuplicates(["h"]).orderBy("h").limit(n_upper).select(F.col("x").alias("c"), "h")
    upper = seeds.select(F.lit(0).cast("long").alias("node"), (F.row_number().over(Window.orderBy("h")) - 1).cast("long").alias("center"), "c")

    def broadcast(centers: DataFrame):
        got = centers.orderBy("center").select("center", "c").collect()  # n^(1/4) rows
        return spark.sparkContext.broadcast((np.array([r["center"] for r in got]), np.array([r["c"] for r in got], np.float64).reshape(-1, max(d, 1))))

    def upper_step(centers: DataFrame) -> DataFrame:
        shared = broadcast(centers)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, C = shared.value
            state: dict = {}
            for b in batches:
                if b.num_rows:
                    _sums(0, ids, _matrix(b.column("x"), d), C, state)
            if state:
                yield _as_batch(state)

        return _moved(rows.select("x").mapInArrow(scan, _SUMS), centers, d)

    upper = _until_converged(upper, upper_step)
    shared = broadcast(upper)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, C = shared.value
        for b in batches:
            near = ids[np.argmax(_matrix(b.column("x"), d) @ C.T, axis=1)] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("h"), pa.array(near, pa.int64())], names=["x", "h", "node"])

    rows = reliable_checkpoint(rows.mapInArrow(nodes, "x array<double>, h long, node long"))
    sizes = {r["node"]: r["n"] for r in rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}  # n^(1/4) rows
    share = _shares(sizes, lists)
    if not share:
        return spark.createDataFrame([], "list_id long, centroid array<float>, node long, upper array<float>")
    quota = spark.createDataFrame([(u, k, -(-sizes[u] // BLOCK_ROWS)) for u, k in share.items()], "node long, k int, blocks int")
    first = Window.partitionBy("node").orderBy("h")
    lower = rows.dropDuplicates(["node", "h"]).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= max(share.values()))
    lower = lower.join(F.broadcast(quota), "node").where(F.col("_r") <= F.col("k")).select("node", (F.col("_r") - 1).cast("long").alias("center"), F.col("x").alias("c"))
    lower = reliable_checkpoint(lower)
    blocked = rows.join(F.broadcast(quota), "node").select("node", F.pmod("h", "blocks").cast("int").alias("block"), "x")
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")

    def lower_step(centers: DataFrame) -> DataFrame:
        def meet(items: pa.Table, near: pa.Table) -> pa.Table:
            state: dict = {}
            if items.num_rows and near.num_rows:
                order = np.argsort(near.column("center").to_numpy())
                C = _matrix(near.column("c"), d)[order]
                _sums(items.column("node")[0].as_py(), near.column("center").to_numpy()[order], _matrix(items.column("x"), d), C, state)
            return pa.Table.from_batches([_as_batch(state)])

        # names of their own: centers began as rows of the same table
        there = centers.join(F.broadcast(quota), "node").select(F.col("node").alias("node"), spread, "center", "c")
        cell = ["node", "block"]
        return _moved(blocked.groupBy(*cell).cogroup(there.groupBy(*cell)).applyInArrow(meet, _SUMS), centers, d)

    lower = _until_converged(lower, lower_step)
    above = upper.select(F.col("center").alias("node"), F.col("c").cast("array<float>").alias("upper"))
    offset, at = [], 0
    for u in sorted(share):
        offset.append((u, at))
        at += share[u]
    offsets = spark.createDataFrame(offset, "node long, at long")
    out = lower.join(F.broadcast(offsets), "node").join(F.broadcast(above), "node")
    return reliable_checkpoint(out.select((F.col("at") + F.col("center")).alias("list_id"), F.col("c").cast("array<float>").alias("centroid"), "node", "upper"))
