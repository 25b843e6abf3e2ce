"""Exact k-nearest-neighbour search as Spark jobs (K1-K4).

Physical plan of ``knn_join`` (a table of queries against a table of items):

1. The query side is counted and its size checked (vectors and running top-k).
   Within ``broadcast_limit_bytes`` it is shipped once as a broadcast matrix;
   above it, both tables are cut into hash blocks of bounded size, and every
   pair of blocks meets in a task (``meet_in_blocks``); no query vector passes
   through the driver then.  Where the copies of the blocks would pass
   ``COPY_BYTES``, both tables are stored once instead, and one pass over the
   items answers as many queries as a broadcast holds (``_in_passes``): the
   disk holds each row once, however many passes there are.  All ways give the same rows.
2. ``mapInArrow`` over the item scan: blocks of bounded size are screened by
   a matrix product against the running k-th distance of every query
   (``keep_nearest``), the few pairs that may enter are computed exactly; the
   running top-k per query (and per group) is kept in the task and only
   k rows per query leave it.  No pair rows are ever materialised.
3. The per-task candidates are merged by a windowed top-k on the query key
   (Catalyst plans ``WindowGroupLimit`` before and after the shuffle), with a
   salted first level, so that no reducer gets every task's candidates.

Ties are broken by item id ascending; zero vectors, NaN vectors and vectors
of the wrong dimension are never candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.functions import vectors as V
from nearfold.session import scratch_path, ship_package

METRICS = ("cosine", "l2", "l1", "dot")
DEFAULT_BROADCAST_LIMIT = 64 << 20  # bytes of float64 query matrix shipped per pass
_BLOCK_BYTES = 8 << 20  # bound on one array of a distance block inside a task
QUERY_STEP, ITEM_STEP = 512, 4_096  # queries and items whose distances a task computes at once
# items, and queries of one key, that a task holds where both sides are cut into blocks
ITEM_BLOCK, QUERY_BLOCK = 65_536, 4_096
ITEM_BLOCK_BYTES = 64 << 20  # of the items' vectors in such a block, in single precision
_MOST_TASKS = 4_000  # that pairs of blocks are dealt to
COPY_BYTES = 256 << 20  # of vectors shuffled for pairs of blocks; above, queries go by passes
OUT_ROWS = 65_536  # in one batch of a task's candidates
MERGE_SALT = 8  # groups in which a query's candidates are merged first
TIE_DECIMALS = 12  # of distances relative to their scale: 1 for cosine, the query's length for dot


# ---------------------------------------------------------------- numpy helpers


def select_topk(D: np.ndarray, I: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row keep the k smallest distances, ties by smaller id, sorted."""
    if D.shape[1] > k:
        part = np.argpartition(D, k - 1, axis=1)[:, :k]
        Dk = np.take_along_axis(D, part, 1)
        Ik = np.take_along_axis(I, part, 1)
        kth = Dk.max(axis=1)
        finite = np.isfinite(kth)
        if finite.any():
            # rows where equal distances straddle the cut: resolve by id exactly
            ties = np.flatnonzero(finite & ((D <= kth[:, None]).sum(axis=1) > k))
            if len(ties):
                o = np.lexsort((I[ties], D[ties]), axis=1)[:, :k]
                Dk[ties] = np.take_along_axis(D[ties], o, 1)
                Ik[ties] = np.take_along_axis(I[ties], o, 1)
        D, I = Dk, Ik
    o = np.lexsort((I, D), axis=1)
    return np.take_along_axis(D, o, 1), np.take_along_axis(I, o, 1)


def prepare_queries(metric: str, Q: np.ndarray) -> dict:
    Q = np.asarray(Q, dtype=np.float64)
    qn = np.sqrt((Q * Q).sum(axis=1))
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            Qp = Q / qn[:, None]
        Qp[~(qn > 0)] = np.nan  # zero query: every distance undefined
        return {"Q": Qp, "q2": None, "usable": np.isfinite(Qp).all(axis=1)}
    return {"Q": Q, "q2": qn * qn, "usable": np.isfinite(Q).all(axis=1)}


def distances(metric: str, P: dict, qsel, X: np.ndarray) -> np.ndarray:
    """Distance block (len(qsel) x len(X)); undefined distances are +inf."""
    Q = P["Q"][qsel]
    if metric == "cosine":
        xn = np.sqrt((X * X).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            D = 1.0 - (Q @ X.T) / xn[None, :]
    elif metric == "l2":
        x2 = (X * X).sum(axis=1)
        D2 = P["q2"][qsel][:, None] + x2[None, :] - 2.0 * (Q @ X.T)
        D = np.sqrt(np.maximum(D2, 0.0))
    elif metric == "dot":
        D = -(Q @ X.T)
    elif metric == "l1":
        D = np.empty((Q.shape[0], X.shape[0]))
        step = max(1, _BLOCK_BYTES // max(1, 8 * X.size))
        for s in range(0, Q.shape[0], step):
            D[s : s + step] = np.abs(Q[s : s + step, None, :] - X[None, :, :]).sum(axis=2)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    D[~np.isfinite(D)] = np.inf
    # Distances equal up to rounding noise (x vs 2x under cosine) tie exactly
    # and fall back to the id order.  L2 and L1 have no scale of their own and
    # are not rounded.
    if metric == "cosine":
        return np.round(D, TIE_DECIMALS)
    if metric == "dot":
        scale = _dot_scale(P["q2"][qsel])[:, None]
        return np.round(D / scale, TIE_DECIMALS) * scale
    return D


def nearest_distances(metric: str, P: dict, qsel, X: np.ndarray, k: int) -> np.ndarray:
    """As :func:`distances`, but the k smallest of each row depend on the pair of vectors alone, to the last digit.

    The last digits of a matrix product change with the place of a row in its
    block, so a copy could round to another distance than its twin.  The matrix
    form of L2 cancels where vectors are long and near.  Either error has a
    bound, so the items that may be among the k nearest are known; they are
    computed again from the two vectors (cosine and dot: where the error could
    change the rounded distance), and L2 leaves the others out (+inf)."""
    if metric == "l1":
        return distances(metric, P, qsel, X)
    rows = np.arange(len(P["Q"]))[qsel]
    Q, eps = P["Q"][rows], np.finfo(float).eps
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        x2 = (X * X).sum(axis=1)
        norm = np.sqrt(x2)
        if metric == "l2":
            size = P["q2"][rows][:, None] + x2[None, :]
            near = size - 2.0 * (Q @ X.T)
            error = 8.0 * eps * (Q.shape[1] + 2) * size
        else:
            scale = _dot_scale(P["q2"][rows])[:, None] if metric == "dot" else 1.0
            near = -(Q @ X.T) / scale if metric == "dot" else 1.0 - (Q @ X.T) / norm[None, :]
            error = 4.0 * eps * (Q.shape[1] + 8) * (np.maximum(2.0 * norm, 1e-300)[None, :] if metric == "dot" else 1.0)
        real = np.isfinite(near)
        slack = error if metric == "l2" else error + 0.5 * 10.0**-TIE_DECIMALS  # the rounding moves a distance as well
        worst = np.full(len(Q), np.inf)
        if near.shape[1] > k:
            worst = np.partition(np.where(real, near + slack, np.inf), k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(real & (near - slack <= worst[:, None]))
        if metric == "l2":
            D = np.full(near.shape, np.inf)
        else:
            D = np.where(real, np.round(near, TIE_DECIMALS) * scale, np.inf)
            steps = near[i, j] * 10.0**TIE_DECIMALS
            doubt = np.broadcast_to(error, near.shape)[i, j] * 10.0**TIE_DECIMALS + 4.0 * eps * np.abs(steps)
            unsure = np.abs(steps - np.floor(steps) - 0.5) <= doubt
            i, j = i[unsure], j[unsure]
    D[i, j] = _pair_by_pair(metric, P, rows[i], X, norm, j)
    return D


def _pair_by_pair(metric: str, P: dict, a: np.ndarray, X: np.ndarray, norm: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of the pairs (query a[i], item b[i]) in double precision, each from its two vectors alone."""
    out = np.empty(len(a))
    step = max(1, _BLOCK_BYTES // (16 * max(1, X.shape[1])))
    for s in range(0, len(a), step):
        q, x = a[s : s + step], b[s : s + step]
        A, B = P["Q"][q], X[x]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            if metric == "cosine":
                d = np.round(1.0 - np.einsum("ij,ij->i", A, B) / norm[x], TIE_DECIMALS)
            elif metric == "l2":
                d = np.sqrt(((A - B) ** 2).sum(axis=1))
            else:
                scale = _dot_scale(P["q2"][q])
                d = np.round(-np.einsum("ij,ij->i", A, B) / scale, TIE_DECIMALS) * scale
        out[s : s + step] = d
    out[~np.isfinite(out)] = np.inf
    return out


def _dot_scale(q2: np.ndarray) -> np.ndarray:
    """The power of two that inner products of a query are rounded relative to."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.exp2(np.floor(np.log2(np.sqrt(q2))))
    return np.where(np.isfinite(scale) & (scale > 0), scale, 1.0)


class _Screen:
    """Which pairs of a block of items may be nearer than a bound, by one matrix product in single precision.

    The product's error has a bound, which is given away, so no pair within the bound is missed."""

    def __init__(self, metric: str, X: np.ndarray):
        self.metric, self.X, d = metric, X, X.shape[1]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            x2 = (X * X).sum(axis=1)
            self.norm = np.sqrt(x2)
            top = float(np.max(self.norm[np.isfinite(self.norm)], initial=0.0))
            # beyond these sizes single precision could overflow or lose the products
            self.kind = np.float32 if metric == "cosine" or 1e-15 < top < 1e15 else np.float64
            self.top, self.eps = top, (d + 8) * float(np.finfo(self.kind).eps)
            if metric == "cosine":
                side = X / self.norm[:, None]
            elif metric == "l2":
                side = np.concatenate([2.0 * X, -x2[:, None]], axis=1)
            else:
                side = X
            self.side = side.astype(self.kind)

    def pairs(self, P: dict, q: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Boolean (len(q) x items): pairs whose distance may be at most ``worst`` of the query."""
        Q = P["Q"][q]
        if self.metric == "cosine":
            least = 1.0 - worst - self.eps - 4e-12
        elif self.metric == "l2":
            Q = np.concatenate([Q, np.ones((len(q), 1))], axis=1)
            q2 = P["q2"][q]
            least = q2 - worst * worst - self.eps * (q2 + 2.0 * self.top**2) - 1e-14 * worst * worst
        else:
            qn = np.sqrt(P["q2"][q])
            least = -worst - qn * (self.eps * self.top + 4e-12)
        kind = self.kind
        if kind == np.float32 and not (np.abs(Q) < 1e15).all():
            kind = np.float64
        with np.errstate(over="ignore", invalid="ignore"):
            near = Q.astype(kind) @ self.side.T.astype(kind, copy=False)
            # the bound itself is rounded: down
            return near >= np.nextafter(least.astype(kind), kind(-np.inf))[:, None]

    def exact(self, P: dict, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The distances of the pairs (q[i], item j) in double precision."""
        return _pair_by_pair(self.metric, P, q[i], self.X, self.norm, j)


def keep_nearest(metric: str, P: dict, asked: np.ndarray, X: np.ndarray, ids: np.ndarray, Dk: np.ndarray, Ik: np.ndarray) -> None:
    """Merge the items ``X`` into the running k nearest (``Dk``, ``Ik``) of the queries ``asked``, places in ``P`` and in both.

    Blocks of at most QUERY_STEP x ITEM_STEP pairs are screened against the
    queries' k-th distances so far; only pairs that may enter are computed
    exactly and merged.  Queries without k neighbours yet, and blocks that the
    screen hardly thins out, are computed whole."""
    k = Dk.shape[1]
    asked = asked[P["usable"][asked]]
    first = min(ITEM_STEP, max(256, 4 * k))
    step = ITEM_STEP if np.isfinite(Dk[asked]).all() else first
    at = 0
    while at < len(X):
        part, part_ids = np.asarray(X[at : at + step], dtype=np.float64), ids[at : at + step]
        screen = _Screen(metric, part) if metric != "l1" else None
        for s in range(0, len(asked), QUERY_STEP):
            q = asked[s : s + QUERY_STEP]
            worst = Dk[q].max(axis=1)
            full = np.isfinite(worst)
            _merge_near(metric, P, q[full], worst[full], screen, part, part_ids, Dk, Ik)
            _merge_all(metric, P, q[~full], part, part_ids, Dk, Ik)
        at, step = at + step, min(ITEM_STEP, 4 * step)


def _merge_all(metric: str, P: dict, q: np.ndarray, X: np.ndarray, ids: np.ndarray, Dk: np.ndarray, Ik: np.ndarray) -> None:
    if len(q):
        D = nearest_distances(metric, P, q, X, Dk.shape[1])
        Dk[q], Ik[q] = select_topk(np.concatenate([Dk[q], D], axis=1), np.concatenate([Ik[q], np.broadcast_to(ids, D.shape)], axis=1), Dk.shape[1])


def _merge_near(metric: str, P: dict, q: np.ndarray, worst: np.ndarray, screen: _Screen | None, X: np.ndarray, ids: np.ndarray,
                Dk: np.ndarray, Ik: np.ndarray) -> None:
    if not len(q):
        return
    if screen is None:
        D = distances(metric, P, q, X)
        i, j = np.nonzero(D <= worst[:, None])
        d = D[i, j]
    else:
        may = screen.pairs(P, q, worst)
        if np.count_nonzero(may) > may.size // 16:
            return _merge_all(metric, P, q, X, ids, Dk, Ik)
        i, j = np.divmod(np.flatnonzero(may), len(X))
        d = screen.exact(P, q, i, j)
        real = d <= worst[i]
        i, j, d = i[real], j[real], d[real]
    if not len(i):
        return
    k = Dk.shape[1]
    n = np.bincount(i, minlength=len(q))
    rows = np.flatnonzero(n)
    place = np.arange(len(i)) - np.repeat((np.cumsum(n) - n)[rows], n[rows])
    row = np.repeat(np.arange(len(rows)), n[rows])
    D = np.full((len(rows), k + int(n.max())), np.inf)
    I = np.full(D.shape, -1, np.int64)
    D[:, :k], I[:, :k] = Dk[q[rows]], Ik[q[rows]]
    D[row, k + place], I[row, k + place] = d, ids[j]
    Dk[q[rows]], Ik[q[rows]] = select_topk(D, I, k)


# ---------------------------------------------------------------- task kernel


def _kernel(bc, k, metric, id_col, vec_col, group_cols):
    """Build the mapInArrow function; all state lives inside one task."""

    def run(batches):
        import pandas as pd

        P = bc.value
        qids, d = P["qids"], P["d"]
        everyone = np.arange(len(qids))
        state: dict = {}

        def absorb(gkey, X, ids):
            """Merge the distances of all queries to X into the group's running top-k."""
            if gkey not in state:
                state[gkey] = (np.full((len(qids), k), np.inf), np.full((len(qids), k), -1, dtype=np.int64))
            keep_nearest(metric, P, everyone, X, ids, *state[gkey])

        for rb in batches:
            if rb.num_rows == 0:
                continue
            ids = rb.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = rb.column(vec_col).flatten().to_numpy(zero_copy_only=False)
            X = flat.reshape(-1, d)
            if not group_cols:
                absorb((), X, ids)
                continue
            kdf = pd.DataFrame({c: rb.column(c).to_numpy(zero_copy_only=False) for c in group_cols})
            for kv, rows in kdf.groupby(list(group_cols), sort=False).indices.items():
                kv = kv if isinstance(kv, tuple) else (kv,)
                absorb(tuple(int(v) for v in kv), X[rows], ids[rows])

        step = max(1, OUT_ROWS // k)
        while state:  # a group's lists go as they are written out, some queries at a time
            gkey, (Dk, Ik) = state.popitem()
            for s in range(0, len(qids), step):
                D, m = Dk[s : s + step], np.isfinite(Dk[s : s + step])
                n = int(m.sum())
                if n == 0:
                    continue
                arrays = {c: pa.array(np.full(n, v, dtype=np.int64)) for c, v in zip(group_cols, gkey, strict=True)}
                arrays["qid"] = pa.array(np.repeat(qids[s : s + step], k).reshape(D.shape)[m])
                arrays["id"] = pa.array(Ik[s : s + step][m])
                arrays["distance"] = pa.array(D[m])
                yield pa.RecordBatch.from_pydict(arrays)

    return run


def _matrix(column, dim: int) -> np.ndarray:
    """The vectors as they are stored; double precision is for the parts that are computed on."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _block_kernel(k: int, metric: str, dim: int, key: tuple[str, ...], group_cols: tuple[str, ...], schema: pa.Schema):
    """Top-k of one block of queries over one block of items, per group."""

    def run(items: pa.Table, asked: pa.Table) -> pa.Table:
        if not items.num_rows or not asked.num_rows:
            return schema.empty_table()
        X, ids = _matrix(items.column("embedding"), dim), items.column("id").to_numpy()
        payload, qids = prepare_queries(metric, _matrix(asked.column("_nf_v"), dim)), asked.column("qid").to_numpy()
        groups = np.stack([items.column(c).to_numpy() for c in group_cols], axis=1) if group_cols else np.zeros((len(ids), 0), np.int64)
        kinds, code = np.unique(groups, axis=0, return_inverse=True) if group_cols else (groups[:1], np.zeros(len(ids), np.int64))
        out = {c: [] for c in schema.names}
        for g, kind in enumerate(kinds):
            rows = np.flatnonzero(code.reshape(-1) == g) if len(kinds) > 1 else slice(None)
            D, I = np.full((len(qids), k), np.inf), np.full((len(qids), k), -1, np.int64)
            keep_nearest(metric, payload, np.arange(len(qids)), X[rows], ids[rows], D, I)
            real = np.isfinite(D)
            for c, v in zip(group_cols, kind, strict=True):
                out[c].append(np.full(int(real.sum()), v, np.int64))
            out["qid"].append(np.repeat(qids, k).reshape(D.shape)[real])
            out["id"].append(I[real])
            out["distance"].append(D[real])
        n = sum(map(len, out["qid"]))
        for c in key:
            out[c] = [np.full(n, items.column(c)[0].as_py(), np.int64)]
        return pa.table([pa.array(np.concatenate(out[c])) for c in schema.names], schema=schema)

    return run


# ---------------------------------------------------------------- pairwise distances


def _pair_kernel(a: str, b: str, metric: str, out: str):
    def run(batches):
        for rb in batches:
            n = rb.num_rows
            res = np.full(n, np.nan)
            ca, cb = rb.column(a), rb.column(b)
            la = np.diff(ca.offsets.to_numpy()) if n else np.empty(0)
            lb = np.diff(cb.offsets.to_numpy()) if n else np.empty(0)
            ok = ca.is_valid().to_numpy(zero_copy_only=False) & cb.is_valid().to_numpy(zero_copy_only=False)
            if n and ok.all() and (la == la[0]).all() and (lb == la[0]).all():
                d = int(la[0])
                A = ca.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, d)
                B = cb.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, d)
                res = _rowwise(metric, A, B)
            else:  # mixed dimensions or NULLs: row by row, NULL when undefined
                for i in range(n):
                    if ok[i] and la[i] == lb[i]:
                        x = np.asarray(ca[i].values, dtype=np.float64)[None, :]
                        y = np.asarray(cb[i].values, dtype=np.float64)[None, :]
                        res[i] = _rowwise(metric, x, y)[0]
            mask = ~np.isfinite(res)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(res, mask=mask)], names=[*rb.schema.names, out])

    return run


def _rowwise(metric: str, A: np.ndarray, B: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "cosine":
            return 1.0 - (A * B).sum(1) / (np.sqrt((A * A).sum(1)) * np.sqrt((B * B).sum(1)))
        if metric == "l2":
            return np.sqrt(((A - B) ** 2).sum(1))
        if metric == "l1":
            return np.abs(A - B).sum(1)
        if metric == "dot":
            return -(A * B).sum(1)
    raise ValueError(f"unknown metric {metric!r}")


def pair_distances(df: DataFrame, a: str, b: str, metric: str = "cosine", out: str = "distance") -> DataFrame:
    """Distance between two vector columns of every row, in Arrow batches.

    The row-wise counterpart of ``functions.vectors``: same semantics (NULL
    for NULL vectors, mismatched dimensions or a zero norm under cosine), but
    vectorised in NumPy instead of interpreted higher-order functions."""
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    return df.mapInArrow(_pair_kernel(a, b, metric, out), schema)


# ---------------------------------------------------------------- DataFrame API


def collect_query_matrix(queries: DataFrame, qid: str, vec: str, dim: int | None = None):
    """Pull a size-checked query table to the driver: (qids, matrix)."""
    tbl = queries.select(F.col(qid).cast("long").alias("qid"), F.col(vec).alias("v")).toArrow()
    if tbl.num_rows == 0:
        return np.empty(0, np.int64), np.empty((0, dim or 0))
    qids = tbl.column("qid").to_numpy()
    vcol = tbl.column("v").combine_chunks()
    flat = vcol.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    d = dim or (len(flat) // tbl.num_rows)
    return qids, flat.reshape(-1, d)


def _valid_vectors(df: DataFrame, vec: str, dim: int) -> DataFrame:
    return df.where(F.col(vec).isNotNull() & (F.size(vec) == dim) & ~V.has_nan(vec))


def query_stats(queries: DataFrame, vec: str) -> tuple[int, int]:
    """(rows, dimension) of a query table in one job.

    The dimension is the one that most rows have (one row per distinct
    dimension comes to the driver); see :func:`misfits` for the others."""
    found = queries.groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    usual = max((r for r in found if (r["d"] or 0) > 0), key=lambda r: (r["n"], -r["d"]), default=None)
    return sum(r["n"] for r in found), usual["d"] if usual else 0


def misfits(queries: DataFrame, vec: str = "embedding") -> DataFrame:
    """The rows that a search leaves out, with the reason: no vector, another dimension, NaN, zero length."""
    dim = query_stats(queries, vec)[1]
    why = (
        F.when(F.col(vec).isNull(), "null")
        .when(F.size(vec) != dim, "dimension")
        .when(V.has_nan(vec), "nan")
        .when(V.norm(vec) == 0, "zero")
    )
    return queries.withColumn("reason", why).where(F.col("reason").isNotNull())


def merge_topk(
    cands: DataFrame,
    keys: Sequence[str],
    k: int,
    order: Sequence[Column] | None = None,
    salt_buckets: int = 1,
    rank_col: str = "rk",
) -> DataFrame:
    """Top-k rows per key by (distance, id), with an optional salted first level."""
    order = list(order) if order is not None else [F.col("distance").asc(), F.col("id").asc()]
    keys = list(keys)
    if salt_buckets > 1:
        salted = cands.withColumn("_nf_salt", F.pmod(F.xxhash64("id"), F.lit(salt_buckets)))
        w1 = Window.partitionBy(*keys, "_nf_salt").orderBy(*order)
        cands = salted.withColumn("_nf_r", F.row_number().over(w1)).where(F.col("_nf_r") <= k).drop(
            "_nf_r", "_nf_salt"
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    return cands.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def block_candidates(
    items: DataFrame,
    qids: np.ndarray,
    Q: np.ndarray,
    k: int,
    metric: str,
    *,
    id_col: str = "id",
    vec_col: str = "embedding",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Per-task top-k candidates of ``items`` for an in-memory query block."""
    return _scan(items, _shipped(items, qids, Q, metric), Q.shape[1], k, metric, id_col, vec_col, group_cols)


def _shipped(items: DataFrame, qids: np.ndarray, Q: np.ndarray, metric: str):
    """A query block, ready for the kernel, as a broadcast."""
    spark = items.sparkSession
    ship_package(spark)
    payload = prepare_queries(metric, Q)
    payload.update(qids=np.asarray(qids, dtype=np.int64), d=Q.shape[1])
    return spark.sparkContext.broadcast(payload)


def _scan(items: DataFrame, bc, d: int, k: int, metric: str, id_col: str, vec_col: str, group_cols: Sequence[str]) -> DataFrame:
    cols = [F.col(c).cast("long").alias(c) for c in group_cols]
    src = _valid_vectors(items, vec_col, d).select(
        *cols, F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding")
    )
    fields = [T.StructField(c, T.LongType()) for c in group_cols]
    fields += [
        T.StructField("qid", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("distance", T.DoubleType()),
    ]
    fn = _kernel(bc, k, metric, "id", "embedding", tuple(group_cols))
    return src.mapInArrow(fn, T.StructType(fields))


def knn_join(
    items: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    item_id: str = "id",
    item_vec: str = "embedding",
    query_id: str = "qid",
    query_vec: str = "embedding",
    group_cols: Sequence[str] = (),
    broadcast_limit_bytes: int = DEFAULT_BROADCAST_LIMIT,
    stored: bool = False,
) -> DataFrame:
    """Exact top-k items per query (and per group): (group..., qid, rk, id, distance).

    ``stored``: ``items`` is read from files, so many scans of it cost no more than its bytes."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if k <= 0:
        raise ValueError("k must be positive")
    n, d = query_stats(queries, query_vec)
    if not d:
        fields = [T.StructField(c, T.LongType()) for c in (*group_cols, "qid", "rk", "id")]
        return items.sparkSession.createDataFrame([], T.StructType([*fields, T.StructField("distance", T.DoubleType())]))
    q = _valid_vectors(queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("embedding")), "embedding", d)
    # a task keeps the queries and, for each query and group, k distances and ids
    groups = items.select(*group_cols).distinct().count() if group_cols else 1
    per_query = (d + 2 * k * max(1, groups)) * 8
    if n * per_query <= broadcast_limit_bytes:
        qids, Q = collect_query_matrix(q, "qid", "embedding", d)
        if n >= QUERY_STEP:  # the scan is heavy: all cores get items, and every task sends k rows per query only once
            wanted = [*group_cols, F.col(item_id), F.col(item_vec)]
            items = items.select(*wanted).repartition(items.sparkSession.sparkContext.defaultParallelism)
        cands = block_candidates(items, qids, Q, k, metric, id_col=item_id, vec_col=item_vec, group_cols=group_cols)
    else:
        rows = items.select(*group_cols, F.col(item_id).alias("id"), F.col(item_vec).alias("embedding"))
        per_block = max(1, broadcast_limit_bytes // (4 * per_query))  # the task's items and its output stand beside them
        n_items = rows.count()
        if (n_items * -(-n // per_block) + n * -(-n_items // _item_block(d))) * 4 * d > COPY_BYTES:
            return _in_passes(rows, q, k, metric, d, group_cols, min(n, -(-n * per_query // max(1, broadcast_limit_bytes))), stored)
        cands = meet_in_blocks(rows, q, k, metric, d, group_cols=group_cols, query_block=per_block)
    out = merge_topk(cands, [*group_cols, "qid"], k, salt_buckets=MERGE_SALT)
    return out.select(*group_cols, "qid", "rk", "id", "distance")


def _item_block(dim: int) -> int:
    return max(1, min(ITEM_BLOCK, ITEM_BLOCK_BYTES // (4 * max(1, dim))))


def _in_passes(items: DataFrame, asked: DataFrame, k: int, metric: str, dim: int, group_cols: Sequence[str], passes: int,
               stored: bool = False) -> DataFrame:
    """:func:`knn_join` in ``passes`` over the stored items: (group..., qid, rk, id, distance), stored.

    A pass takes the queries of one hash block through the driver, as many as a
    broadcast may hold, and writes their k nearest; a task per core sends k
    rows per query and group to the merge.  What a pass shuffled goes with it."""
    spark = items.sparkSession
    path = scratch_path(spark, "knn_passes")
    if not stored:
        _valid_vectors(items, "embedding", dim).write.parquet(f"{path}/items")
        items = spark.read.schema(items.schema).parquet(f"{path}/items")
    block = F.pmod(F.xxhash64("qid"), F.lit(passes)).cast("int").alias("_nf_pass")
    asked.select("*", block).repartition(passes, "_nf_pass").write.partitionBy("_nf_pass").parquet(f"{path}/queries")
    asked = spark.read.parquet(f"{path}/queries")
    scan = items.coalesce(spark.sparkContext.defaultParallelism)
    names = [*group_cols, "qid", "rk", "id", "distance"]
    kinds = ", ".join(f"{c} {dict(rk='int', distance='double').get(c, 'long')}" for c in names)
    spark.createDataFrame([], kinds).write.parquet(f"{path}/topk")
    for p in range(passes):
        qids, Q = collect_query_matrix(asked.where(F.col("_nf_pass") == p), "qid", "embedding", dim)
        if not len(qids):
            continue
        held = _shipped(items, qids, Q, metric)
        found = merge_topk(_scan(scan, held, dim, k, metric, "id", "embedding", group_cols), [*group_cols, "qid"], k)
        found.select(*names).write.mode("append").parquet(f"{path}/topk")
        held.destroy()
        del found
        spark.sparkContext._jvm.System.gc()  # the cleaner removes shuffles that nothing refers to; it would wait for the heap to fill
    return spark.read.schema(kinds).parquet(f"{path}/topk")


def meet_in_blocks(items: DataFrame, asked: DataFrame, k: int, metric: str, dim: int, key: Sequence[str] = (),
                   group_cols: Sequence[str] = (), item_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """Candidates (group..., key..., qid, id, distance): top-k of every query over blocks of the items of its key.

    ``items``: key..., group..., ``id, embedding``; ``asked``: key..., ``qid, embedding``.
    Items of one key are cut into blocks of ``item_block`` rows (wide vectors: fewer, by their bytes) and its queries
    into blocks of ``query_block``; a task holds one pair of blocks, however
    many rows a key has.  Without a key all items meet all queries.  Nothing
    passes through the driver; the broadcast has one row per key."""
    ship_package(items.sparkSession)
    key, group_cols = tuple(key), tuple(group_cols)
    key_of = [F.col(c).cast("long").alias(c) for c in key]
    sizes = {"_nf_nq": (asked, query_block or QUERY_BLOCK), "_nf_ni": (items, item_block or _item_block(dim))}
    dealt = ()
    if key:
        per = [df.groupBy(*key_of).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(c)) for c, (df, size) in sizes.items()]
        blocks = F.broadcast(per[0].join(per[1], list(key)))
        sized = lambda df: df.join(blocks, list(key))
    else:
        number = {c: max(1, -(-df.count() // size)) for c, (df, size) in sizes.items()}
        sized = lambda df: df.withColumns({c: F.lit(n) for c, n in number.items()})
        dealt = (min(_MOST_TASKS, 4 * number["_nf_nq"] * number["_nf_ni"]),)  # few big cells: one or two in a task
    left = _valid_vectors(items, "embedding", dim).select(
        *key_of, *[F.col(c).cast("long").alias(c) for c in group_cols], F.col("id").cast("long").alias("id"), "embedding")
    left = sized(left).withColumn("_nf_i", F.pmod(F.xxhash64("id"), "_nf_ni").cast("int")).withColumn(
        "_nf_q", F.explode(F.sequence(F.lit(0), F.col("_nf_nq") - 1))).drop("_nf_ni", "_nf_nq")
    right = _valid_vectors(asked, "embedding", dim).select(*key_of, F.col("qid").cast("long").alias("qid"), F.col("embedding").alias("_nf_v"))
    right = sized(right).withColumn("_nf_q", F.pmod(F.xxhash64("qid"), "_nf_nq").cast("int")).withColumn(
        "_nf_i", F.explode(F.sequence(F.lit(0), F.col("_nf_ni") - 1))).drop("_nf_ni", "_nf_nq")
    names = [*group_cols, *key, "qid", "id"]
    schema = pa.schema([*((c, pa.int64()) for c in names), ("distance", pa.float64())])
    kernel = _block_kernel(k, metric, dim, key, group_cols, schema)
    ddl = ", ".join([*(f"{c} long" for c in names), "distance double"])
    cell = [*key, "_nf_i", "_nf_q"]
    if dealt:
        left, right = left.repartition(*dealt, *cell), right.repartition(*dealt, *cell)
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(kernel, ddl)


def knn_single(items: DataFrame, query: Sequence[float], k: int, metric: str = "l2",
               id_col: str = "id", vec_col: str = "embedding", with_vector: bool = False) -> DataFrame:
    """``ORDER BY embedding <op> q LIMIT k`` for one query vector (K1/K2): (id[, embedding], distance).

    Runs the vectorised block kernel with a one-row query block (each task
    keeps its k best rows); with ``with_vector`` the k winning vectors are
    fetched back by an ``id IN (...)`` filter that parquet can skip on."""
    qids = np.zeros(1, dtype=np.int64)
    Q = np.asarray([list(query)], dtype=np.float64)
    cands = block_candidates(items, qids, Q, k, metric, id_col=id_col, vec_col=vec_col)
    top = merge_topk(cands, ["qid"], k, salt_buckets=MERGE_SALT).select("rk", "id", "distance")
    if not with_vector:
        return top.orderBy("rk").select("id", "distance")
    top = top.cache()
    ids = [r["id"] for r in top.select("id").collect()]  # k ids
    vecs = items.where(F.col(id_col).isin(ids)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))
    return top.join(vecs, "id").orderBy("rk").select("id", "embedding", "distance")


def cumulative_topk(slab_topk: DataFrame, cutoffs: Sequence[int], k: int,
                    slab_col: str = "slab", out_col: str = "cutoff",
                    keys: Sequence[str] = ("qid",)) -> DataFrame:
    """Top-k of the union of slabs <= c for every cutoff c, from per-slab top-k lists.

    top-k(A u B) = top-k(top-k(A) u top-k(B)), so each cutoff only merges
    k rows per slab and query."""
    arr = F.array(*[F.lit(int(c)) for c in cutoffs])
    exploded = slab_topk.withColumn(out_col, F.explode(F.filter(arr, lambda c: c >= F.col(slab_col))))
    return merge_topk(exploded.drop("rk"), [out_col, *keys], k)
