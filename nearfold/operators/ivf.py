"""Inverted-list index as tables.

* ``centroids``: (list_id, centroid) — either *pivots* (the first ``lists``
  base rows in permutation order; deterministic, checkable in SQL) or trained
  with two-level spherical k-means on all rows.
* ``postings``: (list_id, id, embedding), every item assigned to its nearest
  centroid by a map-only kernel (centroid matrix broadcast after a size check;
  trained lists go through the upper level, so a row meets n^(1/4) centers twice),
  written ``partitionBy(list_id)`` after a range repartition on (list_id, id)
  so a huge list is cut across many writers instead of one.
* search: where queries, centroids and routes fit the checked broadcast, the
  postings of the probed lists (partition pruning) are scanned once, map-only:
  each task keeps the top-k of the queries that probe the lists it holds.
  Where all lists are probed, the postings meet the queries in one kNN join.
  Beyond that bound, queries are routed by a kNN join against the centroids,
  and the probes, as rows, meet the stored postings by list, in pairs of
  bounded blocks.  Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.operators import kmeans, knn
from nearfold.session import reliable_checkpoint, scratch_path, ship_package

CENTROID_BROADCAST_LIMIT = 256 << 20
_ASSIGN_BLOCK = 8 << 20


def lists_for(n: int) -> int:
    """lists = round(sqrt(n)) (at least 1)."""
    return max(1, int(round(math.sqrt(n))))


def serving_lists(n: int) -> int:
    """Lists of an index that serves searches with 20 probes: three quarters of the rule.

    The rule's recall@10 stays below 0.9 on vectors without clusters, where
    recall follows the share of the lists that are probed."""
    return max(1, int(round(0.75 * math.sqrt(n))))


def lists_grid(n: int) -> list[int]:
    """Half, the rule, and double: (L // 2, L, 2L)."""
    L = lists_for(n)
    return sorted({max(1, L // 2), L, 2 * L})


def pivot_centroids(perm_items: DataFrame, lists: int) -> DataFrame:
    """The first ``lists`` rows by permutation rank are the centroids."""
    return perm_items.where(F.col("perm_rank") < lists).select(
        F.col("perm_rank").alias("list_id"), F.col("embedding").alias("centroid")
    )


def train_centroids(items: DataFrame, lists: int, seed: int = kmeans.SEED, vec_col: str = "embedding") -> DataFrame:
    """Two-level spherical k-means on all rows: (list_id, centroid, node, upper); see :mod:`nearfold.operators.kmeans`."""
    return kmeans.train(items, lists, seed, vec_col)


def _assign_kernel(bc, metric, vec_col, first):
    """Nearest of one broadcast's centroids; later broadcasts improve on the columns of the first."""

    def run(batches):
        P = bc.value
        C, cids, d = P["Q"], P["qids"], P["d"]
        for rb in batches:
            if rb.num_rows == 0:
                continue
            flat = rb.column(vec_col).flatten().to_numpy(zero_copy_only=False)
            X = flat.astype(np.float64, copy=False).reshape(-1, d)
            best = np.empty(len(X), dtype=np.int64)
            bestd = np.empty(len(X))
            step = max(1, _ASSIGN_BLOCK // max(1, 8 * len(cids)))
            for s in range(0, len(X), step):
                D = knn.distances(metric, P, np.arange(len(cids)), X[s : s + step])  # lists x rows
                j = np.argmin(D, axis=0)  # first minimum = smallest list_id (cids sorted)
                best[s : s + step] = cids[j]
                bestd[s : s + step] = D[j, np.arange(D.shape[1])]
            columns = rb.columns
            if not first:  # equal distances: the smaller list_id, whichever broadcast holds it
                old = pc.fill_null(columns[-2], -1).to_numpy(zero_copy_only=False)
                oldd = pc.fill_null(columns[-1], np.inf).to_numpy(zero_copy_only=False)
                keep = (oldd < bestd) | ((oldd == bestd) & (old < best))
                best, bestd = np.where(keep, old, best), np.where(keep, oldd, bestd)
                columns = columns[:-2]
            ok = np.isfinite(bestd)
            lid = pa.array(best, mask=~ok)
            cd = pa.array(np.where(ok, bestd, np.nan), mask=~ok)
            names = [n for n in rb.schema.names if n not in ("list_id", "centroid_distance")]
            yield pa.RecordBatch.from_arrays([*columns, lid, cd], names=[*names, "list_id", "centroid_distance"])

    return run


def assign(items: DataFrame, centroids: DataFrame, metric: str = "cosine", vec_col: str = "embedding",
           limit: int = CENTROID_BROADCAST_LIMIT) -> DataFrame:
    """Nearest centroid for every item: adds list_id, centroid_distance.

    One map-only pass over the items, also on a stream.  Centroids are shipped
    in broadcasts of at most ``limit`` bytes; a row passes all of them in turn
    and keeps the nearest list so far (ties by list_id), so repeated ids and
    the number of broadcasts make no difference.  The number of lists is a
    parameter, about the square root of the rows.  Items whose distance is
    undefined (zero/NaN vector) get a NULL list."""
    if "node" in centroids.columns:
        return _assign_by_node(items, centroids, metric, vec_col, limit)
    n, d = knn.query_stats(centroids, "centroid")
    chunks = max(1, -(-n * d * 8 // limit))
    spark = items.sparkSession
    ship_package(spark)
    out = items.drop("list_id", "centroid_distance").where(F.col(vec_col).isNotNull() & (F.size(vec_col) == d))
    schema = T.StructType([*out.schema.fields, T.StructField("list_id", T.LongType()), T.StructField("centroid_distance", T.DoubleType())])
    first = True
    for c in range(chunks):
        part = centroids.where(F.pmod(F.col("list_id"), F.lit(chunks)) == c) if chunks > 1 else centroids
        cids, C = knn.collect_query_matrix(part.orderBy("list_id"), "list_id", "centroid", d)
        if len(cids):
            payload = knn.prepare_queries(metric, C)
            payload.update(qids=cids, d=d)
            out = out.mapInArrow(_assign_kernel(spark.sparkContext.broadcast(payload), metric, vec_col, first), schema)
            first = False
    if first:
        raise ValueError("no centroids")
    return out


def _node_kernel(bc, metric: str, vec_col: str, d: int):
    """Nearest upper center of a row, then the nearest list of that node; rows of nodes that this broadcast lacks pass on."""

    def run(batches):
        uppers, nodes, lists, payload = bc.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = rb.column(vec_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)
            with np.errstate(invalid="ignore"):
                node = np.argmax(kmeans.unit_rows(X) @ uppers.T, axis=1)  # nodes are numbered 0, 1, ... in the order of their centers
            best, dist = rb.column("list_id").to_pylist(), rb.column("centroid_distance").to_pylist()
            usable = np.isfinite(X).all(axis=1) & (X != 0).any(axis=1)
            for u in np.unique(node[usable]):
                own = slice(*np.searchsorted(nodes, [u, u + 1]))
                if own.start == own.stop:
                    continue
                rows = np.flatnonzero((node == u) & usable)
                step = max(1, _ASSIGN_BLOCK // max(1, 8 * (own.stop - own.start)))
                for s in range(0, len(rows), step):
                    part = rows[s : s + step]
                    D = knn.distances(metric, payload, np.arange(own.start, own.stop), X[part])
                    j = np.argmin(D, axis=0)
                    for r, c, v in zip(part.tolist(), lists[own][j].tolist(), D[j, np.arange(len(part))].tolist()):
                        best[r], dist[r] = (c, v) if np.isfinite(v) else (None, None)
            names = [n for n in rb.schema.names if n not in ("list_id", "centroid_distance")]
            yield pa.RecordBatch.from_arrays([*(rb.column(n) for n in names), pa.array(best, pa.int64()), pa.array(dist, pa.float64())], names=[*names, "list_id", "centroid_distance"])

    return run


def _assign_by_node(items: DataFrame, centroids: DataFrame, metric: str, vec_col: str, limit: int) -> DataFrame:
    """:func:`assign` for trained lists: broadcasts hold the upper centers and the lists of some nodes each."""
    n, d = knn.query_stats(centroids, "centroid")
    if not n:
        raise ValueError("no centroids")
    chunks = max(1, -(-n * d * 8 // limit))
    spark = items.sparkSession
    ship_package(spark)
    upper = centroids.groupBy("node").agg(F.first("upper").alias("upper")).orderBy("node")
    node_ids, uppers = knn.collect_query_matrix(upper, "node", "upper", d)  # n^(1/4) rows
    out = items.drop("list_id", "centroid_distance").where(F.col(vec_col).isNotNull() & (F.size(vec_col) == d))
    out = out.withColumns({"list_id": F.lit(None).cast("long"), "centroid_distance": F.lit(None).cast("double")})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
    for c in range(chunks):
        part = centroids.where(F.pmod(F.col("node"), F.lit(chunks)) == c).orderBy("node", "list_id")
        rows = part.select("node", "list_id", F.col("centroid").alias("v")).toArrow()
        if not rows.num_rows:
            continue
        place = np.searchsorted(node_ids, rows.column("node").to_numpy())
        C = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        shared = spark.sparkContext.broadcast((kmeans.unit_rows(uppers), place, rows.column("list_id").to_numpy(), knn.prepare_queries(metric, C)))
        out = out.mapInArrow(_node_kernel(shared, metric, vec_col, d), schema)
    return out


def write_postings(assigned: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding",
                   num_partitions: int | None = None, keep: Sequence[str] = ()) -> None:
    """Write postings partitioned by list; a range repartition on (list_id, id)
    splits an oversized list over several writers and keeps files per task few.
    Without ``num_partitions`` AQE sizes the writers from the shuffle bytes."""
    rows = assigned.where(F.col("list_id").isNotNull()).select(
        "list_id", *keep, F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")
    )
    ranged = (rows.repartitionByRange(num_partitions, "list_id", "id") if num_partitions
              else rows.repartitionByRange("list_id", "id"))
    ranged.write.mode("overwrite").partitionBy("list_id").parquet(path)


@dataclass
class IvfIndex:
    centroids: DataFrame
    postings: DataFrame
    lists: int
    metric: str
    path: str | None = None
    kind: str = "pivot"


def build(items: DataFrame, centroids: DataFrame, lists: int, path: str | None = None, metric: str = "cosine",
          kind: str = "pivot") -> IvfIndex:
    """Assign every item and store the postings, under the shared folder where no ``path`` is given."""
    path = path or scratch_path(items.sparkSession, "postings")
    write_postings(assign(items, centroids, metric), path)
    post = items.sparkSession.read.parquet(path)
    return IvfIndex(centroids, post, lists, metric, path, kind)


def probe_lists(index: IvfIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(qid, list_rank, list_id) of the ``probes`` nearest lists of every query."""
    cents = index.centroids.select(F.col("list_id").alias("id"), F.col("centroid").alias("embedding"))
    near = knn.knn_join(cents, queries, min(probes, index.lists), index.metric)
    return near.select("qid", F.col("rk").alias("list_rank"), F.col("id").alias("list_id"))


def routed_topk(index: IvfIndex, queries: DataFrame, probed: DataFrame, k: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Candidates (group..., list_id, qid, id, distance): top-k of every probed list's blocks.

    Probes are rows (list_id, qid) that meet the stored postings by list, in
    bounded blocks of both (``knn.meet_in_blocks``); lists that no query
    probes fall out at the join with the blocks."""
    dim = knn.query_stats(queries, "embedding")[1]
    asked = probed.select("qid", "list_id").join(queries.select("qid", "embedding"), "qid")
    return knn.meet_in_blocks(index.postings, asked, k, index.metric, dim, key=["list_id"], group_cols=group_cols)


@dataclass
class Routes:
    """A bounded block of queries with the lists that each one probes, nearest first."""

    qids: np.ndarray
    payload: dict
    lists: np.ndarray  # of every probe, sorted: its list
    query: np.ndarray  # of every probe: its query's place
    rank: np.ndarray  # of every probe: 1 for the query's nearest list

    def of(self, list_id: int) -> slice:
        return slice(*np.searchsorted(self.lists, [list_id, list_id + 1]))


def routes(index: IvfIndex, queries: DataFrame, probes: int, k: int, n_states: int = 1,
           limit: int = knn.DEFAULT_BROADCAST_LIMIT) -> Routes | None:
    """The routes of all queries, or None where queries, top-k states, centroids or distances to them pass ``limit`` bytes."""
    n, d = knn.query_stats(queries, "embedding")
    if not d or max(n * (d + 2 * k * n_states), index.lists * d, n * index.lists) * 8 > limit:
        return None
    cents = index.centroids.where(F.col("centroid").isNotNull() & (F.size("centroid") == d))
    cids, C = knn.collect_query_matrix(cents, "list_id", "centroid", d)
    qids, Q = knn.collect_query_matrix(knn._valid_vectors(queries, "embedding", d), "qid", "embedding", d)
    payload = knn.prepare_queries(index.metric, Q)
    if not len(qids) or not len(cids):
        none = np.zeros(0, np.int64)
        return Routes(qids, payload, none, none, none)
    D = knn.nearest_distances(index.metric, payload, np.arange(len(qids)), C, min(probes, len(cids)))
    D, L = knn.select_topk(D, np.broadcast_to(cids, D.shape), min(probes, len(cids)))
    query, rank = np.nonzero(np.isfinite(D))
    lists = L[query, rank]
    order = np.argsort(lists, kind="stable")
    return Routes(qids, payload, lists[order], query[order], rank[order] + 1)


def _scan_kernel(bc, k: int, metric: str, group_cols: tuple[str, ...], classes: tuple[int, ...]):
    """Top-k per (class of the list's rank, group, query) over the postings of a task.

    ``classes`` are ascending probe values; a list of rank r counts for the first value that is at least r."""

    def run(batches):
        r: Routes = bc.value
        d = r.payload["Q"].shape[1]
        kind = np.searchsorted(np.asarray(classes), r.rank)
        state: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def absorb(key, asked, X, ids):
            if key not in state:
                state[key] = (np.full((len(r.qids), k), np.inf), np.full((len(r.qids), k), -1, np.int64))
            knn.keep_nearest(metric, r.payload, asked, X, ids, *state[key])

        for rb in batches:
            number = lambda c: rb.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            X = rb.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)
            cells = np.stack([number(c) for c in ("list_id", *group_cols)], axis=1)
            ids = number("id")
            cell, code = np.unique(cells, axis=0, return_inverse=True)
            for i, (list_id, *group) in enumerate(cell.tolist()):
                at = r.of(list_id)
                rows = np.flatnonzero(code.reshape(-1) == i)
                for c in np.unique(kind[at]):
                    absorb((int(c), *group), r.query[at][kind[at] == c], X[rows], ids[rows])
        for (c, *group), (Dk, Ik) in state.items():
            real = np.isfinite(Dk)
            n = int(real.sum())
            columns = [*group, classes[c]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.full(n, v, np.int64)) for v in columns), pa.array(np.repeat(r.qids, k).reshape(Dk.shape)[real]), pa.array(Ik[real]), pa.array(Dk[real])],
                names=[*group_cols, "probes", "qid", "id", "distance"],
            )

    return run


def _scan(index: IvfIndex, r: Routes, k: int, group_cols: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """Candidates (group..., probes, qid, id, distance) from one map-only pass over the probed lists."""
    spark = index.postings.sparkSession
    ship_package(spark)
    d = r.payload["Q"].shape[1]
    asked = np.unique(r.lists)
    posts = index.postings
    if len(asked) < index.lists:
        posts = posts.where(F.col("list_id").isin(asked.tolist()))
    cols = [F.col(c).cast("long").alias(c) for c in ("list_id", *group_cols, "id")]
    rows = knn._valid_vectors(posts, "embedding", d).select(*cols, "embedding")
    ddl = ", ".join([*(f"{c} long" for c in (*group_cols, "probes", "qid", "id")), "distance double"])
    kernel = _scan_kernel(spark.sparkContext.broadcast(r), k, index.metric, tuple(group_cols), tuple(classes))
    return rows.mapInArrow(kernel, ddl)


def search(index: IvfIndex, queries: DataFrame, k: int, probes: int, group_cols: Sequence[str] = (),
           limit: int = knn.DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Approximate top-k through the ``probes`` nearest lists: (group..., qid, rk, id, distance).

    ``group_cols`` of the postings (e.g. a growth slab) keep separate top-k lists."""
    if probes >= index.lists:  # every list is probed: all postings meet all queries, no route has to be told
        return knn.knn_join(index.postings, queries, k, index.metric, group_cols=group_cols, broadcast_limit_bytes=limit, stored=index.path is not None)
    groups = index.postings.select(*group_cols).distinct().count() if group_cols else 1
    found = routes(index, queries, probes, k, groups, limit)
    if found is not None:
        cands = _scan(index, found, k, group_cols, [max(1, probes)])
    else:
        probed = reliable_checkpoint(probe_lists(index, queries, probes))
        cands = routed_topk(index, queries, probed, k, group_cols)
    return knn.merge_topk(cands, [*group_cols, "qid"], k).select(*group_cols, "qid", "rk", "id", "distance")


def probe_sweep(index: IvfIndex, queries: DataFrame, k: int, probe_values: Sequence[int],
                limit: int = knn.DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Results for every probe value from one pass (E7): (probes, qid, rk, id, distance).

    Top-k is kept per (probe value that a list first counts for, query); value p merges those up to p."""
    values = sorted({int(p) for p in probe_values})
    found = routes(index, queries, max(values), k, len(values), limit)
    if found is not None:
        out = knn.cumulative_topk(_scan(index, found, k, (), values).withColumnRenamed("probes", "_nf_from").withColumn("rk", F.lit(0)),
                                  values, k, slab_col="_nf_from", out_col="probes")
    else:
        probed = reliable_checkpoint(probe_lists(index, queries, max(values)))
        ranked = routed_topk(index, queries, probed, k).join(probed, ["qid", "list_id"])
        arr = F.array(*[F.lit(p) for p in values])
        exploded = ranked.withColumn("probes", F.explode(F.filter(arr, lambda p: p >= F.col("list_rank"))))
        out = knn.merge_topk(exploded, ["probes", "qid"], k)
    return out.select(F.col("probes").cast("long").alias("probes"), "qid", "rk", "id", "distance")


def list_sizes(index: IvfIndex) -> DataFrame:
    return index.postings.groupBy("list_id").agg(F.count(F.lit(1)).alias("n_rows"))

