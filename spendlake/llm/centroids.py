"""Centroid clustering with ns-bounds.

Lloyd's rounds on integer vectors. Every vector carries an upper bound of the distance to its own
centroid, a lower bound for every centroid, and the round in which each bound was measured. The
history of all centroids is kept, so a bound measured in round ``T`` is loosened in round ``t`` by
``|c_j(t) - c_j(T)|``, the norm of the total displacement, which is at most the sum of the drifts
of the single rounds. A centroid whose loosened lower bound lies above the loosened upper bound
can neither win nor tie. All others fail and are measured again with exact integers; then the
smallest distance wins, ties go to the smaller number. Bounds are rounded outwards.

A round is one ``mapInArrow`` over the written vectors (state travels with its vector, no shuffle),
then sums by (cluster, dimension). Only the sums of ``k`` centroids come to the driver.

Rows whose vector is null, has another length, or a null or non-finite component are left out;
components saturate at ``vectors.LIMIT`` after scaling. Null ids are kept, but start no centroid
unless no other rows are left; repeated rows count as often as they occur; with fewer rows than ``k``
there are as many clusters as rows; an empty table gives no rows. Columns other than the id
and the vector are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import small_batches, written
from spendlake.llm.vectors import padded, quantised

#: Vectors of one Arrow batch.
BATCH = 4096
STATE = "vec_id long, v binary, cluster int, distance long, upper float, upper_at int, lower binary, lower_at binary"


def vectors_of(df: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` (``dims`` 32-bit integers) of the rows that take part."""
    def run(batches):
        for b in batches:
            usable, lens, flat = quantised(b.column("v"), scale)
            right = lens == dims
            ids = b.column("vec_id").filter(pa.array(usable)).filter(pa.array(right))
            m = padded(np.where(right, dims, 0), flat[np.repeat(right, lens)], dims)[right]
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in m], pa.binary())], names=["vec_id", "v"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(run, "vec_id long, v binary")


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors of the ``k`` ids with the smallest sha256 of ``salt`` and id (equal ids: by content)."""
    chosen = (vectors.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v")
              .limit(k).select("v").collect())
    return np.array([np.frombuffer(r["v"], np.int32) for r in chosen], np.int64)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-6)).astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))


def measure(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids (row by row)."""
    d = m.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def reassign(m, cluster, upper, upper_at, lower, lower_at, history: np.ndarray) -> int:
    """One round, in place: centroids are ``history[-1]``, bounds are of earlier rounds. Returns the
    number of distances measured."""
    now, rows, k = len(history) - 1, np.arange(len(m)), history.shape[1]
    moved = _up(np.sqrt(((history - history[-1]).astype(float) ** 2).sum(axis=2)))  # round x centroid
    low = lower - moved[lower_at, np.arange(k)]
    high = upper + moved[upper_at, cluster]
    open_ = low <= high[:, None] + 1e-3
    open_[rows, cluster] = False
    measured = 0
    some = np.flatnonzero(open_.any(axis=1))
    if len(some):  # tighten the own distance first: it may close all
        own = np.sqrt(measure(m[some], history[-1][cluster[some]]).astype(float))
        measured += len(some)
        upper[some], upper_at[some] = _up(own), now
        lower[some, cluster[some]], lower_at[some, cluster[some]] = _down(own), now
        open_[some] &= low[some] <= upper[some][:, None] + 1e-3
    i, j = np.nonzero(open_)
    if len(i):
        exact = measure(m[i], history[-1][j])
        measured += len(i)
        root = np.sqrt(exact.astype(float))
        lower[i, j], lower_at[i, j] = _down(root), now
        best = np.lexsort((j, exact, i))
        best = best[np.append(True, i[best][1:] != i[best][:-1])]
        r, to, d = i[best], j[best], exact[best]
        own = measure(m[r], history[-1][cluster[r]])
        wins = (d < own) | ((d == own) & (to < cluster[r]))
        r = r[wins]
        cluster[r], upper[r], upper_at[r] = to[wins], _up(root[best][wins]), now
    return measured


def _round(state: DataFrame, history: np.ndarray, fresh: bool, last: bool) -> DataFrame:
    dims, k = history.shape[2], history.shape[1]

    def run(batches):
        for b in batches:
            n = b.num_rows
            m = np.frombuffer(b"".join(b.column("v").to_pylist()), np.int32).reshape(n, dims)
            if fresh:
                d = np.array([measure(m, c) for c in history[-1]]).reshape(k, n).T
                cluster, root = d.argmin(axis=1), np.sqrt(d.astype(float))
                upper, upper_at = _up(root[np.arange(n), cluster]), np.zeros(n, np.int64)
                lower, lower_at = _down(root), np.zeros((n, k), np.uint8)
            else:
                column = lambda c: b.column(c).to_numpy(zero_copy_only=False).copy()
                cluster, upper, upper_at = column("cluster"), column("upper"), column("upper_at")
                lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.float32).reshape(n, k).copy()
                lower_at = np.frombuffer(b"".join(b.column("lower_at").to_pylist()), np.uint8).reshape(n, k).copy()
                reassign(m, cluster, upper, upper_at, lower, lower_at, history)
            exact = measure(m, history[-1][cluster]) if last else np.zeros(n, np.int64)
            blank = [None] * n
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(blank, pa.binary()) if last else b.column("v"), pa.array(cluster, pa.int32()),
                 pa.array(exact, pa.int64()), pa.array(upper, pa.float32()), pa.array(upper_at, pa.int32()),
                 *(pa.array(blank if last else [r.tobytes() for r in x], pa.binary()) for x in (lower, lower_at))],
                names=["vec_id", "v", "cluster", "distance", "upper", "upper_at", "lower", "lower_at"])

    return written(state.mapInArrow(run, STATE), "ns-bounds")


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every cluster's vectors; an empty cluster stays."""
    k, dims = centroids.shape

    def run(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            m = np.frombuffer(b"".join(b.column("v").to_pylist()), np.int32).reshape(b.num_rows, dims)
            cluster = b.column("cluster").to_numpy()
            for j in np.unique(cluster):
                total[j] += m[cluster == j].sum(axis=0, dtype=np.int64)
                count[j] += (cluster == j).sum()
        at = np.flatnonzero(np.repeat(count > 0, dims))
        yield pa.RecordBatch.from_arrays([pa.array(at // dims, pa.int32()), pa.array(at % dims, pa.int32()),
                                          pa.array(total.reshape(-1)[at], pa.int64()), pa.array(count[at // dims], pa.int64())],
                                         names=["cluster", "dim", "total", "n"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, dim int, total long, n long")
    new = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k x dims rows
        new[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return new


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1:",
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per vector: ``vec_id, cluster, distance`` (squared, to its final centroid), ``cluster_inertia``,
    ``inertia`` (distances summed over its cluster and over all) and ``centroid_sha256`` (of the final
    centroid's components as decimal integers joined by commas)."""
    spark = df.sparkSession
    small_batches(spark, BATCH)
    state = written(vectors_of(df, dims, scale, id_col, vec_col), "vectors")
    history = first_centroids(state, k, salt)[None]
    if not history.size:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for t in range(rounds + 1):
        state = _round(state, history, fresh=t == 0, last=t == rounds)
        if t < rounds:
            history = np.append(history, moved_centroids(state, history[-1])[None], axis=0)
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return state.select("vec_id", "cluster", "distance", at([sums.get(j, 0) for j in range(len(shas))]).cast("long").alias("cluster_inertia"),
                        F.lit(sum(sums.values())).cast("long").alias("inertia"), at(shas).alias("centroid_sha256"))
