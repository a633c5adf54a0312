"""Exact k nearest neighbours: stated queries against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package

METRICS = ("l2", "cosine", "ip")
#: Bytes of a block of queries, which is broadcast.
BLOCK_BYTES = 16 << 20


def checked_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r}: one of {METRICS}")
    return metric


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles; vectors must have one length."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def prepared(v: np.ndarray, metric: str) -> np.ndarray:
    """For cosine: unit vectors (a zero vector stays zero)."""
    if metric != "cosine" or not len(v):
        return v
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """l2: Euclidean; cosine: 1 - similarity (1 for a zero vector); ip: negated inner product."""
    if metric == "l2":
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)[None], 0))
    return (1.0 if metric == "cosine" else 0.0) - prepared(q, metric) @ prepared(v, metric).T


def best_of_batch(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, metric: str, k: int, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id, distance: the k best of all batches (vec_id, vector[, list]) for each query, ties by
    vec_id; with `wanted` only vectors whose list a query wants."""
    best_d = np.full((len(ids), 0), np.inf)
    best_i = np.zeros((len(ids), 0), np.int64)
    for whole in batches:
        for lo in range(0, whole.num_rows, 2048):
            b = whole.slice(lo, 2048)
            v, names = matrix(b.column(1)), np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)
            d = distances(q, v, metric)
            if metric == "l2":  # the expanded form loses digits where vectors are nearly equal
                for i, j in zip(*np.nonzero(d < 1e-3 * (1 + np.abs(q).max())), strict=True):
                    d[i, j] = np.sqrt(((q[i] - v[j]) ** 2).sum())
            if wanted is not None:
                d = np.where(wanted[np.asarray(b.column(2).to_numpy(), np.int64)].T, d, np.inf)
            all_d, all_i = np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(names, d.shape)])
            order = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best_d, best_i = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
    held = np.isfinite(best_d)
    if held.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, held.sum(1)), pa.int64()), pa.array(best_i[held], pa.int64()), pa.array(best_d[held], pa.float64())], ["query_id", "vec_id", "distance"])


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", *, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, vec_id, distance, rank of the k nearest vectors of each query (ties by vec_id).

    The stated queries meet all vectors in blocks: the driver passes on one block of queries (BLOCK_BYTES at
    most) after the other and never holds more than that; each task multiplies its vectors with the
    block and keeps its k best a query, and only those are shuffled."""
    checked_metric(metric)
    spark, out = vectors.sparkSession, None
    ship_package(spark)
    held = vectors.where(F.col(vec).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("embedding"))
    rows = queries.where(F.col(vec).isNotNull()).select(F.col(vec_id).cast("long"), vec).toLocalIterator()
    width = queries.select(F.max(F.size(vec))).first()[0] or 1
    block = max(1, BLOCK_BYTES // (8 * width))
    while some := [r for _, r in zip(range(block), rows)]:
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in some]), np.array([r[1] for r in some], float)))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from best_of_batch(batches, *sent.value, metric, k)

        part = held.mapInArrow(look, "query_id long, vec_id long, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, distance double, rank int")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
