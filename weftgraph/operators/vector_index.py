"""An inverted-file index for approximate nearest neighbours, and its maintenance.

Centroids are fitted on a bounded sample (at most SAMPLE vectors); every vector is then assigned to its
nearest centroid and stored with it. A search looks through the lists of the `probes` centroids nearest
to each query. Assignment and search are Arrow batches of matrix products; lists of any length are
spread over tasks, since each task meets its part of a list and keeps its k best a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..shipping import ship_package
from .knn import best_of_batch, checked_metric, matrix, prepared

#: Vectors that centroids are fitted on, at most.
SAMPLE = 20_000


def fitted(vectors: np.ndarray, lists: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's iterations from vectors picked at random; an empty list takes the vector that lies farthest out."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(lists, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        far = ((vectors**2).sum(1)[:, None] - 2 * vectors @ centres.T) + (centres**2).sum(1)[None]
        own = far.argmin(1)
        for i in range(len(centres)):
            mine = vectors[own == i]
            centres[i] = mine.mean(0) if len(mine) else vectors[far.min(1).argmax()]
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """`rows`: vec_id, embedding, list. Insertions and removals give a new index; the centroids stay."""

    rows: DataFrame
    centres: np.ndarray
    metric: str

    @classmethod
    def build(cls, vectors: DataFrame, *, lists: int = 64, metric: str = "l2", vec_id: str = "vec_id", vec: str = "embedding") -> VectorIndex:
        checked_metric(metric)
        df = vectors.where(F.col(vec).isNotNull()).select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("embedding"))
        n = df.count()
        some = df.sample(min(1.0, SAMPLE / max(1, n)), seed=5).limit(SAMPLE) if n > SAMPLE else df
        sample = prepared(np.array([r.embedding for r in some.select("embedding").collect()], float).reshape(-1, _width(df)), metric)
        empty = cls(df.withColumn("list", F.lit(0)).limit(0), fitted(sample, lists) if len(sample) else np.zeros((0, 1)), metric)
        return replace(empty, rows=cut(empty.assigned(df))) if len(sample) else empty

    def assigned(self, df: DataFrame) -> DataFrame:
        """df: vec_id, embedding; with the nearest centroid as `list`."""
        centres, metric = self.centres, self.metric
        kind = df.schema["vec_id"].dataType.simpleString()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = prepared(matrix(b.column(1)), metric)
                    own = (-2 * v @ centres.T + (centres**2).sum(1)[None]).argmin(1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32())], ["vec_id", "embedding", "list"])

        ship_package(df.sparkSession)
        return df.mapInArrow(assign, f"vec_id {kind}, embedding {df.schema['embedding'].dataType.simpleString()}, list int")

    def insert(self, vectors: DataFrame) -> VectorIndex:
        """Adds vectors (vec_id, embedding); one with a known id replaces the old one. An empty index is built from them."""
        if not len(self.centres):
            return VectorIndex.build(vectors, metric=self.metric)
        return replace(self, rows=cut(self.remove(vectors).rows.unionByName(self.assigned(vectors.select("vec_id", "embedding")))))

    def remove(self, ids: DataFrame) -> VectorIndex:
        return replace(self, rows=self.rows.join(ids.select("vec_id").distinct(), "vec_id", "left_anti"))

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, vec_id: str = "vec_id", vec: str = "embedding", block: int = 4096) -> DataFrame:
        """query_id, vec_id, distance, rank of (nearly always) the k nearest vectors of each query. probes: lists to look
        through; three quarters of them if None, which finds over 0.9 of the neighbours even among vectors without
        any structure. Clustered vectors need far fewer."""
        probes = probes or max(1, -(-3 * len(self.centres) // 4))
        spark, out = self.rows.sparkSession, None
        rows = queries.where(F.col(vec).isNotNull()).select(vec_id, vec).toLocalIterator()
        while len(self.centres) and (some := [r for _, r in zip(range(block), rows)]):
            q = prepared(np.array([r[1] for r in some], float), self.metric)
            near = np.argpartition(-2 * q @ self.centres.T + (self.centres**2).sum(1)[None], min(probes, len(self.centres)) - 1, axis=1)[:, :probes]
            wanted = np.zeros((len(self.centres), len(some)), bool)
            wanted[near.ravel(), np.repeat(np.arange(len(some)), near.shape[1])] = True
            sent = spark.sparkContext.broadcast((np.array([r[0] for r in some]), np.array([r[1] for r in some], float), wanted))  # `block` queries
            metric = self.metric

            def look(batches: Iterator[pa.RecordBatch], sent=sent, metric=metric) -> Iterator[pa.RecordBatch]:
                ids, q, wanted = sent.value
                yield from best_of_batch(batches, ids, q, metric, k, wanted)

            part = self.rows.select("vec_id", "embedding", "list").mapInArrow(look, "query_id long, vec_id long, distance double")
            out = part if out is None else out.unionByName(part)
        if out is None:  # no queries, or no vectors
            return spark.createDataFrame([], "query_id long, vec_id long, distance double, rank int")
        w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _width(df: DataFrame) -> int:
    r = df.select(F.size("embedding")).first()
    return r[0] if r else 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact neighbours (query_id, vec_id) that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
