"""Ingest: a stream of events to event tables, graph changes and sinks, one checkpoint per query."""

from __future__ import annotations

import json
import queue
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import eventlog


def event_batches(routes: dict[str, str], table_path: str, to_graph: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: events go to the event table (under the batch's number, so that a
    repeated batch replaces itself), then to the graph."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        table, graph = eventlog.routed(batch, routes)
        batch.persist()
        eventlog.append(table, table_path, batch_id)
        if to_graph is not None:
            to_graph(graph, batch_id)
        batch.unpersist()

    return handle


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, available_now: bool = False, every: str = "1 second") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def watermark_of(query: StreamingQuery) -> str | None:
    """The stream's present watermark, as its last progress tells it."""
    last = query.lastProgress
    return last["eventTime"].get("watermark") if last and last.get("eventTime") else None


def dropped_late(query: StreamingQuery) -> int:
    """Events dropped for being behind the watermark, over the kept progress reports."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p.get("stateOperators", []))


def min_watermark_policy(spark: SparkSession) -> None:
    """The global watermark of several inputs is the least of theirs."""
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")


def graph_sink(session, types: dict[str, dict[str, str]] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts field records (qid, label, key, value, event_time_us) into a session's
    graph: nodes by label with their properties, the latest write of each; a key `edge:TYPE:Label` is a
    relationship to the node of that label whose id is the value. A batch that is repeated changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        known = lambda label, key: (types or {}).get(label, {}).get(key, "string")
        for label in sorted(r.label for r in batch.select("label").distinct().where("label is not null").collect()):
            own = batch.where(F.col("label") == label)
            props = own.where(~F.col("key").startswith("edge:"))
            keys = sorted(r.key for r in props.select("key").distinct().collect())  # a schema's worth
            last = props.groupBy("qid", "key").agg(F.max_by("value", "event_time_us").alias("value"))
            wide = last.groupBy(F.col("qid").cast(known(label, "id")).alias("id")).pivot("key", keys).agg(F.first("value")) if keys else own.select(F.col("qid").cast(known(label, "id")).alias("id")).distinct()
            session.merge_nodes(label, wide.select("id", *[F.col(f"`{k}`").cast(known(label, k)).alias(k) for k in keys]))
            links = own.where(F.col("key").startswith("edge:")).withColumn("p", F.split("key", ":"))
            for r in links.select(F.col("p")[1].alias("t"), F.col("p")[2].alias("l")).distinct().collect():
                rows = links.where((F.col("p")[1] == r.t) & (F.col("p")[2] == r.l))
                session.merge_edges(r.t, label, r.l, rows.select(F.col("qid").cast(known(label, "id")).alias("src"), F.col("value").cast(known(r.l, "id")).alias("dst")))
        batch.unpersist()

    return handle


@dataclass
class MicrobatchWriter:
    """Collects single events and writes them as snapshots of an event table when there are `max_events` or the
    oldest has waited `max_ms`. adaptive: a write that takes longer than `max_ms` doubles the next batch's
    size (up to 64 times the first), a fast one halves it again."""

    spark: SparkSession
    path: str
    schema: str
    max_events: int = 1000
    max_ms: int = 100
    adaptive: bool = True
    snapshot: int = 0
    rows: list[dict] = field(default_factory=list)
    since: float = 0.0
    size: int = 0

    def add(self, event: dict) -> bool:
        """Whether this event made a snapshot."""
        if not self.rows:
            self.since = time.monotonic()
        self.rows.append(event)
        if len(self.rows) >= (self.size or self.max_events) or (time.monotonic() - self.since) * 1000 >= self.max_ms:
            self.flush()
            return True
        return False

    def flush(self) -> None:
        if not self.rows:
            return
        start = time.monotonic()
        eventlog.append(self.spark.createDataFrame(self.rows, self.schema), self.path, self.snapshot)
        self.rows, self.snapshot = [], self.snapshot + 1
        if self.adaptive:
            slow = (time.monotonic() - start) * 1000 > self.max_ms
            self.size = min(64 * self.max_events, 2 * (self.size or self.max_events)) if slow else max(self.max_events, (self.size or self.max_events) // 2)


@dataclass
class Subscription:
    """A stream's rows for one reader on the driver, as JSON texts: a bounded queue, which holds the stream back when
    the reader is slow."""

    stream: DataFrame
    checkpoint: str
    bound: int = 1000
    query: StreamingQuery | None = None

    def __iter__(self) -> Iterator[dict]:
        held: queue.Queue = queue.Queue(self.bound)

        def put(batch: DataFrame, batch_id: int) -> None:
            for r in batch.select(F.to_json(F.struct("*"))).toLocalIterator():
                held.put(r[0])

        self.query = self.stream.writeStream.foreachBatch(put).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        while self.query.isActive or not held.empty():
            try:
                yield json.loads(held.get(timeout=0.1))
            except queue.Empty:
                continue
