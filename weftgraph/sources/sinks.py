"""Sinks for results: files with rotation, Kafka, web hooks, console, nothing; one result to several of them; and
backups of a graph with checksums."""

from __future__ import annotations

import base64
import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_files(df: DataFrame, path: str, max_rows: int = 100_000) -> None:
    df.write.mode("append").option("maxRecordsPerFile", max_rows).json(path)


@dataclass
class RotatingJson:
    """JSON-lines files of about `max_bytes`, of which the newest `keep` stay (all, if None)."""

    path: str
    max_bytes: int = 100 << 20
    keep: int | None = 5

    def write(self, df: DataFrame) -> None:
        lines = df.select(F.to_json(F.struct("*")).alias("value"))
        n, size = lines.agg(F.count("*"), F.sum(F.octet_length("value") + 1)).first()
        if n:
            lines.write.mode("append").option("maxRecordsPerFile", max(1, n * self.max_bytes // size)).text(self.path)
        self._prune(df.sparkSession)

    def files(self, spark: SparkSession) -> list[str]:
        """The files, oldest first."""
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(self.path).select("path", "modificationTime")
        return [r.path for r in rows.orderBy("modificationTime", "path").collect()]

    def _prune(self, spark: SparkSession) -> None:
        if self.keep is None:
            return
        jvm = spark.sparkContext._jvm
        for path in self.files(spark)[: -self.keep]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)


def console(df: DataFrame, rows: int = 20, pretty: bool = False) -> None:
    """The first rows as JSON on the driver's output, indented if `pretty`."""
    for r in df.select(F.to_json(F.struct("*"))).limit(rows).collect():
        print(json.dumps(json.loads(r[0]), indent=2) if pretty else r[0], flush=True)


def drop(df: DataFrame) -> None:
    """Computes the rows and discards them."""
    df.write.format("noop").mode("append").save()


def kafka_rows(df: DataFrame, key: str = "sq_name") -> DataFrame:
    """key and value as a Kafka writer takes them."""
    return df.select((F.col(key).cast("string") if key in df.columns else F.lit(None).cast("string")).alias("key"), F.to_json(F.struct("*")).alias("value"))


def kafka(df: DataFrame, brokers: str, topic: str, key: str = "sq_name", retries: int = 3) -> None:
    """Writes to a topic (needs the Kafka connector on the class path); a failed send is repeated by the producer."""
    kafka_rows(df, key).write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).option("kafka.retries", retries).option("kafka.acks", "all").save()


def bearer(token: str) -> dict[str, str]:
    return {"Authorization": f"Bearer {token}"}


def basic(user: str, password: str) -> dict[str, str]:
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()}


@dataclass
class Webhook:
    """POSTs each row as JSON from the executors, with retries that wait twice as long each time."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    ok: tuple[int, ...] = (200, 201, 202, 204)
    retries: int = 3
    wait_s: float = 0.5

    def send(self, body: bytes) -> None:
        wait = self.wait_s
        for attempt in range(self.retries + 1):
            try:
                req = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers}, method="POST")
                with urllib.request.urlopen(req, timeout=10) as r:  # noqa: S310
                    if r.status in self.ok:
                        return
                    raise OSError(f"status {r.status}")
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(wait)
                wait *= 2

    def write(self, df: DataFrame) -> None:
        hook = self
        df.select(F.to_json(F.struct("*")).alias("j")).foreachPartition(lambda rows: [hook.send(r.j.encode()) for r in rows] and None)


def change_rows(changes: DataFrame, key: list[str]) -> DataFrame:
    """Changes of a view (op, key, values) as an append log: inserts and updates as rows, deletes as
    tombstones with `_deleted` and `_deleted_at`."""
    gone = F.col("op") == "delete"
    values = [c for c in changes.columns if c not in ("op", *key)]
    return changes.select(*key, *[F.when(~gone, F.col(c)).alias(c) for c in values], gone.alias("_deleted"), F.when(gone, F.current_timestamp()).alias("_deleted_at"))


@dataclass
class Registry:
    """Named sinks; `fan_out` is a foreachBatch function that writes one result to all of them."""

    held: dict[str, Callable[[DataFrame], None]] = field(default_factory=dict)

    def register(self, name: str, write: Callable[[DataFrame], None]) -> None:
        self.held[name] = write

    def fan_out(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for write in self.held.values():
                write(batch)
        finally:
            batch.unpersist()


def made(spec: dict) -> Callable[[DataFrame], None]:
    """A sink from its description: {type: file | console | drop | webhook | kafka, and its options}."""
    options = {k: v for k, v in spec.items() if k not in ("type", "name")}
    if spec["type"] == "file":
        return RotatingJson(**options).write
    if spec["type"] == "console":
        return lambda df: console(df, **options)
    if spec["type"] == "drop":
        return drop
    if spec["type"] == "webhook":
        auth = options.pop("auth", {})
        headers = options.pop("headers", {}) | (bearer(auth["token"]) if "token" in auth else basic(auth["user"], auth["password"]) if auth else {})
        return Webhook(headers=headers, **options).write
    if spec["type"] == "kafka":
        return lambda df: kafka(df, **options)
    raise ValueError(f"unknown sink {spec['type']!r}")


def checksum(df: DataFrame) -> str:
    """Of all rows whatever their order: their number and the sum of their hashes."""
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.to_json(F.struct(c)) if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]).cast("decimal(38,0)"))).first()
    return f"{r[0]}:{r[1] or 0}"


def backup(graph, path: str) -> None:
    """All vertex and edge tables as Parquet, with their schema of labels and types and a checksum of each."""
    spark = graph.spark
    meta = {"vertices": [[t.label, t.extra, checksum(t.df)] for t in graph.vertices.values()], "edges": [[e.rel_type, e.src_label, e.dst_label, list(e.key), checksum(e.df)] for e in graph.edges]}
    for t in graph.vertices.values():
        t.df.write.mode("overwrite").parquet(f"{path}/v/{t.label}")
    for e in graph.edges:
        e.df.write.mode("overwrite").parquet(f"{path}/e/{e.src_label}_{e.rel_type}_{e.dst_label}")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")


def restore(spark, path: str):
    """The graph of a backup; ValueError if a table isn't what was written."""
    from ..catalog import Graph

    def table(name: str, wanted: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        if checksum(df) != wanted:
            raise ValueError(f"{path}/{name}: the checksum differs")
        return df

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    g = Graph(spark)
    for label, extra, wanted in meta["vertices"]:
        g = g.with_vertices(label, table(f"v/{label}", wanted), extra)
    for rel, a, b, key, wanted in meta["edges"]:
        g = g.with_edges(rel, a, b, table(f"e/{a}_{rel}_{b}", wanted), tuple(key))
    return g
