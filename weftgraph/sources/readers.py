"""Stream and batch sources. Built-in readers where Spark has one; `PollSource` adapts any client that
can be polled (brokers whose connector isn't on the class path) to Spark's Python data source."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.temporal import event_time
from ..shipping import ship_package

RAW = "event_id string, event_time timestamp, topic string, payload string"


def json_lines(spark: SparkSession, path: str, topic: str, id_field: str, event_time_field: str | None = None, *, stream: bool = True, max_files: int = 256) -> DataFrame:
    """RAW events of JSON-lines files; lines that aren't objects are skipped."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if stream else spark.read
    rows = reader.format("text").load(path).where(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    when = event_time(F.get_json_object("value", f"$.{event_time_field}")) if event_time_field else F.lit(None).cast("timestamp")
    return rows.select(F.get_json_object("value", f"$.{id_field}").alias("event_id"), when.alias("event_time"), F.lit(topic).alias("topic"), F.col("value").alias("payload"))


def kafka(spark: SparkSession, brokers: str, topic: str, *, group: str | None = None, key_field: str | None = None, starting: str = "earliest", max_offsets: int = 100_000) -> DataFrame:
    """RAW events of a topic (needs the Kafka connector on the class path)."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", starting).option("maxOffsetsPerTrigger", max_offsets)
    if group:
        r = r.option("kafka.group.id", group)
    payload = F.col("value").cast("string")
    ident = F.get_json_object(payload, f"$.{key_field}") if key_field else F.col("key").cast("string")
    return r.load().select(ident.alias("event_id"), F.col("timestamp").alias("event_time"), F.col("topic"), payload.alias("payload"))


class Client:
    """What a polled source needs of a broker: its shards' newest positions, and the records between two
    positions of one shard. A record is (event_id, event_time, topic, payload); positions are integers, and the
    same positions give the same records again."""

    def __init__(self, options: dict):
        self.options = options

    def latest(self) -> dict[str, int]:
        raise NotImplementedError

    def read(self, shard: str, start: int, end: int) -> Iterator[tuple]:
        raise NotImplementedError


class Scripted(Client):
    """A client for tests: the option `records`, a JSON list of [event_id, topic, payload] for each of the
    `shards`, dealt in turn."""

    def _own(self, shard: str) -> list:
        n = int(self.options.get("shards", 1))
        return json.loads(self.options["records"])[int(shard) :: n]

    def latest(self) -> dict[str, int]:
        return {str(i): len(self._own(str(i))) for i in range(int(self.options.get("shards", 1)))}

    def read(self, shard: str, start: int, end: int) -> Iterator[tuple]:
        for i, topic, payload in self._own(shard)[start:end]:
            yield i, None, topic, payload


def _client(options: dict) -> Client:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


class PollSource(DataSource):
    """format("weft_poll"): reads a broker through a Client, one partition a shard, so records go from the broker to
    the executors and never through the driver. The option `client` names its class as "module:Class"
    (looked up where the reader runs)."""

    @classmethod
    def name(cls) -> str:
        return "weft_poll"

    def schema(self) -> str:
        return RAW

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Poll(self.options)


@dataclass
class _Shard(InputPartition):
    name: str
    start: int
    end: int


class _Poll(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return _client(self.options).latest()

    def partitions(self, start: dict, end: dict) -> list[_Shard]:
        return [_Shard(s, start.get(s, 0), n) for s, n in sorted(end.items()) if n > start.get(s, 0)]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        return iter(_client(self.options).read(partition.name, partition.start, partition.end))

    def commit(self, end: dict) -> None:
        """Positions are Spark's; brokers that need no acknowledgement get none."""


def polled(spark: SparkSession, client: str, **options: str) -> DataFrame:
    """RAW events of a polled client, as a stream."""
    ship_package(spark)
    spark.dataSource.register(PollSource)
    return spark.readStream.format("weft_poll").option("client", client).options(**options).load()


def csv_rows(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.option("header", header).csv(path)
