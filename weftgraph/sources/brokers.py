"""Brokers beside files and Kafka. Kinesis is polled shard by shard; brokers that push (MQTT, WebSocket,
Zenoh) are landed as JSON-lines files, which the file source then reads, so that what has been received can
be read again after a failure. Each needs its own client library, which is imported when it is used."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

from .readers import Client


class Kinesis(Client):
    """Options: stream, region, endpoint_url (optional), id_field, topic (the stream's name if absent). A position
    is the number of milliseconds since 1970 up to which a shard has been read, so a range of positions is a
    range of arrival times."""

    def _api(self) -> Any:
        import boto3

        return boto3.client("kinesis", region_name=self.options.get("region"), endpoint_url=self.options.get("endpoint_url"))

    def latest(self) -> dict[str, int]:
        now, api, out, more = int(time.time() * 1000), self._api(), {}, {"StreamName": self.options["stream"]}
        while True:
            page = api.list_shards(**more)
            out |= {s["ShardId"]: now for s in page["Shards"]}
            if not page.get("NextToken"):
                return out
            more = {"NextToken": page["NextToken"]}

    def read(self, shard: str, start: int, end: int) -> Iterator[tuple]:
        api, stream = self._api(), self.options["stream"]
        at = api.get_shard_iterator(StreamName=stream, ShardId=shard, ShardIteratorType="AT_TIMESTAMP", Timestamp=start / 1000)["ShardIterator"]
        while at:
            page = api.get_records(ShardIterator=at, Limit=int(self.options.get("max_batch", 1000)))
            for r in page["Records"]:
                arrived: datetime = r["ApproximateArrivalTimestamp"]
                ms = int(arrived.timestamp() * 1000)
                if ms >= end:
                    return
                if ms >= start:
                    text = r["Data"].decode("utf-8", "replace")
                    yield event_of(text, self.options.get("id_field"), arrived, self.options.get("topic", stream), r["SequenceNumber"])
            at = page.get("NextShardIterator")
            if not page["Records"] and page.get("MillisBehindLatest", 0) == 0:
                return


def event_of(text: str, id_field: str | None, arrived: datetime | None, topic: str, fallback: str) -> tuple:
    """(event_id, event_time, topic, payload); the id is the payload's field, or the broker's own."""
    try:
        held = json.loads(text)
    except ValueError:
        held = None
    ident = held.get(id_field) if isinstance(held, dict) and id_field else None
    return str(ident if ident is not None else fallback), arrived, topic, text


class Landing:
    """Writes messages as JSON-lines files in a folder, one file for `max_rows` messages or `max_seconds`. A file
    appears under its final name when it is whole."""

    def __init__(self, folder: str, max_rows: int = 1000, max_seconds: float = 1.0):
        self.folder, self.max_rows, self.max_seconds = folder, max_rows, max_seconds
        self.rows: list[str] = []
        self.since, self.lock = time.monotonic(), threading.Lock()
        os.makedirs(folder, exist_ok=True)

    def add(self, payload: str | bytes) -> None:
        text = payload.decode("utf-8", "replace") if isinstance(payload, bytes) else payload
        with self.lock:
            self.rows.append(text.replace("\n", " "))
            if len(self.rows) >= self.max_rows or time.monotonic() - self.since >= self.max_seconds:
                self._flush()

    def flush(self) -> None:
        with self.lock:
            self._flush()

    def _flush(self) -> None:
        if self.rows:
            name = f"{time.time_ns()}-{uuid.uuid4().hex}"
            hidden = os.path.join(self.folder, f".{name}")
            with open(hidden, "w", encoding="utf-8") as f:
                f.write("\n".join(self.rows) + "\n")
            os.replace(hidden, os.path.join(self.folder, f"{name}.jsonl"))
        self.rows, self.since = [], time.monotonic()


def mqtt(landing: Landing, host: str, topic: str, *, port: int = 1883, qos: int = 1, client_id: str = "", clean: bool = False) -> Callable[[], None]:
    """Lands an MQTT subscription; returns what stops it."""
    import paho.mqtt.client as paho

    client = paho.Client(client_id=client_id or f"weft-{uuid.uuid4().hex}", clean_session=clean)
    client.on_connect = lambda c, *_: c.subscribe(topic, qos)
    client.on_message = lambda _c, _u, m: landing.add(m.payload)
    client.connect(host, port)
    client.loop_start()

    def stop() -> None:
        client.loop_stop()
        client.disconnect()
        landing.flush()

    return stop


def websocket(landing: Landing, url: str, *, hello: str | None = None) -> Callable[[], None]:
    """Lands a WebSocket's messages, connecting again when it closes; hello: sent after each connect."""
    import websocket as ws

    stopped = threading.Event()
    app = ws.WebSocketApp(url, on_open=lambda a: a.send(hello) if hello else None, on_message=lambda _a, m: landing.add(m))

    def run() -> None:
        while not stopped.is_set():
            app.run_forever()
            stopped.wait(1.0)

    threading.Thread(target=run, daemon=True).start()

    def stop() -> None:
        stopped.set()
        app.close()
        landing.flush()

    return stop


def zenoh(landing: Landing, key_expression: str, config: Any = None) -> Callable[[], None]:
    """Lands a Zenoh subscription."""
    import zenoh as z

    session = z.open(config if config is not None else z.Config())
    held = session.declare_subscriber(key_expression, lambda sample: landing.add(bytes(sample.payload)))

    def stop() -> None:
        held.undeclare()
        session.close()
        landing.flush()

    return stop
