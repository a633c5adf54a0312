"""Domain packages (declared labels, properties, event mappings) and recipes (bundles of standing queries,
sources and outputs), from dictionaries or JSON/YAML text."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.eventlog import TYPE_NAMES
from ..streaming.standing import TRANSITION, Runner, StandingQuery, query_of, transition_stream


def loaded(text: str | dict) -> dict:
    if isinstance(text, dict):
        return text
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # optional: only for YAML text

        return yaml.safe_load(text)


@dataclass
class DomainPackage:
    name: str
    labels: dict[str, list[dict]] = field(default_factory=dict)
    edge_types: list[str] = field(default_factory=list)
    mappings: list[dict] = field(default_factory=list)
    standing_queries: list[dict] = field(default_factory=list)
    views: list[dict] = field(default_factory=list)

    @classmethod
    def of(cls, text: str | dict) -> DomainPackage:
        d = loaded(text)
        return cls(d["name"], {x["name"]: x.get("properties", []) for x in d.get("labels", [])}, [x["name"] if isinstance(x, dict) else x for x in d.get("edge_types", [])], d.get("event_mappings", d.get("mappings", [])), d.get("standing_queries", []), d.get("materialized_views", []))

    def problems(self) -> list[str]:
        out = []
        for label, props in self.labels.items():
            names = [p["name"] for p in props]
            out += [f"{label}: {n} is declared twice" for n in {x for x in names if names.count(x) > 1}]
            out += [f"{label}.{p['name']}: min is over max" for p in props if p.get("min") is not None and p.get("max") is not None and p["min"] > p["max"]]
        out += [f"a mapping names the unknown label {m['label']}" for m in self.mappings if m.get("label") not in self.labels]
        return out

    def valid(self, label: str) -> Column:
        """Whether a row of the label's columns keeps to the declarations."""
        ok = F.lit(True)
        for p in self.labels[label]:
            x = F.col(p["name"])
            if p.get("required"):
                ok = ok & x.isNotNull()
            if p.get("enum_values"):
                ok = ok & (x.isNull() | x.isin(*p["enum_values"]))
            if p.get("min") is not None:
                ok = ok & (x.isNull() | (x >= p["min"]))
            if p.get("max") is not None:
                ok = ok & (x.isNull() | (x <= p["max"]))
        return ok

    def vertices(self, events: DataFrame, mapping: dict, payload: str = "payload") -> DataFrame:
        """id and typed properties of the events that the mapping describes ({label, id, properties: {name: $.path}})."""
        types = {p["name"]: TYPE_NAMES.get(p.get("type", "string"), "string") for p in self.labels[mapping["label"]]}
        defaults = {p["name"]: p["default"] for p in self.labels[mapping["label"]] if "default" in p}
        at = lambda path: F.get_json_object(payload, path)
        cols = []
        for name, path in mapping.get("properties", {}).items():
            x = at(path).try_cast(types.get(name, "string"))
            cols.append((F.coalesce(x, F.lit(defaults[name])) if name in defaults else x).alias(name))
        return events.select(at(mapping["id"]).alias("id"), *cols).where("id is not null")


@dataclass
class Recipe:
    name: str
    standing_queries: list[StandingQuery]
    sources: list[dict]
    outputs: list[dict]

    @classmethod
    def of(cls, text: str | dict) -> Recipe:
        d: dict[str, Any] = loaded(text)
        queries = [query_of(q) for q in d.get("standing_queries", [])]
        return cls(d.get("name", "recipe"), queries, d.get("ingest_sources", []), d.get("outputs", []))

    def start(self, spark: SparkSession, checkpoint: str, *, available_now: bool = False) -> list[StreamingQuery]:
        """Starts what the recipe describes: each source's events become field changes, the standing queries run
        on them, and what they report goes to every output. A source is {type: file | poll, ...}, an output
        {type: file | console | drop | webhook | kafka, ...}."""
        from ..operators.eventlog import field_records
        from . import readers, sinks

        registry = sinks.Registry()
        for i, o in enumerate(self.outputs):
            registry.register(str(o.get("name", i)), sinks.made(o))
        plain, started = [q for q in self.standing_queries if not q.hops], []
        linked = [q for q in self.standing_queries if q.hops]
        for i, s in enumerate(self.sources):
            if s["type"] == "file":
                events = readers.json_lines(spark, s["path"], s.get("topic", self.name), s["id_field"], s.get("event_time_field"))
            elif s["type"] == "poll":
                events = readers.polled(spark, s["client"], **s.get("options", {}))
            elif s["type"] == "kafka":
                events = readers.kafka(spark, s["brokers"], s["topic"], key_field=s.get("id_field"))
            else:
                raise ValueError(f"unknown source {s['type']!r}")
            rows = field_records(events.withColumn("event_time_us", F.coalesce(F.unix_micros("event_time"), F.lit(0).cast("long"))), s["id_field"])
            changes = rows.select("qid", "key", "value", "event_time_us", F.col("event_time_us").alias("seq"))
            if plain:
                out = transition_stream(changes, plain).writeStream.foreachBatch(registry.fan_out)
                started.append(_go(out, f"{checkpoint}/{i}", available_now))
            if linked:  # a field named edge:TYPE holds the target of a relationship
                is_edge = F.col("key").startswith("edge:")
                log = changes.select("qid", F.when(is_edge, "add_edge").otherwise("set").alias("op"), F.when(is_edge, F.substring_index("key", ":", -1)).otherwise(F.col("key")).alias("key"), "value", F.col("event_time_us").alias("event_time"), "seq")
                runner = Runner(spark, f"{checkpoint}/{i}-state", linked)

                def handle(batch: DataFrame, batch_id: int, runner=runner) -> None:
                    runner(batch, batch_id)
                    registry.fan_out(runner._read("results", batch_id, TRANSITION), batch_id)

                started.append(_go(log.writeStream.foreachBatch(handle), f"{checkpoint}/{i}-edges", available_now))
        return started


def _go(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
