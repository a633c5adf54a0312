"""The event log: append-only event tables, deltas between snapshots, routing, and projections of
events to graph changes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVENANCE = ("event_id", "event_time_us", "ingest_time_us", "source")
RAW_EVENT = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("event_time_us", T.LongType()), T.StructField("ingest_time_us", T.LongType()), T.StructField("source", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("subject", T.StringType()), T.StructField("payload", T.StringType())])
#: Names of declared types in event schemas; anything else is a string.
TYPE_NAMES = {"string": "string", "str": "string", "text": "string", "int": "bigint", "integer": "bigint", "long": "bigint", "float": "double", "double": "double", "number": "double", "bool": "boolean", "boolean": "boolean", "timestamp": "timestamp", "datetime": "timestamp", "date": "timestamp"}


def event_schema(declared: dict[str, str]) -> dict[str, str]:
    return {k: TYPE_NAMES.get(v.lower(), "string") for k, v in declared.items()}


def flattened(events: DataFrame, fields: dict[str, str], payload: str = "payload") -> DataFrame:
    """The payload's fields as columns of the declared types beside what identifies the event. Names of
    other columns aren't shadowed; JSON null is '' in a string column, a missing field is NULL; a
    payload that isn't an object goes to `_payload`."""
    is_object = F.ltrim(F.col(payload)).startswith("{")
    others = [c for c in events.columns if c != payload]
    doc = F.try_parse_json(F.col(payload))
    cols = []
    for name, kind in fields.items():
        if name in others:
            continue
        path = f"$['{name}']" if not name.isidentifier() else f"$.{name}"
        got = F.try_variant_get(doc, path, "string")
        value = got if kind != "string" else F.when(F.is_variant_null(F.try_variant_get(doc, path, "variant")), F.lit("")).otherwise(got)
        cols.append(F.when(is_object, value if kind == "string" else value.try_cast(kind)).alias(name))
    return events.select(*others, *cols, F.when(~is_object, F.col(payload)).alias("_payload"))


def append(events: DataFrame, path: str, snapshot: int) -> None:
    """Adds a batch under a snapshot number of its own, as a folder: a repeated batch replaces itself."""
    events.withColumn("_snapshot", F.lit(snapshot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_snapshot").parquet(path)


def delta(log: DataFrame, after: int, upto: int, expired: int = -1) -> DataFrame:
    """Rows of snapshots in (after, upto]; an error if `after` has expired already."""
    if after < expired:
        raise ValueError(f"snapshot {after} has expired (oldest kept: {expired})")
    return log.where((F.col("_snapshot") > after) & (F.col("_snapshot") <= upto))


def compacted(log: DataFrame, target_rows: int = 1_000_000) -> DataFrame:
    """The same rows in partitions (files, when written) of about `target_rows`, small files merged and large
    ones split."""
    files = -(-log.count() // target_rows) or 1
    return log.repartition(files)


def consolidation(spark: SparkSession, path: str, *, least: int = 10, most: int = 100, ratio: float = 0.3) -> list[str]:
    """The files of a Parquet folder that are worth merging: those under `ratio` times the largest file, at most
    `most` of them, smallest first; none if fewer than `least` are."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path", "length")
    top = rows.agg(F.max("length")).first()[0]
    if top is None:
        return []
    small = [r.path for r in rows.where(F.col("length") <= ratio * top).orderBy("length", "path").limit(most).collect()]
    return small if len(small) >= least else []


def field_records(events: DataFrame, id_field: str, label_field: str | None = None, payload: str = "payload") -> DataFrame:
    """Events as one record per field: qid, key, value, label, event_time_us (entity-attribute-value)."""
    doc = F.from_json(F.col(payload), "map<string,string>")
    rows = events.select(doc[id_field].alias("qid"), (doc[label_field] if label_field else F.lit(None).cast("string")).alias("label"), "event_time_us", F.explode(doc).alias("key", "value"))
    return rows.where((F.col("key") != id_field) & F.col("qid").isNotNull())


def routed(events: DataFrame, routes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(to the event tables, to the graph) by topic; a route is event_table, graph or both (the default)."""
    route = F.coalesce(F.element_at(F.create_map(*[x for k, v in routes.items() for x in (F.lit(k), F.lit(v))]), F.col("topic")), F.lit("both")) if routes else F.lit("both")
    return events.where(route.isin("event_table", "both")), events.where(route.isin("graph", "both"))


# --- projection of events to the graph -------------------------------------------------------------


def rendered(template: str, payload: Column, strict: bool = True) -> Column:
    """`text {{a.b}} text` from the payload's fields; null if a field is missing (strict) or '' for it."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*([\w.]+)\s*\}\}", template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        got = F.get_json_object(payload, "$." + m[1])
        parts.append(got if strict else F.coalesce(got, F.lit("")))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def event_filter(allowed: dict[str, list], payload: Column) -> Column:
    """All named fields hold one of their allowed values (strings or numbers)."""
    out = F.lit(True)
    for name, values in allowed.items():
        out = out & F.coalesce(F.get_json_object(payload, f"$.{name}").isin(*[str(v) for v in values]), F.lit(False))
    return out


def projected(events: DataFrame, rule: dict, payload: str = "payload") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejected) of a projection rule: {node_id, labels, properties: {name: template},
    edge: {type, target}, filter}. Events whose templates miss a field are rejected, whole."""
    p = F.col(payload)
    rows = events.where(event_filter(rule.get("filter", {}), p)).withColumn("_id", rendered(rule["node_id"], p))
    props = {k: rendered(t, p) for k, t in rule.get("properties", {}).items()}
    edge = rule.get("edge")
    rows = rows.withColumns({f"_p_{k}": c for k, c in props.items()} | ({"_target": rendered(edge["target"], p)} if edge else {}))
    needed = ["_id", *[f"_p_{k}" for k in props], *(["_target"] if edge else [])]
    ok = F.lit(True)
    for c in needed:
        ok = ok & F.col(c).isNotNull()
    good, bad = rows.where(ok), rows.where(~ok).drop(*needed)
    nodes = good.select(F.col("_id").alias("id"), F.array(*map(F.lit, rule.get("labels", []))).alias("labels"), *[F.col(f"_p_{k}").alias(k) for k in props])
    edges = good.select(F.col("_id").alias("src"), F.col("_target").alias("dst"), F.lit(edge["type"]).alias("rel_type")) if edge else good.select(F.col("_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("rel_type")).limit(0)
    return nodes, edges, bad
