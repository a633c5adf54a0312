"""Event-time semantics over change logs: last writer wins, time travel, windows.

A change log has: qid, op (set, remove, add_edge, remove_edge, delete, restore), key, value (string;
the other node for edges), event_time (microseconds or a timestamp), seq (arrival order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(payload_time: Column, transport_time: Column | None = None, ahead_minutes: int = 5) -> Column:
    """Event time from a payload (RFC 3339 text, or seconds, milliseconds or microseconds since 1970 by
    size), else the transport's; null if it lies over `ahead_minutes` in the future."""
    n = payload_time.cast("string").try_cast("double")
    micros = F.when(F.abs(n) < 1e11, n * 1e6).when(F.abs(n) < 1e14, n * 1e3).otherwise(n)
    parsed = F.coalesce(F.timestamp_micros(micros.cast("long")), F.try_to_timestamp(payload_time.cast("string")))
    if transport_time is not None:
        parsed = F.coalesce(parsed, transport_time)
    return F.when(parsed <= F.current_timestamp() + F.make_dt_interval(mins=F.lit(ahead_minutes)), parsed)


def nearest_millis(ts: Column) -> Column:
    """The timestamp to the nearest millisecond, halves away from zero, as SQL's epoch_ms counts it."""
    return F.timestamp_micros(F.round(F.unix_micros(ts.cast("timestamp")), -3))


def clock(op_time: Column, batch_time: Column, arrival: Column) -> Column:
    """The time a change competes with: its own, else its batch's, else its arrival."""
    return F.coalesce(op_time, batch_time, arrival)


def latest_properties(changes: DataFrame) -> DataFrame:
    """qid, key, value: the winning write of each property; a winning removal leaves nothing. Of
    writes at one time the later arrival wins. One aggregation, combined on the map side."""
    props = changes.where(F.col("op").isin("set", "remove"))
    win = props.groupBy("qid", "key").agg(F.max_by(F.struct("op", "value"), F.struct("event_time", "seq")).alias("w"))
    return win.where("w.op = 'set'").select("qid", "key", F.col("w.value").alias("value"))


def late_writes(changes: DataFrame) -> DataFrame:
    """qid, n_late: writes that were dropped because a later-timed one of the same property came before. Writes that
    arrive at once (of one `seq`) are taken in the order of their times, so none of them is late for another."""
    from pyspark.sql import Window

    w = Window.partitionBy("qid", "key").orderBy("seq", "event_time").rowsBetween(Window.unboundedPreceding, -1)
    late = changes.where(F.col("op").isin("set", "remove")).withColumn("_seen", F.max("event_time").over(w)).where("event_time < _seen")
    return late.groupBy("qid").agg(F.count("*").alias("n_late"))


def as_of(changes: DataFrame, t: Column | int | str) -> tuple[DataFrame, DataFrame]:
    """(properties, edges) at time `t`, inclusive: qid, key, value and src, rel_type, dst. A deletion
    hides what was written before it; a restore brings it back."""
    t = t if isinstance(t, Column) else F.lit(t)
    log = changes.where(F.col("event_time") <= t)
    alive = log.where(F.col("op").isin("delete", "restore")).groupBy("qid").agg(F.max_by("op", F.struct("event_time", "seq")).alias("last"))
    gone = alive.where("last = 'delete'").select("qid")
    props = latest_properties(log).join(gone, "qid", "left_anti")
    e = log.where(F.col("op").isin("add_edge", "remove_edge")).groupBy("qid", "key", "value").agg(F.max_by("op", F.struct("event_time", "seq")).alias("last"))
    edges = e.where("last = 'add_edge'").select(F.col("qid").alias("src"), F.col("key").alias("rel_type"), F.col("value").alias("dst")).join(gone, F.col("src") == gone["qid"], "left_anti")
    return props, edges


def snapshot_graph(changes: DataFrame, t: Column | int | str, types: dict[str, dict[str, str]] | None = None):
    """The graph at time `t`, for queries that run on it. Nodes are named "Label:id" (`qid`, and `value` of
    edges); types: {label: {property: Spark type}}, strings else. The labels, properties and kinds of
    relationships that stand in the log (a schema's worth) are listed by the driver; rows aren't."""
    from ..catalog import Graph

    props, edges = as_of(changes, t)
    label, ident = F.substring_index("qid", ":", 1), F.expr("substring(qid, instr(qid, ':') + 1)")
    rows = props.select(label.alias("label"), ident.alias("id"), "key", "value")
    g, known = Graph(changes.sparkSession), {}
    for r in rows.select("label", "key").distinct().collect():
        known.setdefault(r.label, []).append(r.key)
    for name, keys in sorted(known.items()):
        kinds = (types or {}).get(name, {})
        wide = rows.where(F.col("label") == name).groupBy("id").pivot("key", sorted(keys)).agg(F.first("value"))
        g = g.with_vertices(name, wide.select(F.col("id").cast(kinds.get("id", "string")).alias("id"), *[F.col(f"`{k}`").cast(kinds.get(k, "string")).alias(k) for k in sorted(keys)]))
    ends = edges.select("rel_type", F.substring_index("src", ":", 1).alias("a"), F.expr("substring(src, instr(src, ':') + 1)").alias("src"), F.substring_index("dst", ":", 1).alias("b"), F.expr("substring(dst, instr(dst, ':') + 1)").alias("dst"))
    for r in ends.select("rel_type", "a", "b").distinct().orderBy("rel_type", "a", "b").collect():
        kind = lambda x: (types or {}).get(x, {}).get("id", "string")
        g = g.with_edges(r.rel_type, r.a, r.b, ends.where((F.col("rel_type") == r.rel_type) & (F.col("a") == r.a) & (F.col("b") == r.b)).select(F.col("src").cast(kind(r.a)).alias("src"), F.col("dst").cast(kind(r.b)).alias("dst")))
    return g


def as_of_literal(text: str) -> int:
    """Microseconds of an AS OF literal: a number of microseconds, or YYYYMMDD (UTC, exact)."""
    from datetime import UTC, datetime

    if len(text) == 8 and text.isdigit() and "19000101" <= text <= "29991231":
        return int(datetime.strptime(text, "%Y%m%d").replace(tzinfo=UTC).timestamp()) * 1_000_000
    return int(text)


def tumbling(df: DataFrame, ts: str, value: str, size: str, by: tuple[str, ...] = ()) -> DataFrame:
    """window_start, [by], n, total, least, most per window [start, end)."""
    return df.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("w.start").alias("window_start"), *by, "n", "total", "least", "most")


def sliding(df: DataFrame, ts: str, value: str, size: str, slide: str) -> DataFrame:
    return df.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, by: tuple[str, ...]) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
