"""Standing queries: patterns whose match and unmatch transitions are emitted as nodes change."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

KINDS = ("exists", "equals", "not_equals", "greater_than", "less_than", "starts_with", "contains", "ends_with", "is_null", "is_not_null")


@dataclass(frozen=True)
class Prop:
    key: str
    kind: str
    value: Any = None

    def column(self, at=lambda k: F.col(k)) -> Column:
        """A two-valued test over property columns: a missing property matches only is_null."""
        x, v = at(self.key), self.value
        test = {
            "exists": x.isNotNull, "is_not_null": x.isNotNull, "is_null": x.isNull,
            "equals": lambda: x == F.lit(v), "not_equals": lambda: x != F.lit(v),
            "greater_than": lambda: x.try_cast("double") > v, "less_than": lambda: x.try_cast("double") < v,
            "starts_with": lambda: x.startswith(v), "contains": lambda: x.contains(v), "ends_with": lambda: x.endswith(v),
        }[self.kind]()
        return F.coalesce(test, F.lit(False))

    def holds(self, props: dict) -> bool:
        x, v = props.get(self.key), self.value
        if self.kind == "is_null":
            return x is None
        if x is None:
            return False
        if self.kind in ("exists", "is_not_null"):
            return True
        if self.kind in ("equals", "not_equals"):
            same = x == (v if isinstance(v, str) else json.dumps(v)) or x == str(v)
            return same == (self.kind == "equals")
        if self.kind in ("greater_than", "less_than"):
            try:
                return float(x) > v if self.kind == "greater_than" else float(x) < v
            except ValueError:
                return False
        return {"starts_with": x.startswith, "ends_with": x.endswith, "contains": x.__contains__}[self.kind](v)


@dataclass(frozen=True)
class Labels:
    names: tuple[str, ...]

    def column(self, at=lambda k: F.col(k)) -> Column:
        return reduce(lambda a, b: a & b, [F.array_contains(at("labels"), n) for n in self.names], F.lit(True))

    def holds(self, props: dict) -> bool:
        return set(self.names) <= set(props.get("labels") or ())


@dataclass(frozen=True)
class All:
    parts: tuple

    def column(self, at=lambda k: F.col(k)) -> Column:
        return reduce(lambda a, b: a & b, [p.column(at) for p in self.parts], F.lit(True))

    def holds(self, props: dict) -> bool:
        return all(p.holds(props) for p in self.parts)


@dataclass(frozen=True)
class Any_:
    parts: tuple

    def column(self, at=lambda k: F.col(k)) -> Column:
        return reduce(lambda a, b: a | b, [p.column(at) for p in self.parts], F.lit(False))

    def holds(self, props: dict) -> bool:
        return any(p.holds(props) for p in self.parts)


@dataclass(frozen=True)
class Not:
    part: Any

    def column(self, at=lambda k: F.col(k)) -> Column:
        return ~self.part.column(at)

    def holds(self, props: dict) -> bool:
        return not self.part.holds(props)


@dataclass(frozen=True)
class Hop:
    """An edge of `rel_type` to a node that `target` holds for; `least`..`most` hops if variable."""

    rel_type: str
    target: Any = All(())
    direction: str = "out"
    least: int = 1
    most: int = 1
    next: Any = None


def pattern_of(spec: dict) -> Any:
    """A pattern from its JSON form, nested ({"and": [...]}) or flat ({"type": ..., "key": ...})."""
    if "and" in spec:
        return All(tuple(map(pattern_of, spec["and"])))
    if "or" in spec:
        return Any_(tuple(map(pattern_of, spec["or"])))
    if "not" in spec:
        return Not(pattern_of(spec["not"]))
    if "labels" in spec:
        return Labels(tuple(spec["labels"]))
    tagged = next((k for k in ("PropertyFilter", "LabelFilter", "And", "Or", "Not") if k in spec or spec.get("type") == k), None)
    if tagged is not None:  # a kind with its fields, as the key's value or beside `type`
        body = spec.get(tagged, spec)
        if tagged == "PropertyFilter":
            condition = body["condition"]
            kind, value = next(iter(condition.items())) if isinstance(condition, dict) else (condition, None)
            return Prop(body["key"], _snake(kind), value)
        if tagged == "LabelFilter":
            return Labels(tuple(body["labels"] if isinstance(body, dict) else body))
        parts = body if not isinstance(body, dict) or "patterns" not in body and "pattern" not in body else body.get("patterns", body.get("pattern"))
        if tagged == "Not":
            return Not(pattern_of(parts))
        return (All if tagged == "And" else Any_)(tuple(map(pattern_of, parts)))
    kind = _snake(spec.get("type", "exists"))
    if kind not in KINDS:
        raise ValueError(f"unknown predicate {kind!r}")
    return Prop(spec["key"], kind, spec.get("value"))


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


def hop_of(spec: dict) -> Hop:
    """An edge pattern: {rel_type, direction, min, max, target: pattern, next: edge pattern}."""
    return Hop(spec["rel_type"], pattern_of(spec["target"]) if spec.get("target") else All(()), spec.get("direction", "out"), spec.get("min", 1), spec.get("max", 1), hop_of(spec["next"]) if spec.get("next") else None)


def spec_of(p: Any) -> dict:
    """The JSON form that `pattern_of` and `hop_of` read."""
    if isinstance(p, Hop):
        return {"rel_type": p.rel_type, "direction": p.direction, "min": p.least, "max": p.most, "target": spec_of(p.target)} | ({"next": spec_of(p.next)} if p.next else {})
    if isinstance(p, All):
        return {"and": [spec_of(x) for x in p.parts]}
    if isinstance(p, Any_):
        return {"or": [spec_of(x) for x in p.parts]}
    if isinstance(p, Not):
        return {"not": spec_of(p.part)}
    if isinstance(p, Labels):
        return {"labels": list(p.names)}
    return {"type": p.kind, "key": p.key, "value": p.value}


def query_of(spec: dict) -> StandingQuery:
    return StandingQuery(str(spec.get("id", spec["name"])), spec["name"], pattern_of(spec["pattern"]), tuple(map(hop_of, spec.get("edges", []))), spec.get("version", 1))


@dataclass
class StandingQuery:
    sq_id: str
    name: str
    pattern: Any
    hops: tuple[Hop, ...] = ()
    version: int = 1


@dataclass
class Registry:
    held: dict[str, StandingQuery] = field(default_factory=dict)

    def register(self, q: StandingQuery) -> None:
        self.held[q.sq_id] = q

    def update(self, sq_id: str, pattern: Any) -> None:
        old = self.held[sq_id]
        self.held[sq_id] = StandingQuery(sq_id, old.name, pattern, old.hops, old.version + 1)

    def remove(self, sq_id: str) -> None:
        del self.held[sq_id]

    def listed(self) -> list[tuple[str, str, int]]:
        """(id, name, version)."""
        return sorted((q.sq_id, q.name, q.version) for q in self.held.values())

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(json.dumps({"id": q.sq_id, "name": q.name, "version": q.version, "pattern": spec_of(q.pattern), "edges": [spec_of(h) for h in q.hops]}),) for q in self.held.values()]
        spark.createDataFrame(rows, "spec string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        out = cls()
        for r in spark.read.text(path).collect():  # a row a query
            out.register(query_of(json.loads(r.value)))
        return out


def matching(nodes: DataFrame, q: StandingQuery, edges: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Batch: ids of the nodes that match; nodes: id, labels and property columns; edges: src, dst, rel_type.
    Hops are existence tests, one semi-join each. among: a table of ids that alone are asked for."""
    from ..plans.paths import var_length

    out = nodes.where(q.pattern.column()).select("id")
    if among is not None:
        out = out.join(among, "id", "left_semi")
    for hop in q.hops:
        out = out.join(_holders(nodes, edges, hop, var_length), "id", "left_semi")
    return out


def _holders(nodes: DataFrame, edges: DataFrame, hop: Hop, var_length) -> DataFrame:
    """Ids of nodes from which the hop (and what follows it) exists."""
    targets = nodes.where(hop.target.column()).select("id")
    if hop.next is not None:
        targets = targets.join(_holders(nodes, edges, hop.next, var_length), "id", "left_semi")
    e = edges.where(F.col("rel_type") == hop.rel_type)
    e = e.select(F.col("src").alias("u"), F.col("dst").alias("v")) if hop.direction == "out" else e.select(F.col("dst").alias("u"), F.col("src").alias("v"))
    if (hop.least, hop.most) != (1, 1):
        e = var_length(e, e.select(F.col("u").alias("start")).distinct(), hop.least, hop.most).select(F.col("start").alias("u"), F.col("node").alias("v"))
    return e.join(targets, e["v"] == targets["id"], "left_semi").select(F.col("u").alias("id")).distinct()


def transitions(before: DataFrame, after: DataFrame, q: StandingQuery) -> DataFrame:
    """Batch: id, transition (matched or unmatched) between two snapshots' matching ids."""
    b, a = before.select("id").distinct().withColumn("was", F.lit(True)), after.select("id").distinct().withColumn("now", F.lit(True))
    both = b.join(a, "id", "full_outer").where("was is null or now is null")
    return both.select(F.lit(q.sq_id).alias("sq_id"), "id", F.when(F.col("now"), "matched").otherwise("unmatched").alias("transition"))


RESULT = "sq_id string, name string, qid string, transition string, props string, version int, hit bigint"


#: Nodes share a state by a hash of their id: a call and a state for each node cost several milliseconds.
GROUPS = 16384


def transition_stream(changes: DataFrame, queries: list[StandingQuery], stale_after: str | None = None, groups: int = GROUPS) -> DataFrame:
    """changes: qid, key, value, event_time_us, seq (a null value removes the property; key 'labels'
    takes a comma-separated list). State per node: its properties with their clocks and which queries
    it matches. Writes older than the property's clock are ignored; only changes of a match come out.
    stale_after: a node that matches nothing and hasn't changed for so long ("10 minutes") loses its state.
    groups: nodes are held in so many states; a change rewrites the state of its node's whole group, so streams of
    far over ten million nodes want more. It is fixed for the life of a checkpoint.
    Queries with edges need `Runner`, which holds the edges as well."""
    if any(q.hops for q in queries):
        raise ValueError("standing queries with edges go through Runner")
    from pyspark.sql.streaming.state import GroupStateTimeout

    wait_ms = _millis(stale_after) if stale_after else None
    ship_package(changes.sparkSession)
    rows = changes.select(F.pmod(F.xxhash64(F.col("qid").cast("string")), F.lit(groups)).alias("group"), F.col("qid").cast("string").alias("qid"), "key", "value", "event_time_us", "seq")
    return rows.groupBy("group").applyInPandasWithState(stepper(queries, wait_ms), RESULT, "blob binary", "append", GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout)


def stepper(queries: list[StandingQuery], wait_ms: int | None = None):
    """The function that takes a group's changes to its transitions. A state is compressed JSON: for each node its
    id, properties with clocks, matches, number of transitions, and when it last changed."""
    held = [(q.sq_id, q.name, q.pattern, q.version, _keys(q.pattern) | {"labels"}) for q in queries]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        nodes = {n[0]: n[1:] for n in json.loads(zlib.decompress(state.get[0]))} if state.exists else {}
        at = state.getCurrentProcessingTimeMs() if wait_ms else 0
        out, seen = [], {}  # seen: values of the nodes that this batch changes
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            for qid, k, value, time in zip(rows["qid"], rows["key"], rows["value"], rows["event_time_us"], strict=True):
                node = nodes.get(qid)
                if node is None:
                    node = nodes[qid] = [{}, {}, 0, at]
                props, match = node[0], node[1]
                node[3] = at
                old = props.get(k)
                if old is not None and time < old[1]:
                    continue
                value = None if pd.isna(value) else value
                props[k] = [value, int(time)]
                now = seen.get(qid)
                first = now is None
                if first:
                    now = seen[qid] = {x: v[0] for x, v in props.items()}
                now[k] = value
                if first or k == "labels":
                    now["labels"] = [x for x in (props.get("labels", [None])[0] or "").split(",") if x]
                for sq_id, name, pattern, version, reads in held:
                    if not (first or k in reads):
                        continue
                    does = pattern.holds(now)
                    if does != match.get(sq_id, False):
                        match[sq_id] = does
                        node[2] += 1
                        out.append((sq_id, name, qid, "matched" if does else "unmatched", json.dumps({x: v[0] for x, v in props.items()}, sort_keys=True), version, node[2]))
        if wait_ms:
            nodes = {q: n for q, n in nodes.items() if any(n[1].values()) or at - n[3] < wait_ms}
        if nodes:
            state.update((zlib.compress(json.dumps([[q, *n] for q, n in nodes.items()]).encode(), 1),))
            waits = [n[3] + wait_ms - at for n in nodes.values() if not any(n[1].values())] if wait_ms else []
            if waits:
                state.setTimeoutDuration(min(waits))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["sq_id", "name", "qid", "transition", "props", "version", "hit"])

    return step


def view_from_transitions(results: DataFrame) -> DataFrame:
    """The rows of the view that follows a standing query: its nodes that match now, by their last hit."""
    last = results.groupBy("sq_id", "qid").agg(F.max_by(F.struct("transition", "props"), "hit").alias("w"))
    return last.where("w.transition = 'matched'").select("sq_id", "qid", F.col("w.props").alias("props"))


def _millis(text: str) -> int:
    from .windows import in_millis

    return in_millis(text)


def _depth(hops: tuple[Hop, ...]) -> int:
    return max((h.most + (_depth((h.next,)) if h.next else 0) for h in hops), default=0)


def _keys(p: Any) -> set[str]:
    """Properties that a pattern reads."""
    if isinstance(p, Prop):
        return {p.key}
    if isinstance(p, (All, Any_)):
        return set().union(*map(_keys, p.parts)) if p.parts else set()
    if isinstance(p, Not):
        return _keys(p.part)
    if isinstance(p, Hop):
        return _keys(p.target) | (_keys(p.next) if p.next else set())
    return set()


CHANGE = "qid string, op string, key string, value string, event_time long, seq long"
LOG = CHANGE
MATCH = "sq_id string, id string"
TRANSITION = "sq_id string, name string, qid string, transition string, version int"


@dataclass
class Runner:
    """Standing queries with edges on a stream of changes, as a foreachBatch function.

    State is a folder per batch below `path`: the winning write of each property and edge, and who matches
    what. A batch's changes touch their nodes, and the nodes from which these can be reached by as many
    hops as a pattern has; only those are asked again. A batch that is repeated starts from the
    state before it and writes the same folders. Transitions stand in `path`/results, by batch."""

    spark: SparkSession
    path: str
    queries: list[StandingQuery]

    def _read(self, kind: str, batch_id: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{batch_id}") if batch_id >= 0 else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str, batch_id: int, schema: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/{batch_id}")
        return self._read(kind, batch_id, schema)

    def results(self) -> DataFrame:
        return self.spark.read.schema(TRANSITION).option("recursiveFileLookup", True).parquet(f"{self.path}/results")

    def matches(self, batch_id: int) -> DataFrame:
        return self._read("matches", batch_id, MATCH)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """batch: CHANGE, with op set, remove, add_edge (key: type, value: target) or remove_edge."""
        old_log, old = self._read("log", batch_id - 1, LOG), self._read("matches", batch_id - 1, MATCH)
        edge = F.col("op").isin("add_edge", "remove_edge")
        every = old_log.unionByName(batch.select(*old_log.columns)).withColumn("edge", edge).withColumn("to", F.when(edge, F.col("value")))
        last = every.groupBy("qid", "edge", "key", "to").agg(F.max_by(F.struct(*[c for c in old_log.columns if c not in ("qid", "key")]), F.struct("event_time", "seq")).alias("w"))
        log = self._write(last.select("qid", "w.op", "key", "w.value", "w.event_time", "w.seq"), "log", batch_id, LOG)

        keys = sorted(set().union(*[_keys(q.pattern) | set().union(*map(_keys, q.hops)) for q in self.queries]) | {"labels"})
        props = log.groupBy(F.col("qid").alias("id")).pivot("key", keys).agg(F.first(F.when(F.col("op") == "set", F.col("value")), ignorenulls=True))
        nodes = props.withColumn("labels", F.split(F.coalesce("labels", F.lit("")), ","))
        edges = log.where(F.col("op") == "add_edge").select(F.col("qid").alias("src"), F.col("value").alias("dst"), F.col("key").alias("rel_type"))

        touched = batch.select(F.col("qid").alias("id")).distinct()
        reach, frontier = touched, touched
        for _ in range(max((_depth(q.hops) for q in self.queries), default=0)):  # the hops of a pattern
            ends = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            frontier = ends.join(frontier, ends["dst"] == frontier["id"], "left_semi").select(F.col("src").alias("id"))
            reach = reach.unionByName(frontier).distinct()
        among = self._write(reach, "touched", batch_id, "id string")

        now = None
        for q in self.queries:
            part = matching(nodes, q, edges, among).select(F.lit(q.sq_id).alias("sq_id"), "id").distinct()
            now = part if now is None else now.unionByName(part)
        before = old.join(among, "id", "left_semi").withColumn("was", F.lit(True))
        both = before.join(now.withColumn("now", F.lit(True)), ["sq_id", "id"], "full_outer").where("was is null or now is null")
        named = self.spark.createDataFrame([(q.sq_id, q.name, q.version) for q in self.queries], "sq_id string, name string, version int")
        changed = both.join(F.broadcast(named), "sq_id").select("sq_id", "name", F.col("id").alias("qid"), F.when(F.col("now"), "matched").otherwise("unmatched").alias("transition"), "version")
        done = self._write(changed, "results", batch_id, TRANSITION)
        gone = done.where("transition = 'unmatched'").select("sq_id", F.col("qid").alias("id"))
        new = done.where("transition = 'matched'").select("sq_id", F.col("qid").alias("id"))
        self._write(old.join(gone, ["sq_id", "id"], "left_anti").unionByName(new), "matches", batch_id, MATCH)


def low_watermark(positions: dict[str, int]) -> int | None:
    """The position up to which all shards have been read: the least of the shards'; None without shards."""
    return min(positions.values(), default=None)


def positions(progress: dict) -> dict[str, int]:
    """The position of each shard of a streaming query's last progress: Kafka's partitions, a poll source's
    shards, or a file source's log offset."""
    out: dict[str, int] = {}
    for i, source in enumerate(progress.get("sources", [])):
        end = source.get("endOffset")
        end = json.loads(end) if isinstance(end, str) else end

        def walk(x: Any, name: str) -> None:
            if isinstance(x, dict):
                for k, v in x.items():
                    walk(v, f"{name}/{k}")
            elif isinstance(x, int):
                out[name] = x

        walk(end, str(i))
    return out


def lags(results: DataFrame, now: Column | None = None) -> DataFrame:
    """sq_id, lag_s: seconds since each standing query last reported anything; results: sq_id, at (timestamp)."""
    now = F.current_timestamp() if now is None else now
    return results.groupBy("sq_id").agg((F.unix_micros(now) - F.unix_micros(F.max("at"))).alias("us")).select("sq_id", (F.col("us") / 1e6).alias("lag_s"))
