import json

import pytest
from pyspark.sql import functions as F

from weftgraph import queries
from weftgraph.operators import etl, eventlog, temporal, views
from weftgraph.sources import packages, readers, sinks
from weftgraph.streaming import pipeline, standing, windows


def run(df, mode="append", sink="out"):
    q = df.writeStream.format("memory").queryName(sink).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, df.sparkSession.table(sink)


def stream_of(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_tumbling_window_emits_closed_windows(spark, tmp_path):
    schema = "t long, v double"
    df = stream_of(spark, tmp_path, [[(1, 10.0), (9, 20.0)], [(15, 5.0)], [(40, 1.0)]], schema).withColumn("ts", F.timestamp_seconds("t"))
    _, out = run(windows.tumbling_stream(df, "ts", "v", "10 seconds", "0 seconds", "2 seconds"), sink="tumble")
    assert sorted((r.n, r.total, r.least, r.most) for r in out.collect()) == [(1, 5.0, 5.0, 5.0), (2, 30.0, 10.0, 20.0)]


def test_dedup_within_watermark(spark, tmp_path):
    df = stream_of(spark, tmp_path, [[("a", 1), ("a", 2)], [("a", 3), ("b", 4)]], "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    _, out = run(windows.deduplicated(df, ["k"], "ts", "1 minute"), sink="dedup")
    assert sorted(r.k for r in out.collect()) == ["a", "b"]


def test_standing_query_transitions(spark, tmp_path):
    q = standing.StandingQuery("s", "hot", standing.All((standing.Prop("temp", "greater_than", 80), standing.Not(standing.Prop("off", "exists")))))
    schema = "qid string, key string, value string, event_time_us long, seq long"
    batches = [[("n1", "temp", "90", 10, 1), ("n2", "temp", "20", 10, 2)], [("n1", "temp", "10", 5, 3), ("n2", "temp", "95", 20, 4)], [("n1", "off", "1", 30, 5)]]
    _, out = run(standing.transition_stream(stream_of(spark, tmp_path, batches, schema), [q]), sink="sq")
    got = sorted((r.qid, r.transition, r.hit) for r in out.collect())
    assert got == [("n1", "matched", 1), ("n1", "unmatched", 2), ("n2", "matched", 1)]
    assert [r.qid for r in standing.view_from_transitions(out).collect()] == ["n2"]


def test_standing_queries_share_states(spark, tmp_path):
    qs = [standing.StandingQuery("s", "on", standing.Prop("on", "equals", "1")), standing.StandingQuery("x", "tagged", standing.Labels(("T",)))]
    schema = "qid string, key string, value string, event_time_us long, seq long"
    first = [(f"n{i}", "on", str(i % 2), 1, i) for i in range(40)]
    second = [("n0", "on", "1", 2, 50), ("n1", "on", None, 2, 51), ("n2", "labels", "S,T", 2, 52), ("n3", "on", "0", 0, 53)]
    q, out = run(standing.transition_stream(stream_of(spark, tmp_path, [first, second], schema), qs, groups=3), sink="shared")
    got = sorted((r.sq_id, r.qid, r.transition, r.hit) for r in out.collect())
    assert got == sorted([("s", f"n{i}", "matched", 1) for i in range(1, 40, 2)] + [("s", "n0", "matched", 1), ("s", "n1", "unmatched", 2), ("x", "n2", "matched", 1)])
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) == 3


class _State:
    """A group's state as Spark hands it out."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.now, self.wait = None, False, False, 0, None

    def update(self, value):
        self.get, self.exists, self.wait = value, True, None

    def remove(self):
        self.get, self.exists, self.wait = None, False, None

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.wait = ms

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now


def _stepped(step, state, rows):
    import pandas as pd

    frames = [pd.DataFrame(rows, columns=["qid", "key", "value", "event_time_us", "seq"])] if rows else []
    return [tuple(r) for f in step((0,), iter(frames), state) for r in f.itertuples(index=False)]


def test_stale_nodes_lose_their_state_in_a_group():
    step, state = standing.stepper([standing.StandingQuery("s", "on", standing.Prop("on", "equals", "1"))], 100), _State()
    assert [r[2:4] for r in _stepped(step, state, [("a", "on", "1", 1, 1), ("b", "on", "0", 1, 2)])] == [("a", "matched")] and state.wait == 100
    state.now = 60
    assert _stepped(step, state, [("c", "on", "0", 1, 3)]) == [] and state.wait == 40
    state.now, state.hasTimedOut = 100, True
    assert _stepped(step, state, []) == [] and state.wait == 60  # b is gone, c has a while to go
    state.now, state.hasTimedOut = 110, False
    assert [r[2:4] for r in _stepped(step, state, [("b", "on", "1", 0, 4), ("a", "on", "0", 0, 5)])] == [("b", "matched")]  # b's clock went too, a's did not
    state.now, state.hasTimedOut = 1000, True
    assert _stepped(step, state, []) == [] and state.exists and state.wait is None  # only matches are left
    state.now, state.hasTimedOut = 1001, False
    assert [r[2:4] for r in _stepped(step, state, [("a", "on", "0", 2, 6), ("b", "on", "0", 2, 7)])] == [("a", "unmatched"), ("b", "unmatched")]
    state.now, state.hasTimedOut = 1101, True
    assert _stepped(step, state, []) == [] and not state.exists


def test_groups_of_nodes_step_as_single_nodes():
    import json
    import random

    rng = random.Random(5)
    p = lambda *a: standing.Prop(*a)
    qs = [standing.StandingQuery(str(i), str(i), x) for i, x in enumerate([p("u", "greater_than", 4), standing.Not(p("v", "exists")), standing.All((p("u", "exists"), standing.Labels(("L",)))), standing.Any_((p("v", "equals", "3"), p("w", "is_null"))), standing.Not(standing.Labels(("M",)))])]
    step, state, nodes, n = standing.stepper(qs), _State(), {}, 0
    for _ in range(30):
        rows = []
        for _ in range(rng.randrange(1, 12)):
            k = rng.choice(["u", "v", "w", "labels", "other"])
            rows.append((f"n{rng.randrange(4)}", k, rng.choice([None, "L", "M,L", ""] if k == "labels" else [None, *"1357"]), rng.randrange(40), n := n + 1))
        want = []
        for qid, k, value, at, _ in rows:
            props, match, hits = nodes.setdefault(qid, ({}, {}, [0]))
            if k in props and at < props[k][1]:
                continue
            props[k] = (value, at)
            now = {x: v[0] for x, v in props.items()}
            for q in qs:
                does = q.pattern.holds(now | {"labels": [x for x in (now.get("labels") or "").split(",") if x]})
                if does != match.get(q.sq_id, False):
                    match[q.sq_id] = does
                    hits[0] += 1
                    want.append((q.sq_id, q.name, qid, "matched" if does else "unmatched", json.dumps(now, sort_keys=True), 1, hits[0]))
        rng.shuffle(rows)
        assert _stepped(step, state, rows) == want


@pytest.mark.parametrize("step", [1, -1])
def test_writes_that_arrive_at_once_are_not_late_for_each_other(spark, step):
    rows = [("a", "set", "k", "x", 20, 1), ("a", "set", "k", "y", 10, 1), ("a", "set", "k", "z", 15, 2), ("b", "set", "k", "x", 7, 3), ("b", "set", "k", "y", 5, 3), ("b", "set", "k", "z", 6, 3)]
    log = spark.createDataFrame(rows[::step], "qid string, op string, key string, value string, event_time long, seq long").coalesce(1)
    assert [tuple(r) for r in temporal.late_writes(log).collect()] == [("a", 1)]


def test_event_pipeline_is_idempotent(spark, tmp_path):
    schema = "event_id string, topic string, payload string"
    df = stream_of(spark, tmp_path, [[("1", "a", "{}"), ("2", "g", "{}")], [("3", "a", "{}")]], schema)
    seen = []
    handle = pipeline.event_batches({"a": "event_table", "g": "graph"}, str(tmp_path / "log"), lambda g, i: seen.extend(r.event_id for r in g.collect()))
    q = pipeline.start(df, handle, str(tmp_path / "cp"), available_now=True)
    q.awaitTermination()
    handle(spark.createDataFrame([("1", "a", "{}")], schema), 0)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["1", "3"] and seen == ["2"]


def test_json_lines_source_skips_bad_lines(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"id": "x", "at": 1700000000}\nnot json\n[1]\n{"id": "y", "at": "2024-01-01T00:00:00Z"}\n')
    df = readers.json_lines(spark, str(tmp_path / "f.jsonl"), "t", "id", "at", stream=False)
    assert sorted((r.event_id, r.event_time.year) for r in df.collect()) == [("x", 2023), ("y", 2024)]


def test_json_lines_query_rounds_milliseconds_as_its_sql(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    at = ", ".join(str(t) for t in (0, 1, 499, 500, 1499, 1500, 2500, -1, -499, -500, -501, -1500, -9_999_999_999_999_500, 86_400_000_500, 99_999_999_999_499, 1704067798778499, 1704067798778500, 1704067798999999, "NULL"))
    con.execute(f"COPY (SELECT row_number() OVER () AS event_id, 1 AS user_id, 'k' AS event_type, make_timestamp(t::BIGINT) AS ts FROM unnest([{at}]) AS x(t)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got = queries.QUERIES["source_json_lines"](spark, str(tmp_path)).select("event_id", "ms", "kind")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(queries.ORACLE_SQL["source_json_lines"]).fetchall()))


@pytest.mark.parametrize("name", ["stream_watermark", "stream_global_watermark", "time_bucket"])
def test_milliseconds_are_rounded_as_in_sql(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    at = ", ".join(f"({t}, '{kind}')" for t in (-60000500, -60000499, -500, -499, 1704067199999499, 1704067199999500, 1704067259999501) for kind in ("click", "purchase"))
    con.execute(f"COPY (SELECT row_number() OVER () AS event_id, 1 AS user_id, kind AS event_type, make_timestamp(t::BIGINT) AS ts, 1.0::DOUBLE AS value FROM (VALUES {at}) AS x(t, kind)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE_SQL[name]).fetchall())


def test_polled_source(spark, tmp_path):
    records = json.dumps([[str(i), "t", "{}"] for i in range(5)])
    df = readers.polled(spark, "weftgraph.sources.readers:Scripted", records=records, shards="2")
    q = df.writeStream.format("memory").queryName("polled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.event_id for r in spark.table("polled").collect()) == ["0", "1", "2", "3", "4"]


def test_event_time_and_log(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000000",), ("1700000000000000",), ("2023-11-14T22:13:20Z",), ("9999999999",), ("x",)], "t string")
    got = [r.e.timestamp() if r.e else None for r in df.select(temporal.event_time(F.col("t")).alias("e")).collect()]
    assert got[:4] == [1700000000.0] * 4 and got[4:] == [None, None]
    assert temporal.as_of_literal("20240115") == 1705276800000000 and temporal.as_of_literal("17") == 17
    flat = eventlog.flattened(spark.createDataFrame([("1", '{"a": "x", "b": null}'), ("2", "[1]"), ("3", "{}")], "event_id string, payload string"), {"a": "string", "b": "string", "event_id": "string"})
    assert [tuple(r) for r in flat.orderBy("event_id").collect()] == [("1", "x", "", None), ("2", None, None, "[1]"), ("3", None, None, None)]


def test_time_travel(spark):
    rows = [("n", "set", "speed", "50", 1500, 1), ("n", "set", "speed", "80", 2500, 2), ("n", "add_edge", "R", "m", 2500, 3), ("n", "remove_edge", "R", "m", 2700, 4), ("n", "set", "speed", "10", 1000, 5), ("n", "delete", None, None, 3000, 6)]
    log = spark.createDataFrame(rows, "qid string, op string, key string, value string, event_time long, seq long")
    at = lambda t: ([r.value for r in temporal.as_of(log, t)[0].collect()], temporal.as_of(log, t)[1].count())
    assert at(1600) == (["50"], 0) and at(2600) == (["80"], 1) and at(2800) == (["80"], 0) and at(3000) == ([], 0)


def test_projection_rejects_what_misses_a_field(spark):
    e = spark.createDataFrame([('{"a": {"b": 1}, "k": "x"}',), ('{"k": "x"}',), ('{"a": {"b": 2}, "k": "z"}',)], "payload string")
    nodes, edges, bad = eventlog.projected(e, {"node_id": "n{{a.b}}", "labels": ["L"], "filter": {"k": ["x"]}})
    assert [r.id for r in nodes.collect()] == ["n1"] and edges.count() == 0 and bad.count() == 1


def test_etl_functions(spark):
    f = etl.FUNCTIONS
    df = spark.createDataFrame([("23.5°C", "1.5, 2", "aGk=", "a@b.org", "1700000000")], "t string, g string, b string, e string, s string")
    r = df.select(f["parse_temp"](F.col("t")), f["parse_geo"](F.col("g")), f["base64_decode"](F.col("b")), f["validate_email"](F.col("e")), f["timestamp_parse"](F.col("s")).cast("long")).first()
    assert (r[0], tuple(r[1]), r[2], r[3], r[4]) == (23.5, (1.5, 2.0), "hi", True, 1700000000)
    assert spark.range(1).select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b")).select(etl.expression("a + b * 2 < 6 && b == 2").alias("x")).first().x
    with pytest.raises(Exception, match="fails a check"):
        etl.Pipeline(checks=[etl.Check("a", "range", (5, 9))], on_error="halt").run(spark.createDataFrame([(1,)], "a int"))[0].collect()
    fs = etl.Functions(spark)
    fs.register_python("twice", lambda r: r["a"] * 2, ["a"], "long")
    assert spark.createDataFrame([(4,)], "a long").select(fs.apply("twice").alias("x")).first().x == 8


def test_packages_recipes_sinks(spark, tmp_path):
    d = packages.DomainPackage.of({"name": "p", "labels": [{"name": "Person", "properties": [{"name": "name", "required": True}, {"name": "age", "type": "int", "min": 0}]}], "mappings": [{"label": "Person", "id": "$.id", "properties": {"name": "$.name", "age": "$.age"}}]})
    v = d.vertices(spark.createDataFrame([('{"id": "1", "name": "A", "age": 3}',), ('{"id": "2", "age": -1}',)], "payload string"), d.mappings[0])
    assert not d.problems() and [r.id for r in v.where(d.valid("Person")).collect()] == ["1"]
    r = packages.Recipe.of(json.dumps({"standing_queries": [{"name": "q", "pattern": {"or": [{"type": "equals", "key": "a", "value": "1"}, {"labels": ["L"]}]}}]}))
    assert r.standing_queries[0].pattern.holds({"a": "1"}) and r.standing_queries[0].pattern.holds({"labels": ["L"]})
    ch = views.row_changes(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(1, "a"), (3, "c")], "id int, v string"), ["id"])
    assert sorted((r.id, r._deleted) for r in sinks.change_rows(ch, ["id"]).collect()) == [(2, True), (3, False)]
    from weftgraph.catalog import Graph

    g = Graph(spark).with_vertices("A", spark.createDataFrame([(1,)], "id long")).with_edges("R", "A", "A", spark.createDataFrame([(1, 1)], "src long, dst long"))
    sinks.backup(g, str(tmp_path / "b"))
    back = sinks.restore(spark, str(tmp_path / "b"))
    assert back.vertices["A"].df.count() == 1 and back.edges[0].rel_type == "R"
