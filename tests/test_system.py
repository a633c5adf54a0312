"""What queries don't show: limits, catalogs kept on disk, brokers behind fake clients, sinks and schedulers."""

import json
import sys
import time
import types
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from weftgraph.catalog import Graph, tpch_graph
from weftgraph.cypher.syntax import CypherError, split_as_of
from weftgraph.operators import etl, refresh, vector_index
from weftgraph.session import GraphSession, Limits, LimitError
from weftgraph.sources import brokers, readers, sinks
from weftgraph.streaming import pipeline, standing


def test_limits(spark, sf):
    s = GraphSession(spark, tpch_graph(spark, sf))
    assert len(s.rows("MATCH (n:Nation) RETURN n.id AS id")) == 25
    with pytest.raises(LimitError, match="rows"):
        s.rows("MATCH (n:Nation) RETURN n.id AS id", limits=Limits(max_rows=24))
    with pytest.raises(LimitError, match="nodes"):
        s.rows("MATCH (n:Nation) RETURN n.id AS id", limits=Limits(max_nodes=30))
    with pytest.raises(LimitError, match="took over"):
        s.rows("MATCH (a:Event), (b:Event), (c:Event) WHERE a.value + b.value < c.value RETURN count(*) AS n", limits=Limits(timeout_s=1.5))


def test_batch_explain_and_as_of(spark, sf):
    s = GraphSession(spark, tpch_graph(spark, sf))
    made, seen = s.batch(["CREATE (r:Region {id: 9, name: 'X'})", "MATCH (r:Region) RETURN count(*) AS n"])
    assert made.first().nodes_created == 1 and seen.first().n == 6
    assert "PushedFilters" in s.explain("MATCH (p:Part) WHERE p.size > 3 RETURN p.id AS id")
    assert split_as_of("MATCH (n) AS OF 20240101 RETURN 'AS OF 3' AS x") == ("MATCH (n) RETURN 'AS OF 3' AS x", "20240101")
    with pytest.raises(CypherError, match="history"):
        s.cypher("MATCH (r:Region) AS OF 5 RETURN r.id AS id")
    assert {"Region", "edge_PLACED", "nodes"} <= set(s.list_tables())


def test_relationship_of_a_node_table_is_read_once(spark, sf):
    plan = GraphSession(spark, tpch_graph(spark, sf)).explain("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.orderstatus = 'O' RETURN c.mktsegment AS s, count(*) AS n")
    assert plan.split("\n\n")[0].count("Scan parquet") == 2


def test_view_is_matched_by_its_tree(spark, sf):
    s = GraphSession(spark, tpch_graph(spark, sf))
    s.create_view("v", "MATCH (r:Region {name: 'x  y'}) RETURN r.id AS id")
    assert s.matching_view("MATCH (r:Region {name:  'x  y'})   RETURN r.id AS id") is not None
    assert s.matching_view("MATCH (r:Region {name: 'x y'}) RETURN r.id AS id") is None
    with pytest.raises(ValueError, match="exists"):
        s.create_view("v", "MATCH (r:Region) RETURN r.id AS id")
    s.drop_view("v")
    assert s.views == {}


def test_standing_queries_are_kept_and_listed(spark, tmp_path):
    r = standing.Registry()
    hop = {"rel_type": "KNOWS", "direction": "in", "min": 1, "max": 2, "target": {"type": "exists", "key": "a"}, "next": {"rel_type": "HAS"}}
    r.register(standing.query_of({"name": "q", "pattern": {"and": [{"labels": ["L"]}, {"not": {"type": "equals", "key": "k", "value": "v"}}]}, "edges": [hop]}))
    r.update("q", standing.Prop("x", "less_than", 3))
    r.save(spark, str(tmp_path / "sq"))
    back = standing.Registry.load(spark, str(tmp_path / "sq"))
    assert back.held == r.held and back.listed() == [("q", "q", 2)]
    for spec in ({"PropertyFilter": {"key": "speed", "condition": {"GreaterThan": 100.0}}}, {"type": "PropertyFilter", "key": "speed", "condition": {"GreaterThan": 100.0}}):
        assert standing.pattern_of(spec) == standing.Prop("speed", "greater_than", 100.0)
    assert standing.pattern_of({"Or": [{"LabelFilter": ["A"]}, {"PropertyFilter": {"key": "b", "condition": "IsNull"}}]}) == standing.Any_((standing.Labels(("A",)), standing.Prop("b", "is_null")))
    with pytest.raises(ValueError, match="Runner"):
        standing.transition_stream(spark.range(1), list(back.held.values()) + [standing.StandingQuery("e", "e", standing.All(()), (standing.Hop("T"),))])


def test_edges_that_go_unmatch(spark, tmp_path):
    q = standing.StandingQuery("s", "near", standing.All(()), (standing.Hop("R", standing.Prop("hot", "equals", "1")),))
    run = standing.Runner(spark, str(tmp_path / "run"), [q])
    rows = [[("a", "add_edge", "R", "b", 1, 1), ("b", "set", "hot", "1", 1, 2)], [("b", "set", "hot", "0", 0, 3)], [("b", "set", "hot", "0", 5, 4)], [("b", "set", "hot", "1", 6, 5)], [("a", "remove_edge", "R", "b", 7, 6)]]
    for i, some in enumerate(rows):
        for _ in range(2 if i == 2 else 1):  # a batch that is repeated
            run(spark.createDataFrame(some, standing.CHANGE), i)
    got = [sorted((r.qid, r.transition) for r in run._read("results", i, standing.TRANSITION).collect()) for i in range(5)]
    assert got == [[("a", "matched")], [], [("a", "unmatched")], [("a", "matched")], [("a", "unmatched")]]
    assert run.results().count() == 4 and run.matches(4).count() == 0


def test_positions_and_lags(spark):
    progress = {"sources": [{"endOffset": '{"t": {"0": 7, "1": 5}}'}, {"endOffset": {"logOffset": 9}}]}
    assert standing.positions(progress) == {"0/t/0": 7, "0/t/1": 5, "1/logOffset": 9}
    assert standing.low_watermark(standing.positions(progress)) == 5 and standing.low_watermark({}) is None
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0, 1, tzinfo=UTC))], "sq_id string, at timestamp")
    assert standing.lags(rows, F.expr("TIMESTAMP '2024-01-01 00:00:03'")).first().lag_s == 2.0


def test_refresh_modes_and_scheduler():
    of = lambda t: (refresh.Mode.of(t).kind, refresh.Mode.of(t).seconds)
    assert [of(t) for t in ("push", "pull:30", "scheduled: 5", "PULL", "pull:0", "other:7", "hybrid:9", "")] == [("push", 60), ("pull", 30), ("pull", 5), ("pull", 60), ("pull", 60), ("pull", 60), ("hybrid", 9), ("pull", 60)]
    calls, s = [], refresh.Scheduler()

    def fails():
        calls.append("f")
        raise RuntimeError("no")

    s.schedule("a", lambda: calls.append("a"), 0.02)
    s.schedule("b", fails, 0.02)
    time.sleep(0.3)
    s.cancel("a")
    assert s.listed() == ["b"] and calls.count("a") > 2 and calls.count("f") > 2
    s.cancel_all()
    time.sleep(0.1)
    n = len(calls)
    time.sleep(0.1)
    assert len(calls) == n


def test_kinesis_reads_ranges_of_arrival(monkeypatch):
    at = lambda ms: datetime.fromtimestamp(ms / 1000, UTC)
    records = [{"Data": json.dumps({"id": i}).encode(), "ApproximateArrivalTimestamp": at(1000 * i), "SequenceNumber": f"s{i}"} for i in range(6)]

    class Api:
        def list_shards(self, **more):
            return {"Shards": [{"ShardId": "a"}], "NextToken": "t"} if "StreamName" in more else {"Shards": [{"ShardId": "b"}]}

        def get_shard_iterator(self, **kw):
            return {"ShardIterator": str(int(kw["Timestamp"]))}

        def get_records(self, ShardIterator, Limit):  # noqa: N803
            i = int(ShardIterator)
            return {"Records": records[i : i + 2], "NextShardIterator": str(i + 2), "MillisBehindLatest": 0}

    monkeypatch.setitem(sys.modules, "boto3", types.SimpleNamespace(client=lambda *_, **__: Api()))
    client = brokers.Kinesis({"stream": "s", "id_field": "id"})
    assert set(client.latest()) == {"a", "b"}
    assert [r[0] for r in client.read("a", 1000, 4000)] == ["1", "2", "3"]
    assert brokers.event_of("not json", "id", None, "t", "q") == ("q", None, "t", "not json")


def test_pushed_messages_land_as_files(spark, tmp_path, monkeypatch):
    class Mqtt:
        def __init__(self, **_):
            self.topics = []

        def subscribe(self, topic, qos):
            self.topics.append((topic, qos))

        def connect(self, host, port):
            self.on_connect(self, None, None, 0)

        def loop_start(self):
            for i in range(5):
                self.on_message(self, None, types.SimpleNamespace(payload=json.dumps({"id": f"m{i}"}).encode()))

        def loop_stop(self): ...

        def disconnect(self): ...

    monkeypatch.setitem(sys.modules, "paho", types.ModuleType("paho"))
    monkeypatch.setitem(sys.modules, "paho.mqtt", types.ModuleType("paho.mqtt"))
    mod = types.ModuleType("paho.mqtt.client")
    mod.Client = Mqtt
    monkeypatch.setitem(sys.modules, "paho.mqtt.client", mod)
    sys.modules["paho"].mqtt, sys.modules["paho.mqtt"].client = sys.modules["paho.mqtt"], mod
    landing = brokers.Landing(str(tmp_path / "in"), max_rows=2, max_seconds=60)
    brokers.mqtt(landing, "host", "t")()

    class Zenoh:
        def declare_subscriber(self, key, call):
            call(types.SimpleNamespace(payload=b'{"id": "z"}'))
            return types.SimpleNamespace(undeclare=lambda: None)

        def close(self): ...

    monkeypatch.setitem(sys.modules, "zenoh", types.SimpleNamespace(open=lambda c: Zenoh(), Config=dict))
    brokers.zenoh(landing, "k/**")()

    class App:
        def __init__(self, url, on_open, on_message):
            self.open, self.message, self.sent = on_open, on_message, []

        def send(self, x):
            self.sent.append(x)

        def run_forever(self):
            self.open(self)
            self.message(self, '{"id": "w"}')
            time.sleep(0.2)

        def close(self): ...

    monkeypatch.setitem(sys.modules, "websocket", types.SimpleNamespace(WebSocketApp=App))
    stop = brokers.websocket(landing, "ws://h", hello="hi")
    time.sleep(0.1)
    stop()
    rows = readers.json_lines(spark, str(tmp_path / "in"), "t", "id", stream=False)
    assert sorted(r.event_id for r in rows.collect()) == ["m0", "m1", "m2", "m3", "m4", "w", "z"]


def test_file_sink_rotates_and_sinks_are_made(spark, tmp_path, capsys):
    path = str(tmp_path / "out")
    sink = sinks.RotatingJson(path, max_bytes=2000, keep=3)
    for i in range(4):
        sink.write(spark.range(i * 100, i * 100 + 100).coalesce(1))
    assert len(sink.files(spark)) == 3
    assert spark.read.json(path).agg(F.max("id")).first()[0] == 399
    sinks.console(spark.range(2), pretty=False)
    assert capsys.readouterr().out == '{"id":0}\n{"id":1}\n'
    sinks.drop(spark.range(5))
    assert sinks.bearer("t") == {"Authorization": "Bearer t"} and sinks.basic("u", "p") == {"Authorization": "Basic dTpw"}
    with pytest.raises(ValueError, match="unknown sink"):
        sinks.made({"type": "pigeon"})


def test_webhook_retries(monkeypatch):
    import io
    import urllib.request

    tries = []

    def opened(req, timeout):
        tries.append(dict(req.header_items()))
        if len(tries) < 3:
            raise OSError("busy")
        r = io.BytesIO(b"")
        r.status = 200
        return r

    monkeypatch.setattr(urllib.request, "urlopen", opened)
    sinks.Webhook("http://h/", sinks.bearer("t"), wait_s=0.001).send(b"{}")
    assert len(tries) == 3 and tries[0]["Authorization"] == "Bearer t"


def test_backup_notices_damage(spark, tmp_path):
    g = Graph(spark).with_vertices("A", spark.createDataFrame([(1, "x")], "id long, v string"))
    sinks.backup(g, str(tmp_path / "b"))
    assert sinks.restore(spark, str(tmp_path / "b")).vertices["A"].df.count() == 1
    spark.createDataFrame([(2, "x")], "id long, v string").write.mode("append").parquet(str(tmp_path / "b/v/A"))
    with pytest.raises(ValueError, match="checksum"):
        sinks.restore(spark, str(tmp_path / "b"))


def test_subscription_yields_a_streams_rows(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    assert sorted(r["id"] for r in pipeline.Subscription(stream, str(tmp_path / "cp"), bound=4)) == list(range(20))


def test_vector_index_finds_what_was_put_in(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    s = GraphSession(spark)
    for metric in ("l2", "cosine"):
        s.build_vector_index("i", v, lists=8, metric=metric)
        one = v.where("vec_id = 3").withColumn("vec_id", F.lit(10**6).cast("long"))
        s.vector_insert("i", one)
        assert {r.vec_id for r in s.vector_search("i", one, 2, probes=8).collect()} == {3, 10**6}
        s.vector_remove("i", one)
        assert [r.vec_id for r in s.vector_search("i", one, 1, probes=8).collect()] == [3]
    assert vector_index.VectorIndex.build(v.limit(0)).search(v, 3).count() == 0


def test_python_functions_are_bounded(spark):
    fs = etl.Functions(spark)
    fs.register_python("long", lambda r: "x" * 100, ["a"], max_bytes=10)
    fs.register_python("slow", lambda r: time.sleep(5), ["a"], timeout_s=0.2)
    df = spark.createDataFrame([(1,)], "a int")
    for name, said in (("long", "is over 10"), ("slow", "took over")):
        with pytest.raises(Exception, match=said):
            df.select(fs.apply(name)).collect()


def test_statements_keep_their_literals(spark):
    df = spark.createDataFrame([("it's \\ over", 1, None, [1, 2])], "a string, b int, c string, d array<int>")
    assert df.select(etl.rendered_statement(df, "{a} '{a}' {b} {c} {d} {e}")).first()[0] == "'it\\'s \\\\ over' 'it\\'s \\\\ over' 1 null '[1,2]' {e}"
