import pytest

from weftgraph.catalog import Graph
from weftgraph.cypher import syntax as S
from weftgraph.plans.paths import var_length
from weftgraph.session import GraphSession


@pytest.fixture(scope="module")
def people(spark):
    g = Graph(spark).with_vertices("Person", spark.createDataFrame([("a", "Ann", 25, None), ("b", "Bob", 24, "b@x.org"), ("c", "Cy", None, None), ("d", "Di", 22, None)], "id string, name string, age long, email string"))
    return g.with_edges("KNOWS", "Person", "Person", spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("c", "d", 4), ("d", "d", 5)], "src string, dst string, since long"))


def rows(s, text, **params):
    return [tuple(r) for r in s.cypher(text, params or None).collect()]


def test_reads(spark, people):
    s = GraphSession(spark, people)
    assert rows(s, "MATCH (p:Person) WHERE p.age > 22 RETURN p.name AS n ORDER BY n") == [("Ann",), ("Bob",)]
    assert rows(s, "MATCH (p:Person) WHERE p.email IS NULL RETURN count(*) AS n") == [(3,)]
    assert rows(s, "MATCH (p:Person) RETURN p.name AS n ORDER BY p.age, n LIMIT 2") == [("Cy",), ("Di",)]
    assert rows(s, "MATCH (a:Person {name: $n})-[r:KNOWS]->(b) RETURN b.name AS b, r.since AS s", n="Ann") == [("Bob", 1)]
    assert rows(s, "MATCH (p:Person) RETURN avg(p.age) AS a, sum(p.age) AS s, count(p.age) AS c, size(collect(p.age)) AS k") == [(71 / 3, 71, 3, 4)]
    assert rows(s, "MATCH (p:Person) RETURN stDev(p.age) >= 0 AS ok, percentileCont(p.age, 0.5) AS m, percentileDisc(p.age, 0.5) AS d") == [(True, 24.0, 24)]
    assert rows(s, "MATCH (a:Person {id: 'a'})-[:KNOWS*1..3]->(b) RETURN b.id AS b ORDER BY b") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(s, "MATCH (a:Person {id: 'a'})-[:KNOWS*0..1]->(b) RETURN b.id AS b ORDER BY b") == [("a",), ("b",)]
    assert rows(s, "MATCH (d:Person {id: 'd'})-[:KNOWS]-(x) RETURN x.id AS x ORDER BY x") == [("c",), ("d",)]
    assert rows(s, "MATCH (a:Person)-[:KNOWS]->(b)-[:KNOWS]->(c)-[:KNOWS]->(a) RETURN count(*) AS n") == [(3,)]
    assert rows(s, "MATCH (p:Person) WHERE p.age = 22 OR NOT p.age > 0 RETURN count(*) AS n") == [(1,)]
    assert rows(s, "RETURN 7 % 3 AS m, -2.5 AS f, round(-2.5) AS r, 'a' + 1 AS s, [1, 2] + [3] AS l, toInteger('3.9') AS i") == [(1, -2.5, -3.0, "a1", [1, 2, 3], 3)]


@pytest.mark.parametrize("bad", ["MATCH (a RETURN a", "MATCH (a:Person) RETURN b", "MATCH (a:Person)", "RETURN substring('a')", "MATCH (a:Person)<-[:KNOWS]->(b) RETURN a", "RETURN nosuch(1) AS x", "MATCH (a:Nope) RETURN a"])
def test_errors(spark, people, bad):
    with pytest.raises(S.CypherError):
        GraphSession(spark, people).cypher(bad).collect()


def test_writes(spark, people):
    s = GraphSession(spark, people)
    assert s.cypher("CREATE (e:Person {id: 'e', name: 'Ed'})").first()["nodes_created"] == 1
    assert s.cypher("MATCH (a:Person {id: 'a'}), (e:Person {id: 'e'}) CREATE (a)-[:KNOWS {since: 9}]->(e)").first()["relationships_created"] == 1
    assert s.cypher("MATCH (a:Person {id: 'a'}), (e:Person {id: 'e'}) CREATE (a)-[:KNOWS]->(e)").first()["relationships_created"] == 0
    s.cypher("MATCH (p:Person) WHERE p.age > 23 SET p += {old: true}, p:Senior")
    assert rows(s, "MATCH (p:Senior) WHERE p.old RETURN p.id AS id ORDER BY id") == [("a",), ("b",)]
    s.cypher("MATCH (p:Senior {id: 'b'}) REMOVE p:Senior, p.old")
    assert rows(s, "MATCH (p:Senior) RETURN p.id AS id") == [("a",)]
    with pytest.raises(S.CypherError):
        s.cypher("MATCH (p:Person {id: 'c'}) DELETE p")
    assert s.cypher("MATCH (p:Person {id: 'c'}) DETACH DELETE p").first()["relationships_deleted"] == 3
    assert s.cypher("MATCH (a:Person {id: 'a'})-[r:KNOWS]->(b) DELETE r").first()["relationships_deleted"] == 2
    assert rows(s, "MATCH (a:Person)-[:KNOWS]->(b) RETURN a.id AS a, b.id AS b") == [("d", "d")]
    s.cypher("UNWIND ['x', 'y', 'x'] AS n MERGE (t:Tag {name: n})")
    assert rows(s, "MATCH (t:Tag) RETURN t.name AS n ORDER BY n") == [("x",), ("y",)]


def test_views(spark, people):
    s = GraphSession(spark, people)
    text = "MATCH (p:Person) WHERE p.age > 23 RETURN p.id AS id"
    s.sql(f"CREATE MATERIALIZED VIEW old AS {text}")
    s.cypher("MATCH (p:Person {id: 'b'}) SET p.age = 1")
    assert len(rows(s, text + " ")) == 1 and len(rows(s, text + " ORDER BY id")) == 1
    s.refresh_view("old")
    assert rows(s, text) == [("a",)]
    s.sql("DROP MATERIALIZED VIEW old")
    assert "old" not in s.list_tables() and "edge_KNOWS" in s.list_tables()


def test_plan_prunes_and_pushes(spark, sf):
    from weftgraph.catalog import tpch_graph

    plan = GraphSession(spark, tpch_graph(spark, sf)).explain("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 5 RETURN c.mktsegment AS s, count(*) AS n")
    assert "GreaterThan(o_totalprice,5.0)" in plan and "c_name" not in plan and "CartesianProduct" not in plan


def test_paths_of_more_than_eight_hops(spark):
    ids = [f"n{i:02}" for i in range(20)]
    g = Graph(spark).with_vertices("Stop", spark.createDataFrame([(i,) for i in ids], "id string"))
    s = GraphSession(spark, g.with_edges("NEXT", "Stop", "Stop", spark.createDataFrame(list(zip(ids, ids[1:])) + [("n19", "n17")], "src string, dst string")))
    far = lambda length: [x for x, in rows(s, f"MATCH (a:Stop {{id: 'n00'}})-[:NEXT*{length}]->(b) RETURN b.id AS b ORDER BY b")]
    assert far("1..10") == ids[1:11] and far("9..10") == ids[9:11]
    assert far("") == ids[1:] and far("0..") == ids and far("12..") == ids[12:]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "u string, v string")
    assert var_length(edges, spark.createDataFrame([("n00",)], "start string"), 1, 12).count() == 12


def _cycle() -> str:
    return "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier), (c)-[:PLACED]->(o:Order)-[:SUPPLIED_BY]->(s) RETURN n.name AS nation, count(*) AS n"


def test_cyclic_pattern_closes_before_it_multiplies(spark, sf, monkeypatch):
    from weftgraph.catalog import tpch_graph
    from weftgraph.cypher import compiler

    seen, hop = [], compiler.Compiler.hop
    monkeypatch.setattr(compiler.Compiler, "hop", lambda self, scope, a, e, r, p, b, *more: seen.append((a, b, b in scope.vars)) or hop(self, scope, a, e, r, p, b, *more))
    compiler.compile_query(tpch_graph(spark, sf), _cycle())
    assert seen == [("n", "c", False), ("c", "o", False), ("o", "s", False), ("n", "s", True)]


def test_cyclic_patterns(spark, people):
    s = GraphSession(spark, people.with_vertices("Tag", spark.createDataFrame([("b", "x"), ("t", "x")], "id string, name string")).with_edges("HAS", "Person", "Tag", spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "b"), ("d", "b")], "src string, dst string")))
    assert rows(s, "MATCH (a:Person)-[:KNOWS]->(a) RETURN a.id AS a") == [("d",)]
    assert rows(s, "MATCH (a)-[r:KNOWS]->(b), (b)-[q:KNOWS]->(c), (c)-[:KNOWS]->(a:Person {id: 'b'}) RETURN a.name AS a, r.since AS r, q.since AS q, c.id AS c") == [("Bob", 2, 3, "a")]
    assert rows(s, "MATCH (t:Tag)<-[:HAS]-(a:Person), (b)-[:HAS]->(t:Tag {id: 't'}), (b)<-[:KNOWS]-(a) RETURN a.id AS a, b.age AS b, t.name AS t") == [("a", 24, "x")]
    assert rows(s, "MATCH (a:Person)-[:KNOWS]-(b)-[:KNOWS]-(c)-[:KNOWS]-(a) RETURN a.id AS a, count(*) AS n ORDER BY a") == [("a", 2), ("b", 2), ("c", 2)]
    assert rows(s, "MATCH p = (a:Person)-[:KNOWS]->(b), (b)-[:KNOWS]->(c)-[:KNOWS]->(a) WHERE a.age = 25 RETURN [x IN nodes(p) | x.id] AS p, c.name AS c") == [(["a", "b"], "Cy")]
    assert rows(s, "MATCH (x:Person {id: 'c'}) MATCH (x:Person)-[:KNOWS]->(y), (y)-[:KNOWS]->(z:Person {age: 24})-[:KNOWS]->(x) RETURN y.id AS y, z.id AS z") == [("a", "b")]
    assert rows(s, "MATCH (a:Person)-[:KNOWS]->(b)<-[:KNOWS]-(a) RETURN count(*) AS n") == [(0,)]
    assert rows(s, "MATCH (x:Person) WHERE EXISTS { (x)-[:KNOWS]->(y), (y)-[:KNOWS]->(z), (z)-[:KNOWS]->(x) } RETURN x.id AS x ORDER BY x") == [("a",), ("b",), ("c",)]
    assert rows(s, "MATCH (x:Person) OPTIONAL MATCH (x)-[:KNOWS]->(y), (y)-[:KNOWS]->(z), (z)-[:KNOWS]->(x) RETURN x.id AS x, z.id AS z ORDER BY x") == [("a", "c"), ("b", "a"), ("c", "b"), ("d", None)]
