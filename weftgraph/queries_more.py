"""More named queries with their SQL: lookups, writes, views and their refresh, time travel, streams, standing
queries, sources, sinks and ETL. Streams run over whole tables with the trigger availableNow, into Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Graph, tpch_graph
from .cypher.compiler import compile_query
from .operators import etl, eventlog, knn, lookups, refresh, temporal, vector_index, views
from .plans import paths
from .plans.lineage import scratch
from .queries import _KNOWS, _LOG, _LWW, _UNTIL, VIEW, _VIEW_SQL, _add, _cypher, _knows, _log, _rounded, _sql, _t
from .session import GraphSession
from .sources import packages, readers, sinks
from .streaming import pipeline, standing, windows

# --- scans and lookups ------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> Graph:
    """The graph with further labels on parts: Large from size 40 on, Cheap below a price of 1000."""
    g = tpch_graph(spark, d)
    more = F.filter(F.array(F.when(F.col("size") >= 40, "Large"), F.when(F.col("retailprice") < 1000, "Cheap")), lambda x: x.isNotNull())
    return g.with_vertices("Part", g.vertices["Part"].df.withColumn("_labels", more), "_labels")


def _on_labelled(name: str, text: str, sql: str) -> None:
    _add(name, sql)(lambda spark, d: compile_query(_labelled(spark, d), text))


_on_labelled("scan_multi_label", "MATCH (p:Part:Large:Cheap) RETURN p.id AS id, size(labels(p)) AS n", "SELECT p_partkey AS id, 3 AS n FROM part WHERE p_size >= 40 AND p_retailprice < 1000")
_on_labelled("scan_any_label", "MATCH (x:Region|Large|Cheap) RETURN labels(x)[0] AS label, x.id AS id", "SELECT 'Region' AS label, r_regionkey AS id FROM region UNION ALL SELECT 'Part', p_partkey FROM part WHERE p_size >= 40 OR p_retailprice < 1000")
_on_labelled("scan_extra_label", "MATCH (p:Large) RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size >= 40")


@_add("scan_property_range", "SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size BETWEEN 10 AND 20")
def scan_property_range(spark: SparkSession, d: str) -> DataFrame:
    """Bounds the wrong way round."""
    return lookups.property_range(tpch_graph(spark, d).vertices["Part"].df, "size", 20, 10).select("id", "size")


@_add("point_lookup", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookups.node(tpch_graph(spark, d), "Customer", 7).select("id", "name", F.col("mktsegment").alias("seg"))


@_add("node_states_batch", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def node_states_batch(spark: SparkSession, d: str) -> DataFrame:
    ids = _t(spark, d, "orders").where("o_totalprice > 250000").select("o_custkey")
    return lookups.node_states(tpch_graph(spark, d), "Customer", ids).select("id", "name", "acctbal")


@_add("outgoing_neighbours", "SELECT 'CONTAINS' AS rel_type, 'Part' AS dst_label, l_partkey::VARCHAR AS dst FROM lineitem WHERE l_orderkey = 7 UNION ALL SELECT 'SUPPLIED_BY', 'Supplier', l_suppkey::VARCHAR FROM lineitem WHERE l_orderkey = 7")
def outgoing_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return lookups.outgoing(tpch_graph(spark, d), "Order", 7)


@_add("time_range_scan", "SELECT event_id AS id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def time_range_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = lookups.time_range(_t(spark, d, "events"), "ts", "2024-01-10 00:00:00", "2024-01-11 00:00:00")
    return rows.select(F.col("event_id").alias("id"), "value")


@_add("columnar_scan", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_totalprice > 200000 AND o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def columnar_scan(spark: SparkSession, d: str) -> DataFrame:
    """Both conditions and the three columns reach the Parquet scan."""
    return _t(spark, d, "orders").where("o_totalprice > 200000 AND o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


_STATS = "SELECT '{0}' AS property, min({0})::VARCHAR AS least, max({0})::VARCHAR AS most, round(sum({0}), 2) AS total, count(*) - count({0}) AS nulls, count({0}) AS present, count(DISTINCT {0}) AS \"distinct\" FROM part"


@_add("property_statistics", f"{_STATS.format('p_size')} UNION ALL {_STATS.format('p_partkey')} UNION ALL {_STATS.format('p_brand').replace('round(sum(p_brand), 2)', 'NULL')}")
def property_statistics(spark: SparkSession, d: str) -> DataFrame:
    return lookups.statistics(_t(spark, d, "part"), ["p_size", "p_partkey", "p_brand"], exact=True).withColumn("total", F.round("total", 2))


@_add("catalog_columns", "SELECT * FROM (VALUES ('Region', 'id', 1), ('Region', 'name', 2), ('edge_IN_REGION', 'from_id', 1), ('edge_IN_REGION', 'to_id', 2), ('edge_IN_REGION', 'edge_type', 3)) v(table_name, column_name, ordinal)")
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    return GraphSession(spark, tpch_graph(spark, d)).list_columns().where("table_name in ('Region', 'edge_IN_REGION')").select("table_name", "column_name", "ordinal")


# --- patterns, expressions, set operations ----------------------------------------------------------------

@_add("return_node", "SELECT r_regionkey AS id, 'Region' AS label, r_name AS name FROM region")
def return_node(spark: SparkSession, d: str) -> DataFrame:
    """A whole node as one value, taken apart again."""
    return compile_query(tpch_graph(spark, d), "MATCH (r:Region) RETURN r").select(F.col("r._id").alias("id"), F.col("r._label").alias("label"), F.col("r.name").alias("name"))


_cypher("exists_under_or", "MATCH (c:Customer) WHERE c.acctbal > 9000 OR EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 250000 } RETURN c.id AS id",
        "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
_cypher("exists_correlated", "MATCH (c:Customer) WHERE c.id < 0 OR EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 30 } RETURN c.id AS id",
        "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)")
_cypher("exists_in_case", "MATCH (c:Customer) RETURN c.id AS id, CASE WHEN EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 250000 } THEN 'big' ELSE 'small' END AS class",
        "SELECT c_custkey AS id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) THEN 'big' ELSE 'small' END AS class FROM customer")
_cypher("non_ascii_alias", "MATCH (r:Region) RETURN r.name AS größe, r.id AS 名前", 'SELECT r_name AS "größe", r_regionkey AS "名前" FROM region')
_cypher("union_mixed", "MATCH (o:Order) RETURN o.orderstatus AS s UNION ALL MATCH (o:Order) RETURN o.orderpriority AS s UNION MATCH (c:Customer) RETURN c.mktsegment AS s",
        "SELECT o_orderstatus AS s FROM orders UNION SELECT o_orderpriority FROM orders UNION SELECT c_mktsegment FROM customer")
_cypher("fn_properties", "MATCH (r:Region) RETURN properties(r).name AS name, size(keys(r)) AS n, {a: r.id, b: 'x'}.a AS a", "SELECT r_name AS name, 1 AS n, r_regionkey AS a FROM region")
_cypher("fn_trig", "MATCH (p:Part) RETURN p.id AS id, round(sin(p.size), 6) AS s, round(cos(p.size), 6) AS c, round(tan(p.size), 4) AS t, round(atan(p.size), 6) AS a, round(atan2(p.size, 2), 6) AS b, round(exp(p.size / 10.0), 4) AS e, round(log10(p.size), 6) AS l, round(pow(p.size, 2), 2) AS q, round(asin(1.0 / p.size), 6) AS i, round(acos(1.0 / p.size), 6) AS o",
        "SELECT p_partkey AS id, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 4) AS t, round(atan(p_size), 6) AS a, round(atan2(p_size, 2), 6) AS b, round(exp(p_size / 10.0::DOUBLE), 4) AS e, round(log10(p_size), 6) AS l, round(pow(p_size, 2), 2) AS q, round(asin(1.0::DOUBLE / p_size), 6) AS i, round(acos(1.0::DOUBLE / p_size), 6) AS o FROM part")
_cypher("fn_datetime", "MATCH (e:Event) RETURN e.id AS id, datetime(e.ts) = e.ts AS same, time(e.ts) AS t, toString(date(e.ts)) AS d",
        "SELECT event_id AS id, true AS same, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d') AS d FROM events")
_cypher("agg_sum_distinct", "MATCH (p:Part) RETURN p.brand AS brand, sum(DISTINCT p.size) AS s, round(avg(DISTINCT p.size), 6) AS a, size(collect(DISTINCT p.size)) AS n",
        "SELECT p_brand AS brand, sum(DISTINCT p_size) AS s, round(avg(DISTINCT p_size), 6) AS a, count(DISTINCT p_size) AS n FROM part GROUP BY 1")
_sql("sql_order_unprojected", "SELECT name FROM Customer ORDER BY acctbal DESC, id LIMIT 15", "SELECT c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
_sql("sql_limit_offset", "SELECT id, totalprice FROM `Order` ORDER BY id LIMIT 30 OFFSET 12", "SELECT o_orderkey AS id, o_totalprice AS totalprice FROM orders ORDER BY 1 LIMIT 30 OFFSET 12")


@_add("load_csv", "SELECT n_name AS name, n_nationkey::VARCHAR AS key, length(n_name) AS n FROM nation")
def load_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    _t(spark, d, "nation").write.option("header", True).csv(path)
    return compile_query(tpch_graph(spark, d), f"LOAD CSV WITH HEADERS FROM '{path}' AS row RETURN row.n_name AS name, row.n_nationkey AS key, size(row.n_name) AS n")


@_add("sql_event_join", "SELECT c_name AS name, count(*) AS n FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase' GROUP BY 1")
def sql_event_join(spark: SparkSession, d: str) -> DataFrame:
    """An event table joined with a label's table."""
    s = GraphSession(spark, tpch_graph(spark, d))
    s.register_event_table("raw_events", _t(spark, d, "events"))
    return s.sql("SELECT c.name, count(*) AS n FROM raw_events e JOIN Customer c ON c.id = e.user_id WHERE e.event_type = 'purchase' GROUP BY c.name")


@_add("closure_lookup", f"WITH RECURSIVE {_KNOWS}, r AS (SELECT u, v, 1 AS distance FROM e UNION SELECT r.u, e.v, distance + 1 FROM r JOIN e ON r.v = e.u WHERE distance < 6), m AS (SELECT u, v, min(distance) AS distance FROM r GROUP BY 1, 2), p AS (SELECT c_custkey AS u, c_custkey + 50 AS v FROM customer) SELECT p.u, p.v, distance IS NOT NULL AS reachable, distance FROM p LEFT JOIN m ON m.u = p.u AND m.v = p.v")
def closure_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Whether each customer reaches the one 50 further on, and how far that is."""
    reach = paths.closure(_knows(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v")), 6)
    return paths.lookup(reach, _t(spark, d, "customer").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + 50).alias("v")))


@_add("vector_index_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """The index's mean recall of the ten nearest, against brute force over all vectors, is at least 0.9."""
    v = _t(spark, d, "embeddings")
    queries = v.where("vec_id % 50 = 0")
    found = vector_index.VectorIndex.build(v, lists=32).search(queries, 10)
    return vector_index.recall(found, knn.knn(v, queries, 10)).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("enough"))


@_add("vector_index_changes", "SELECT vec_id AS query_id, CASE WHEN vec_id % 100 = 0 THEN vec_id + 1000000 ELSE vec_id END AS vec_id FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_changes(spark: SparkSession, d: str) -> DataFrame:
    """The nearest one after every 100th vector has been removed and put in again under another id."""
    v = _t(spark, d, "embeddings").select("vec_id", "embedding")
    some = v.where("vec_id % 100 = 0")
    index = vector_index.VectorIndex.build(v, lists=16).remove(some).insert(some.withColumn("vec_id", F.col("vec_id") + 1000000))
    return index.search(v.where("vec_id % 50 = 0"), 1, probes=16).select("query_id", "vec_id")


# --- writes ---------------------------------------------------------------------------------------------------


def _parallel(spark: SparkSession, d: str) -> GraphSession:
    """Orders and parts with parallel relationships, and a second kind of nodes with the parts' ids."""
    g = tpch_graph(spark, d)
    line = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("n"))
    small = Graph(spark).with_vertices("Order", g.vertices["Order"].df).with_vertices("Part", g.vertices["Part"].df).with_vertices("Other", g.vertices["Part"].df.select("id"))
    return GraphSession(spark, small.with_edges("HAS", "Order", "Part", line).with_edges("HAS", "Order", "Other", line))


@_add("write_delete_rel", "SELECT 'Part' AS label, l_orderkey AS o, l_partkey AS p, l_quantity AS q, count(*) AS n FROM lineitem WHERE NOT l_quantity > 10 GROUP BY ALL UNION ALL SELECT 'Other', l_orderkey, l_partkey, l_quantity, count(*) FROM lineitem GROUP BY ALL")
def write_delete_rel(spark: SparkSession, d: str) -> DataFrame:
    """Only what was matched goes: neither parallel relationships nor those to nodes of another label with one id."""
    s = _parallel(spark, d)
    s.cypher("MATCH (o:Order)-[r:HAS]->(p:Part) WHERE r.q > 10 DELETE r")
    return s.cypher("MATCH (o:Order)-[r:HAS]->(p) RETURN labels(p)[0] AS label, o.id AS o, p.id AS p, r.q AS q, count(*) AS n")


@_add("write_set_rel", "SELECT 'Part' AS label, CASE WHEN l_quantity > 10 THEN l_quantity + 1000 ELSE l_quantity END AS q, CASE WHEN l_quantity > 10 THEN 'many' END AS kind, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS n, count(*) AS c FROM lineitem GROUP BY ALL UNION ALL SELECT 'Other', l_quantity, NULL, l_linenumber, count(*) FROM lineitem GROUP BY ALL")
def write_set_rel(spark: SparkSession, d: str) -> DataFrame:
    s = _parallel(spark, d)
    s.cypher("MATCH (o:Order)-[r:HAS]->(p:Part) WHERE r.q > 10 SET r.q = r.q + 1000, r.kind = 'many'")
    s.cypher("MATCH (o:Order)-[r:HAS]->(p:Part) WHERE r.n = 1 REMOVE r.n")
    parts = s.cypher("MATCH (o:Order)-[r:HAS]->(p:Part) RETURN 'Part' AS label, r.q AS q, r.kind AS kind, r.n AS n, count(*) AS c")
    return parts.unionByName(s.cypher("MATCH (o:Order)-[r:HAS]->(p:Other) RETURN 'Other' AS label, r.q AS q, r.n AS n, count(*) AS c").withColumn("kind", F.lit(None).cast("string")))


@_add("write_set_returns_new", "SELECT r_regionkey AS id, 'old ' || r_name AS name FROM region")
def write_set_returns_new(spark: SparkSession, d: str) -> DataFrame:
    return GraphSession(spark, tpch_graph(spark, d)).cypher("MATCH (r:Region) SET r.name = 'old ' + r.name RETURN r.id AS id, r.name AS name")


@_add("write_create", "SELECT n_nationkey AS id, 'city of ' || n_name AS name, 1 AS n FROM nation")
def write_create(spark: SparkSession, d: str) -> DataFrame:
    """A node and a relationship for each nation."""
    s = GraphSession(spark, tpch_graph(spark, d))
    s.cypher("MATCH (n:Nation) CREATE (c:City {name: 'city of ' + n.name})-[:CITY_IN]->(n)")
    return s.cypher("MATCH (c:City)-[:CITY_IN]->(n:Nation) RETURN n.id AS id, c.name AS name, count(*) AS n")


@_add("write_generated_ids", "SELECT count(*) + 25 AS n, count(*) + 24 AS top FROM nation")
def write_generated_ids(spark: SparkSession, d: str) -> DataFrame:
    """New integer ids follow the largest one without gaps."""
    s = GraphSession(spark, tpch_graph(spark, d))
    s.cypher("MATCH (n:Nation) CREATE (m:Nation {name: 'new ' + n.name})")
    return s.cypher("MATCH (n:Nation) RETURN count(DISTINCT n.id) AS n, max(n.id) AS top")


@_add("write_stats", "SELECT count(*) AS properties_set, 0 AS nodes_created, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS nodes_deleted FROM customer WHERE c_mktsegment = 'BUILDING'")
def write_stats(spark: SparkSession, d: str) -> DataFrame:
    s = GraphSession(spark, tpch_graph(spark, d))
    one = s.cypher("MATCH (c:Customer {mktsegment: 'BUILDING'}) SET c.seen = true").select("properties_set", "nodes_created")
    return one.join(s.cypher("MATCH (c:Customer) WHERE c.acctbal < 0 DETACH DELETE c").select("nodes_deleted"))  # one row each


@_add("bulk_ingest", "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN 'renamed' ELSE n_name END AS name, CASE WHEN n_nationkey < 5 THEN 1 END AS flag FROM nation UNION ALL SELECT 1000, 'new', 2")
def bulk_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Records put in at once: known nodes take the named properties, others are added, a repeated id counts once."""
    s = GraphSession(spark, tpch_graph(spark, d))
    s.create_nodes("Nation", [{"id": i, "name": "renamed", "flag": 1} for i in range(5)] + [{"id": 1000, "name": "twice", "flag": 3}, {"id": 1000, "name": "new", "flag": 2}], "id int, name string, flag int")
    return s.cypher("MATCH (n:Nation) RETURN n.id AS id, n.name AS name, n.flag AS flag")


@_add("soft_delete", "WITH u AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id::VARCHAR AS qid, count(DISTINCT event_type) AS n FROM events WHERE user_id % 3 <> 0 OR user_id % 6 = 0 GROUP BY 1")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    """Users that are deleted, half of whom are restored, as of the end of the log."""
    log = _log(spark, d).where("op = 'set'").unionByName(_log(spark, d).where("op <> 'set'").withColumn("op", F.lit("set")))
    ends = log.groupBy("qid").agg(F.max("event_time").alias("event_time"))
    gone = ends.where("cast(qid as long) % 3 = 0").select("qid", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"), F.expr("event_time + interval 1 day").alias("event_time"), F.lit(1).cast("long").alias("seq"))
    back = gone.where("cast(qid as long) % 6 = 0").withColumn("op", F.lit("restore")).withColumn("event_time", F.expr("event_time + interval 1 day"))
    props, _ = temporal.as_of(log.unionByName(gone).unionByName(back), F.expr("TIMESTAMP '2100-01-01 00:00:00'"))
    return props.groupBy("qid").agg(F.count("*").alias("n"))


# --- views -------------------------------------------------------------------------------------------------------


@_add("mv_full_refresh", "SELECT r_name AS name, 'now' AS state FROM region UNION ALL SELECT 'ATLANTIS', 'now'")
def mv_full_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A manual view stays as it was until it is refreshed."""
    s = GraphSession(spark, tpch_graph(spark, d))
    s.create_view("regions", "MATCH (r:Region) RETURN r.name AS name")
    s.cypher("CREATE (r:Region {id: 99, name: 'ATLANTIS'})")
    before = s.sql("SELECT count(*) AS n FROM regions").first().n
    s.refresh_view("regions")
    return s.sql("SELECT name FROM regions").withColumn("state", F.lit("now" if before == 5 else "too early"))


@_add("mv_stale", "SELECT 'new ' || r_name AS name FROM region")
def mv_stale(spark: SparkSession, d: str) -> DataFrame:
    """The view's own query is answered from the graph once it has changed."""
    s = GraphSession(spark, tpch_graph(spark, d))
    s.create_view("regions", "MATCH (r:Region) RETURN r.name AS name")
    s.cypher("MATCH (r:Region) SET r.name = 'new ' + r.name")
    return s.cypher("MATCH  (r:Region) RETURN r.name AS name")


@_add("mv_incremental_mode", "SELECT r_name AS name FROM region UNION ALL SELECT 'ATLANTIS'")
def mv_incremental_mode(spark: SparkSession, d: str) -> DataFrame:
    s = GraphSession(spark, tpch_graph(spark, d))
    s.sql("CREATE MATERIALIZED VIEW regions WITH INCREMENTAL AS MATCH (r:Region) RETURN r.name AS name")
    s.cypher("CREATE (r:Region {id: 99, name: 'ATLANTIS'})")
    return s.sql("SELECT name FROM regions")


@_add("mv_row_predicate", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING' OR c_acctbal < -500 ORDER BY bal DESC, name LIMIT 40")
def mv_row_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Conditions on, and an order of, a view's rows."""
    s = GraphSession(spark, tpch_graph(spark, d))
    s.create_view("rich", "MATCH (c:Customer) RETURN c.name AS name, c.acctbal AS bal, c.mktsegment AS seg")
    return s.sql("SELECT name, bal FROM rich WHERE bal > 5000 AND seg = 'BUILDING' OR bal < -500 ORDER BY bal DESC, name LIMIT 40")


@_add("mv_query_column", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def mv_query_column(spark: SparkSession, d: str) -> DataFrame:
    s = GraphSession(spark, tpch_graph(spark, d))
    s.create_view("segments", "MATCH (c:Customer) RETURN c.mktsegment AS seg, count(*) AS n")
    return s.sql("SELECT seg, n FROM segments WHERE seg = 'BUILDING'")


def _event_views(spark: SparkSession, d: str) -> tuple[refresh.EventViews, dict]:
    """Event views over the events, of which `upto['n']` tells the newest snapshot that has come."""
    upto = {"n": 3}
    held = refresh.EventViews(spark, scratch(spark, "views"))
    held.register_table("ev", lambda: _t(spark, d, "events").withColumn("_snapshot", F.col("event_id") % 10).where(F.col("_snapshot") <= upto["n"]))
    return held, upto


@_add("mv_refresh_modes", _VIEW_SQL)
def mv_refresh_modes(spark: SparkSession, d: str) -> DataFrame:
    """A push view: its first generation, two incremental ones, and a refresh without news, which writes nothing."""
    held, upto = _event_views(spark, d)
    held.create("by_type", "ev", VIEW, "push")
    for n in (6, 9):
        upto["n"] = n
        held.refresh_incremental("by_type")
    assert held.refresh_incremental("by_type") == 0 and held.listed() == [("by_type", "ev", "push")]
    return _rounded(held.rows("by_type"))


@_add("mv_sql_event", "SELECT event_type, count(DISTINCT user_id) AS users, round(max(value), 4) AS top FROM events GROUP BY 1")
def mv_sql_event(spark: SparkSession, d: str) -> DataFrame:
    held, upto = _event_views(spark, d)
    held.create("users", "ev", "SELECT event_type, count(DISTINCT user_id) AS users, round(max(value), 4) AS top FROM ev GROUP BY event_type", "pull:30")
    upto["n"] = 9
    held.refresh_incremental("users")
    return held.rows("users")


@_add("mv_retention", "SELECT * FROM (VALUES (4), (5)) v(version)")
def mv_retention(spark: SparkSession, d: str) -> DataFrame:
    """Of five generations, all of them old, the newest two stay."""
    e = _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    table = views.generation(e, 1, 1)
    for v in range(2, 6):
        table = table.unionByName(views.generation(e, v, v))
    old = table.withColumn(views.UPDATED, F.expr("TIMESTAMP '2020-01-01 00:00:00'"))
    return views.retained(old, 2, 30).select(F.col(views.VERSION).cast("int").alias("version")).distinct()


@_add("sq_linked_view", "SELECT c_custkey AS id, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 5000 AND c_custkey % 10 <> 3 UNION ALL SELECT c_custkey, 1.0 FROM customer WHERE c_acctbal <= 5000 AND c_custkey % 10 = 4")
def sq_linked_view(spark: SparkSession, d: str) -> DataFrame:
    """A view that begins with the matching nodes and follows what the standing query reports."""
    s = GraphSession(spark, tpch_graph(spark, d))
    nodes = s.graph.vertices["Customer"].df.select("id", "acctbal")
    s.link_view("rich", standing.StandingQuery("sq", "rich", standing.Prop("acctbal", "greater_than", 5000)), nodes)
    gone = nodes.where("acctbal > 5000 and id % 10 = 3").withColumn("transition", F.lit("unmatched"))
    new = nodes.where("acctbal <= 5000 and id % 10 = 4").withColumn("acctbal", F.lit(1.0)).withColumn("transition", F.lit("matched"))
    s.follow("rich", gone.unionByName(new).withColumn("seq", F.lit(1)))
    return s.sql("SELECT id, acctbal FROM rich")


@_add("mv_delta_versions", "SELECT r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'changed' ELSE r_name END AS name, 3 AS version FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 50, 'new', 3")
def mv_delta_versions(spark: SparkSession, d: str) -> DataFrame:
    """Changes apply to the version they were made for; a known key can't be inserted."""
    view = views.GraphView("v", "", "manual", tpch_graph(spark, d).vertices["Region"].df.select("id", "name"), key=("id",))
    change = lambda *rows: spark.createDataFrame(rows, "id int, name string, op string, seq int")
    view = view.applied(change((50, "new", "insert", 1), (1, "changed", "update", 2)), expected=1).applied(change((2, "", "delete", 1)))
    for rows, expected in (((50, "again", "insert", 1), 3), ((60, "late", "insert", 1), 2)):
        try:
            view = view.applied(change(rows), expected)
        except ValueError:
            continue
    return view.rows.withColumn("version", F.lit(view.log[-1][0]))


# --- time travel -----------------------------------------------------------------------------------------------


def _history(spark: SparkSession, d: str) -> DataFrame:
    """The log of the users' events, and a relationship to each event type from its first event on."""
    log = _log(spark, d).withColumn("qid", F.concat(F.lit("User:"), "qid")).withColumn("value", F.col("value").cast("string"))
    e = _t(spark, d, "events")
    kinds = e.select(F.concat(F.lit("Kind:"), "event_type").alias("qid"), F.lit("set").alias("op"), F.lit("named").alias("key"), F.col("event_type").alias("value"), F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("event_time"), F.lit(0).cast("long").alias("seq")).distinct()
    links = e.select(F.concat(F.lit("User:"), F.col("user_id").cast("string")).alias("qid"), F.lit("add_edge").alias("op"), F.lit("DID").alias("key"), F.concat(F.lit("Kind:"), "event_type").alias("value"), F.col("ts").alias("event_time"), F.col("event_id").alias("seq"))
    return log.unionByName(kinds).unionByName(links)


def _as_of(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        history = _history(spark, d)
        kind = dict(history.dtypes)["event_time"]
        history = history.withColumn("event_time", F.col("event_time").cast("timestamp")) if kind != "timestamp" else history
        return GraphSession(spark, history=history, history_types={"User": {"id": "bigint", "purchase": "double"}}).cypher(text)
    _add(name, sql)(run)


_as_of("as_of_cypher", "MATCH (u:User) AS OF 20240115 WHERE u.purchase > 20 RETURN u.id AS id, u.purchase AS purchase", f"WITH l AS ({_LOG}), w AS ({_LWW.format(_UNTIL.format('2024-01-15'))}) SELECT qid::BIGINT AS id, value::DOUBLE AS purchase FROM w WHERE op = 'set' AND key = 'purchase' AND value::DOUBLE > 20")
_as_of("as_of_edges", "MATCH (u:User)-[:DID]->(k:Kind) AS OF 1704758400000000 RETURN k.named AS kind, count(*) AS n", "SELECT event_type AS kind, count(DISTINCT user_id) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-09' AND user_id::VARCHAR IN (SELECT user_id::VARCHAR FROM events WHERE ts <= TIMESTAMP '2024-01-09') GROUP BY 1")


_as_of("as_of_filters", "MATCH (u:User) AS OF '2024-01-12' WHERE u.click IS NOT NULL AND u.signup IS NULL OR u.purchase > 40 RETURN u.id AS id", f"WITH l AS ({_LOG}), w AS ({_LWW.format(_UNTIL.format('2024-01-12'))}), p AS (SELECT qid, max(value::DOUBLE) FILTER (key = 'purchase') AS purchase, bool_or(key = 'click') AS click, bool_or(key = 'signup') AS signup FROM w WHERE op = 'set' GROUP BY 1) SELECT qid::BIGINT AS id FROM p WHERE click AND NOT signup OR purchase > 40")


# --- standing queries --------------------------------------------------------------------------------------------

_SQ_KINDS = {"exists": ("", "p_name IS NOT NULL"), "equals": ("Brand#11", "p_brand = 'Brand#11'"), "not_equals": ("Brand#11", "p_brand <> 'Brand#11'"), "greater_than": (25, "p_size > 25"), "less_than": (5, "p_size < 5"), "starts_with": ("Brand#1", "starts_with(p_brand, 'Brand#1')"), "contains": ("#3", "contains(p_brand, '#3')"), "ends_with": ("2", "ends_with(p_brand, '2')"), "is_null": ("", "p_name IS NULL"), "is_not_null": ("", "p_name IS NOT NULL")}


@_add("sq_predicates", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM part WHERE {test}" for k, (_, test) in _SQ_KINDS.items()))
def sq_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of property predicate."""
    nodes, out = tpch_graph(spark, d).vertices["Part"].df, None
    for kind, (value, _) in _SQ_KINDS.items():
        key = "size" if kind.endswith("_than") else "name" if kind in ("exists", "is_null", "is_not_null") else "brand"
        part = standing.matching(nodes, standing.StandingQuery(kind, kind, standing.Prop(key, kind, value))).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.union(part)
    return out


@_add("sq_combinators", "SELECT p_partkey AS id FROM part WHERE p_size >= 40 AND (p_retailprice < 1000 OR NOT starts_with(p_brand, 'Brand#1'))")
def sq_combinators(spark: SparkSession, d: str) -> DataFrame:
    nodes = _labelled(spark, d).vertices["Part"].df.withColumnRenamed("_labels", "labels")
    pattern = standing.pattern_of({"and": [{"labels": ["Large"]}, {"or": [{"type": "LabelFilter", "labels": ["Cheap"]}, {"Not": {"PropertyFilter": {"key": "brand", "condition": {"StartsWith": "Brand#1"}}}}]}]})
    return standing.matching(nodes, standing.StandingQuery("sq", "large", pattern))


@_add("sq_variable_edge", f"WITH RECURSIVE {_KNOWS}, r AS (SELECT u, v, 1 AS n FROM e UNION SELECT r.u, e.v, n + 1 FROM r JOIN e ON r.v = e.u WHERE n < 3) SELECT DISTINCT u AS id FROM r JOIN customer t ON t.c_custkey = v JOIN customer c ON c.c_custkey = u WHERE n BETWEEN 2 AND 3 AND t.c_acctbal > 9000 AND c.c_acctbal < 1000")
def sq_variable_edge(spark: SparkSession, d: str) -> DataFrame:
    """Poor customers from whom a rich one is two or three KNOWS away."""
    edges = _knows(spark, d).withColumn("rel_type", F.lit("KNOWS"))
    q = standing.StandingQuery("sq", "near wealth", standing.Prop("acctbal", "less_than", 1000), (standing.Hop("KNOWS", standing.Prop("acctbal", "greater_than", 9000), least=2, most=3),))
    return standing.matching(tpch_graph(spark, d).vertices["Customer"].df, q, edges)


def _replayed(spark: SparkSession, parts: list[DataFrame], run: Callable[[DataFrame, str], object]) -> None:
    """Each part arrives as files of one folder and is processed before the next one: run(stream, checkpoint)
    starts the query."""
    root = scratch(spark, "stream")
    for p in parts:
        p.write.mode("append").parquet(f"{root}/in")
        run(spark.readStream.schema(p.schema).parquet(f"{root}/in"), f"{root}/cp").awaitTermination()


def _to_table(spark: SparkSession, parts: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the parts appends."""
    out = scratch(spark, "stream-out")
    _replayed(spark, parts, lambda s, cp: build(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start())
    return spark.read.parquet(out)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """The users' last value of each event type, as property changes."""
    return _t(spark, d, "events").select(F.col("user_id").cast("string").alias("qid"), F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("event_time_us"), F.col("event_id").alias("seq"))


_SQ_NOW = "SELECT user_id::VARCHAR AS qid FROM (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events {0} GROUP BY 1, 2) WHERE event_type = 'purchase' AND v > 50"


@_add("sq_stream", f"WITH a AS ({_SQ_NOW.format(chr(32))}) SELECT qid FROM a")
def sq_stream(spark: SparkSession, d: str) -> DataFrame:
    """Who matches at the end of a stream of changes that arrives in two parts, from its transitions."""
    q = standing.StandingQuery("s", "big purchase", standing.Prop("purchase", "greater_than", 50))
    c = _changes(spark, d)
    got = _to_table(spark, [c.where("seq % 2 = 0"), c.where("seq % 2 = 1")], lambda s: standing.transition_stream(s, [q]))
    return standing.view_from_transitions(got).select("qid")


@_add("sq_stream_edges", f"WITH m AS ({_SQ_NOW.format(chr(32))}), e AS (SELECT user_id::VARCHAR AS a, (user_id + 1)::VARCHAR AS b FROM (SELECT DISTINCT user_id FROM events)) SELECT DISTINCT e.a AS qid FROM e JOIN m ON m.qid = e.b")
def sq_stream_edges(spark: SparkSession, d: str) -> DataFrame:
    """Users who know one whose last purchase was a big one: relationships and properties arrive in three parts, and
    a change of the far node is reported at the near one."""
    c = _changes(spark, d).select("qid", F.lit("set").alias("op"), "key", "value", F.col("event_time_us").alias("event_time"), "seq")
    users = _t(spark, d, "events").select("user_id").distinct()
    edges = users.select(F.col("user_id").cast("string").alias("qid"), F.lit("add_edge").alias("op"), F.lit("NEXT_TO").alias("key"), (F.col("user_id") + 1).cast("string").alias("value"), F.lit(0).cast("long").alias("event_time"), F.lit(0).cast("long").alias("seq"))
    q = standing.StandingQuery("s", "next to a buyer", standing.All(()), (standing.Hop("NEXT_TO", standing.Prop("purchase", "greater_than", 50)),))
    runner = standing.Runner(spark, scratch(spark, "runner"), [q])
    _replayed(spark, [c.where("seq % 2 = 0"), edges, c.where("seq % 2 = 1")], lambda s, cp: pipeline.start(s, runner, cp, available_now=True))
    return runner.matches(2).select(F.col("id").alias("qid"))


@_add("sq_to_view", f"SELECT qid, v AS purchase FROM (SELECT user_id::VARCHAR AS qid, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2) WHERE event_type = 'purchase' AND v > 50")
def sq_to_view(spark: SparkSession, d: str) -> DataFrame:
    """The view that follows a standing query's transitions, with the nodes' properties."""
    q = standing.StandingQuery("s", "big purchase", standing.Prop("purchase", "greater_than", 50))
    got = _to_table(spark, [_changes(spark, d)], lambda s: standing.transition_stream(s, [q]))
    rows = standing.view_from_transitions(got)
    last = _changes(spark, d).where("key = 'purchase'").groupBy("qid").agg(F.max_by("value", F.struct("event_time_us", "seq")).cast("double").alias("purchase"))
    return rows.select("qid").join(last, "qid")


# --- streams -------------------------------------------------------------------------------------------------------

_HOURS = "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM {0} GROUP BY 1 HAVING window_start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '{1}' FROM events)"


def _stream_events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


@_add("stream_tumbling", _HOURS.format("events", "30 minutes"))
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Closed windows of a stream; the watermark is 20 minutes of disorder and 10 of lateness behind."""
    got = _to_table(spark, [_stream_events(spark, d)], lambda s: windows.tumbling_stream(s, "ts", "value", "1 hour", "20 minutes", "10 minutes"))
    return got.select("window_start", "n", F.round("total", 4).alias("total"))


@_add("stream_late_data", _HOURS.format("(SELECT * FROM events WHERE event_id % 7 <> 0 OR ts >= TIMESTAMP '2024-01-20')", "0 minutes"))
def stream_late_data(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh event of the first days arrives after all others: it is too late and dropped."""
    e = _stream_events(spark, d)
    late = (F.col("event_id") % 7 == 0) & (F.col("ts") < F.expr("TIMESTAMP '2024-01-20 00:00:00'"))
    got = _to_table(spark, [e.where(~late), e.where(late)], lambda s: windows.tumbling_stream(s, "ts", "value", "1 hour"))
    return got.select("window_start", "n", F.round("total", 4).alias("total"))


@_add("stream_dropped_late", "SELECT count(*) AS dropped FROM events WHERE event_id % 7 = 0 AND ts < TIMESTAMP '2024-01-20'")
def stream_dropped_late(spark: SparkSession, d: str) -> DataFrame:
    """How many were dropped, by the stream's own count."""
    e, counts = _stream_events(spark, d), []
    late = (F.col("event_id") % 7 == 0) & (F.col("ts") < F.expr("TIMESTAMP '2024-01-20 00:00:00'"))

    def run(s: DataFrame, cp: str):
        # each event is a window of its own key, so that no two late ones are counted as one row of a partial aggregate
        keyed = s.withWatermark("ts", "0 seconds").groupBy(F.window("ts", "1 hour"), "event_id").agg(F.count("*").alias("n"))
        q = keyed.writeStream.format("noop").option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        counts.append(pipeline.dropped_late(q))
        return q

    _replayed(spark, [e.where(~late), e.where(late)], run)
    return spark.createDataFrame([(sum(counts),)], "dropped long")


@_add("stream_watermark", "SELECT epoch_ms(max(ts)) - 90000 AS watermark_ms FROM events")
def stream_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Where the watermark stands after two parts: behind the newest event by the disorder and the lateness. Spark's
    watermarks are whole milliseconds and cut the rest off, so the events' times are rounded first."""
    e, seen = _stream_events(spark, d).withColumn("ts", temporal.nearest_millis(F.col("ts"))), []

    def run(s: DataFrame, cp: str):
        w = windows.tumbling_stream(s, "ts", "value", "1 hour", "1 minute", "30 seconds")
        q = w.writeStream.format("noop").option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(pipeline.watermark_of(q))
        return q

    _replayed(spark, [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")], run)
    return spark.createDataFrame([(seen[-1],)], "w string").select(F.unix_millis(F.to_timestamp("w")).alias("watermark_ms"))


@_add("stream_global_watermark", "SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase')).epoch_ms() AS watermark_ms FROM events")
def stream_global_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Of two joined inputs the one that is further behind sets the watermark (times rounded as in stream_watermark)."""
    pipeline.min_watermark_policy(spark)
    seen = []

    def run(s: DataFrame, cp: str):
        clicks = s.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
        bought = s.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("u"), F.col("ts").alias("paid"))
        q = windows.joined_streams(clicks, bought, "u", "at", "paid", "1 hour", "0 seconds").writeStream.format("noop").option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(pipeline.watermark_of(q))
        return q

    _replayed(spark, [_stream_events(spark, d).withColumn("ts", temporal.nearest_millis(F.col("ts")))], run)
    return spark.createDataFrame([(seen[-1],)], "w string").select(F.unix_millis(F.to_timestamp("w")).alias("watermark_ms"))


@_add("stream_sliding", "WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') AS b, value FROM events), s AS (SELECT b AS window_start, value FROM w UNION ALL SELECT b - INTERVAL '30 minutes', value FROM w) SELECT window_start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1 HAVING window_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events)")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    got = _to_table(spark, [_stream_events(spark, d)], lambda s: windows.tumbling_stream(s, "ts", "value", "1 hour", slide="30 minutes"))
    return got.select("window_start", "n", F.round("total", 4).alias("total"))


@_add("stream_sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL '2 hours' <= (SELECT max(ts) FROM events)")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    got = _to_table(spark, [_stream_events(spark, d)], lambda s: windows.session_stream(s, "ts", "2 hours", "user_id"))
    return got.select("user_id", "session_start", "n")


@_add("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event is sent twice; each comes out once."""
    e = _stream_events(spark, d)
    return _to_table(spark, [e.union(e.where("event_id % 2 = 0")), e.where("event_id % 2 = 1")], lambda s: windows.deduplicated(s, ["event_id"], "ts", "60 days")).select("event_id", "user_id")


@_add("stream_join", "SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL '1 hour' AND a.ts + INTERVAL '1 hour'")
def stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Two streams joined on the user, within an hour."""
    def build(s: DataFrame) -> DataFrame:
        clicks = s.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
        bought = s.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("u"), F.col("ts").alias("paid"))
        return windows.joined_streams(clicks, bought, "u", "at", "paid", "1 hour").select("click", "purchase")
    return _to_table(spark, [_stream_events(spark, d)], build)


@_add("stream_enrich", "SELECT event_id, c_name AS name FROM events LEFT JOIN customer ON c_custkey = user_id")
def stream_enrich(spark: SparkSession, d: str) -> DataFrame:
    """A stream joined with a table."""
    names = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return _to_table(spark, [_stream_events(spark, d)], lambda s: s.join(names, "user_id", "left").select("event_id", "name"))


# --- sources, the event log and sinks ----------------------------------------------------------------------------


def _json_events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").alias("id"), "user_id", "event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("at"))).alias("value"))


@_add("source_json_lines", "SELECT event_id::VARCHAR AS event_id, epoch_ms(ts) AS ms, event_type AS kind FROM events")
def source_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """A stream of JSON lines, some of which aren't objects. Milliseconds are the nearest, halves away from zero."""
    path, out = scratch(spark, "jsonl"), scratch(spark, "jsonl-out")
    _json_events(spark, d).union(spark.createDataFrame([("not json",), ("[1]",), ("",)], "value string")).write.text(path)
    rows = readers.json_lines(spark, path, "ev", "id", "at").select("event_id", F.unix_millis(temporal.nearest_millis(F.col("event_time"))).alias("ms"), F.get_json_object("payload", "$.event_type").alias("kind"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}-cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@_add("source_polled", "SELECT n_nationkey::VARCHAR AS event_id, 'nation' AS topic, n_name AS name FROM nation")
def source_polled(spark: SparkSession, d: str) -> DataFrame:
    """A broker's three shards, each read by a partition of its own."""
    import json

    out, cp = scratch(spark, "polled"), scratch(spark, "polled-cp")
    held = json.dumps([[str(r[0]), "nation", json.dumps({"n": r[1]})] for r in _t(spark, d, "nation").select("n_nationkey", "n_name").collect()])
    q = readers.polled(spark, "weftgraph.sources.readers:Scripted", records=held, shards="3").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(out).select("event_id", "topic", F.get_json_object("payload", "$.n").alias("name"))


@_add("source_event_time", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 1 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) END AS us FROM events")
def source_event_time(spark: SparkSession, d: str) -> DataFrame:
    """Times as seconds, milliseconds, microseconds and text."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.floor(us / 1_000_000).cast("string")).when(kind == 1, F.floor(us / 1000).cast("string")).when(kind == 2, us.cast("string")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), F.unix_micros(temporal.event_time(text)).alias("us"))


@_add("source_time_fallback", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN 5 ELSE 7 END AS us FROM events")
def source_time_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A change's own time, else its batch's, else its arrival."""
    own = F.when(F.col("event_id") % 3 == 0, F.unix_micros(F.col("ts").cast("timestamp")))
    batch = F.when(F.col("event_id") % 3 == 1, F.lit(5).cast("long"))
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), temporal.clock(own, batch, F.lit(7).cast("long")).alias("us"))


@_add("event_log_append", "SELECT event_id % 3 AS snapshot, event_type AS topic, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def event_log_append(spark: SparkSession, d: str) -> DataFrame:
    """Batches are routed by topic and appended; one is repeated and replaces itself."""
    path = scratch(spark, "log")
    e = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("topic"), F.lit("{}").alias("payload"), (F.col("event_id") % 3).alias("b"))
    handle = pipeline.event_batches({"click": "event_table", "view": "both", "purchase": "graph", "signup": "graph", "error": "graph"}, path)
    for b in (0, 1, 1, 2):
        handle(e.where(F.col("b") == b).drop("b"), b)
    return spark.read.parquet(path).groupBy(F.col("_snapshot").cast("bigint").alias("snapshot"), "topic").agg(F.count("*").alias("n"))


@_add("event_log_stream", "SELECT event_type AS topic, count(*) AS n, 3 AS snapshots FROM events GROUP BY 1")
def event_log_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream into the log: one snapshot an epoch, aligned with the checkpoint."""
    path = scratch(spark, "log")
    e = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("topic"), F.lit("{}").alias("payload"), F.col("event_id").alias("n"))
    _replayed(spark, [e.where(F.col("n") % 3 == k).drop("n") for k in range(3)], lambda s, cp: pipeline.start(s, pipeline.event_batches({}, path), cp, available_now=True))
    return spark.read.parquet(path).groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct("_snapshot").alias("snapshots"))


@_add("event_topic_router", "SELECT event_type AS topic, event_type <> 'error' AS logged, event_type IN ('error', 'view', 'click') AS projected, count(*) AS n FROM events GROUP BY 1, 2, 3")
def event_topic_router(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("event_id", F.col("event_type").alias("topic"))
    table, graph = eventlog.routed(e, {"error": "graph", "purchase": "event_table", "signup": "event_table"})
    seen = e.join(table.select("event_id", F.lit(True).alias("l")), "event_id", "left").join(graph.select("event_id", F.lit(True).alias("g")), "event_id", "left")
    return seen.groupBy("topic", F.coalesce("l", F.lit(False)).alias("logged"), F.coalesce("g", F.lit(False)).alias("projected")).agg(F.count("*").alias("n"))


@_add("event_null_fields", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END AS a FROM events")
def event_null_fields(spark: SparkSession, d: str) -> DataFrame:
    """A JSON null is an empty text, a missing field NULL, also beside a null of the same name further in."""
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, '{"a": null, "b": {"a": 1}}').when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"a": "'), "event_type", F.lit('", "b": {"a": null}}'))).otherwise('{"b": {"a": null}}').alias("payload"))
    return eventlog.flattened(e, {"a": "string"}).select("event_id", "a")


@_add("event_compaction", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids, true AS few FROM events")
def event_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Many small files become one for each million rows."""
    src, dst = scratch(spark, "small"), scratch(spark, "large")
    _t(spark, d, "events").select("event_id", "value").repartition(12).write.parquet(src)
    small = eventlog.consolidation(spark, src, ratio=1.0)
    rows = spark.read.parquet(*small)
    eventlog.compacted(rows, 1_000_000).write.parquet(dst)
    files = spark.read.parquet(dst).select(F.input_file_name().alias("f")).distinct().count()
    return spark.read.parquet(dst).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.lit(files <= 1 + rows.count() // 1_000_000).alias("few"))


@_add("microbatch_writer", "SELECT count(*) AS n, true AS several FROM nation")
def microbatch_writer(spark: SparkSession, d: str) -> DataFrame:
    """Single events, a snapshot for every ten."""
    path = scratch(spark, "micro")
    w = pipeline.MicrobatchWriter(spark, path, "event_id int, payload string", max_events=10, max_ms=60_000, adaptive=False)
    for r in _t(spark, d, "nation").select("n_nationkey", "n_name").toLocalIterator():  # a client's single events
        w.add({"event_id": r[0], "payload": r[1]})
    w.flush()
    return spark.read.parquet(path).agg(F.count("*").alias("n"), (F.count_distinct("_snapshot") >= 3).alias("several"))


@_add("graph_sink", "SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS last, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def graph_sink(spark: SparkSession, d: str) -> DataFrame:
    """Field records of two batches put into a graph: nodes, their latest properties, relationships."""
    s = GraphSession(spark)
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("qid"), F.lit("User").alias("label"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("event_time_us"), "event_id")
    at = F.col("event_time_us") * 10 + F.col("event_id") % 10
    props = e.select("qid", "label", F.lit("last").alias("key"), F.col("event_type").alias("value"), at.alias("event_time_us"), "event_id")
    links = e.select("qid", "label", F.lit("edge:DID:Kind").alias("key"), F.col("event_type").alias("value"), at.alias("event_time_us"), "event_id")
    kinds = e.select(F.col("event_type").alias("qid"), F.lit("Kind").alias("label"), F.lit("named").alias("key"), F.col("event_type").alias("value"), F.lit(0).cast("long").alias("event_time_us"), "event_id")
    handle = pipeline.graph_sink(s, {"User": {"id": "bigint"}})
    ends = props.groupBy("qid").agg(F.max("event_time_us").alias("top"))
    final = props.join(ends, "qid").withColumn("is_last", F.col("event_time_us") == F.col("top"))
    handle(final.where("not is_last").drop("top", "is_last").unionByName(links).unionByName(kinds).drop("event_id"), 0)
    handle(final.where("is_last").drop("top", "is_last").drop("event_id"), 1)
    return s.cypher("MATCH (u:User)-[:DID]->(k:Kind) RETURN u.id AS id, u.last AS last, count(k.named) AS kinds")


@_add("sink_rotating_json", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def sink_rotating_json(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "rotate")
    sinks.RotatingJson(path, max_bytes=1 << 20, keep=None).write(_t(spark, d, "events").select("event_id", "event_type"))
    return spark.read.json(path, schema="event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"))


@_add("sink_kafka_rows", "SELECT event_type AS key, user_id AS u, count(*) AS n FROM events GROUP BY 1, 2")
def sink_kafka_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = sinks.kafka_rows(_t(spark, d, "events").select("event_type", "user_id"), "event_type")
    return rows.groupBy("key", F.get_json_object("value", "$.user_id").cast("long").alias("u")).agg(F.count("*").alias("n"))


@_add("sink_fan_out", "SELECT 'a' AS name, count(*) AS n FROM nation UNION ALL SELECT 'b', count(*) FROM nation")
def sink_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """One result to two file sinks and one that discards it."""
    a, b, held = scratch(spark, "a"), scratch(spark, "b"), sinks.Registry()
    for name, spec in (("a", {"type": "file", "path": a}), ("b", {"type": "file", "path": b}), ("none", {"type": "drop"})):
        held.register(name, sinks.made(spec))
    held.fan_out(_t(spark, d, "nation"), 0)
    count = lambda name, path: spark.read.text(path).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("a", a).union(count("b", b))


@_add("sink_change_rows", "SELECT c_custkey AS id, c_custkey % 7 = 0 AS deleted, CASE WHEN c_custkey % 7 <> 0 THEN 'changed' END AS seg FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0")
def sink_change_rows(spark: SparkSession, d: str) -> DataFrame:
    """A view's changes as an append log with tombstones."""
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"))
    new = rows.where("id % 7 <> 0").withColumn("seg", F.when(F.col("id") % 5 == 0, "changed").otherwise(F.col("seg")))
    return sinks.change_rows(views.row_changes(rows, new, ["id"]), ["id"]).select("id", F.col("_deleted").alias("deleted"), "seg")


@_add("backup_restore", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def backup_restore(spark: SparkSession, d: str) -> DataFrame:
    g, path = tpch_graph(spark, d), scratch(spark, "backup")
    small = Graph(spark, {k: g.vertices[k] for k in ("Region", "Nation")}, tuple(e for e in g.edges if e.rel_type == "IN_REGION"))
    sinks.backup(small, path)
    return compile_query(sinks.restore(spark, path), "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS nation, r.name AS region")


# --- ETL -----------------------------------------------------------------------------------------------------------


@_add("etl_parsers", "SELECT c_custkey AS id, round(c_acctbal, 2) AS temp, c_custkey::DOUBLE AS lat, 2.5::DOUBLE AS lon, c_name AS decoded, 1700000000 + c_custkey AS s, c_nationkey AS j FROM customer")
def etl_parsers(spark: SparkSession, d: str) -> DataFrame:
    f, c = etl.FUNCTIONS, _t(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.round(f["parse_temp"](F.concat(F.round("c_acctbal", 2).cast("decimal(12,2)").cast("string"), F.lit(" °C"))), 2).alias("temp"), f["parse_geo"](F.concat(F.col("c_custkey").cast("string"), F.lit(", 2.5")))["lat"].alias("lat"), f["parse_geo"](F.lit("1, 2.5"))["lon"].alias("lon"), f["base64_decode"](F.base64(F.col("c_name"))).alias("decoded"), F.unix_seconds(f["timestamp_parse"]((F.col("c_custkey") + 1700000000).cast("string"))).alias("s"), F.variant_get(f["parse_json"](F.to_json(F.struct("c_nationkey"))), "$.c_nationkey", "int").alias("j"))


_MAILS = ["a@b.org", "a.b+c%d-e_f@x-y.z.info", "a@b", "a@b.c", "@b.org", "a@.org", "a@b@c.org", "a b@c.org", "a@b.o1g", "a@b..org", "a@b.org ", "ä@b.org", "a@-.de"]


@_add("etl_email", f"WITH m AS (SELECT unnest({_MAILS!r}) AS mail) SELECT mail, regexp_full_match(mail, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') AS ok FROM m")
def etl_email(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in _MAILS], "mail string").select("mail", etl.FUNCTIONS["validate_email"](F.col("mail")).alias("ok"))


@_add("etl_error_strategy", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS kept, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS skipped, true AS halted")
def etl_error_strategy(spark: SparkSession, d: str) -> DataFrame:
    """skip keeps the good rows and hands out the others; halt fails the job."""
    c, check = _t(spark, d, "customer"), [etl.Check("c_acctbal", "range", (0, 1e12))]
    good, bad = etl.Pipeline(checks=check).run(c)
    try:
        etl.Pipeline(checks=check, on_error="halt").run(c)[0].agg(F.sum("c_acctbal")).collect()
        halted = False
    except Exception as e:  # noqa: BLE001
        halted = "fails a check" in str(e)
    return good.agg(F.count("*").alias("kept")).join(bad.agg(F.count("*").alias("skipped"))).withColumn("halted", F.lit(halted))  # one row each


@_add("etl_statements", "SELECT 'CREATE (n:Customer {id: ' || c_custkey || ', name: ''' || c_name || ''', rich: ' || (c_acctbal > 5000)::VARCHAR || '})' AS statement FROM customer")
def etl_statements(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") > 5000).alias("rich"))
    return c.select(etl.rendered_statement(c, "CREATE (n:Customer {id: {c_custkey}, name: '{c_name}', rich: {rich}})").alias("statement"))


@_add("etl_rules", "SELECT c_custkey AS id, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 5000")
def etl_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule that is replaced between two batches: the second batch runs the new one."""
    rules, out = etl.Rules(), []
    handle = rules.batch("r", lambda good, bad: out.append(good))
    rules.load({"r": {"where": "c_acctbal > 0", "mappings": [{"source": "c_custkey", "target": "id"}]}})
    handle(_t(spark, d, "customer"), 0)
    rules.load({"r": {"where": "c_acctbal > 5000", "mappings": [{"source": "c_custkey", "target": "id"}, {"source": "c_acctbal", "target": "bal"}], "enrich": {"twice": "bal * 2"}}})
    handle(_t(spark, d, "customer"), 1)
    assert rules.listed() == [("r", 2)]
    return out[1].select("id", "twice")


@_add("udf_manager", "SELECT c_custkey AS id, c_acctbal + 1 AS e, upper(c_name) AS b, c_custkey * 3 AS p FROM customer")
def udf_manager(spark: SparkSession, d: str) -> DataFrame:
    """The three kinds of functions by name: an expression, a built-in column and Python."""
    fs = etl.Functions(spark)
    fs.register_expression("more", "c_acctbal + 1")
    fs.register("up", F.upper)
    fs.register_python("thrice", lambda r: r["c_custkey"] * 3, ["c_custkey"], "long")
    fs.register("gone", F.lower)
    fs.unregister("gone")
    assert fs.names() == ["more", "thrice", "up"]
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), fs.apply("more").alias("e"), fs.apply("up", F.col("c_name")).alias("b"), fs.apply("thrice").alias("p"))


@_add("domain_package", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_acctbal >= 0 AS ok FROM customer")
def domain_package(spark: SparkSession, d: str) -> DataFrame:
    """Typed nodes from events by a declared mapping, and whether they keep to the declarations."""
    p = packages.DomainPackage.of({"name": "shop", "labels": [{"name": "Buyer", "properties": [{"name": "name", "required": True}, {"name": "bal", "type": "double", "min": 0}]}], "mappings": [{"label": "Buyer", "id": "$.c_custkey", "properties": {"name": "$.c_name", "bal": "$.c_acctbal"}}]})
    rows = p.vertices(_t(spark, d, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("payload")), p.mappings[0])
    return rows.select("id", "name", p.valid("Buyer").alias("ok"))


@_add("recipe_run", "SELECT DISTINCT event_id::VARCHAR AS qid, 'matched' AS transition FROM events WHERE event_type = 'purchase'")
def recipe_run(spark: SparkSession, d: str) -> DataFrame:
    """A recipe from its JSON: a file source, a standing query and a file output."""
    path, out, cp = scratch(spark, "recipe"), scratch(spark, "recipe-out"), scratch(spark, "recipe-cp")
    _json_events(spark, d).write.text(path)
    r = packages.Recipe.of({"name": "r", "standing_queries": [{"name": "bought", "pattern": {"type": "PropertyFilter", "key": "event_type", "condition": {"Equals": "purchase"}}}], "ingest_sources": [{"type": "file", "path": path, "id_field": "id", "event_time_field": "at"}], "outputs": [{"type": "file", "path": out, "keep": None}]})
    for q in r.start(spark, cp, available_now=True):
        q.awaitTermination()
    return spark.read.json(out).select("qid", "transition").distinct()


@_add("recipe_edges", "SELECT DISTINCT event_id::VARCHAR AS qid FROM events WHERE user_id % 2 = 0")
def recipe_edges(spark: SparkSession, d: str) -> DataFrame:
    """A recipe whose standing query has an edge: events of users with an even number."""
    path, out, cp = scratch(spark, "recipe"), scratch(spark, "recipe-out"), scratch(spark, "recipe-cp")
    e = _t(spark, d, "events")
    lines = e.select(F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("edge:BY"))).alias("value"))
    users = e.select("user_id").distinct().select(F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), (F.col("user_id") % 2).cast("string").alias("odd"))).alias("value"))
    lines.union(users).write.text(path)
    r = packages.Recipe.of({"name": "r", "standing_queries": [{"name": "even", "pattern": {"and": []}, "edges": [{"rel_type": "BY", "target": {"type": "equals", "key": "odd", "value": "0"}}]}], "ingest_sources": [{"type": "file", "path": path, "id_field": "id"}], "outputs": [{"type": "file", "path": out, "keep": None}]})
    for q in r.start(spark, cp, available_now=True):
        q.awaitTermination()
    return spark.read.json(out).where("transition = 'matched'").select(F.substring("qid", 2, 20).alias("qid")).distinct()
