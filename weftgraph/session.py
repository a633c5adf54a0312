"""One object over a graph: Cypher, SQL, materialized views and the write API."""

from __future__ import annotations

import contextlib
import io
import re
import threading
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .catalog import Graph
from .cypher import syntax as S
from .cypher.compiler import compile_query
from .cypher.writes import execute_write
from .operators import etl, temporal, vector_index, views
from .plans.lineage import cut
from .streaming import standing

_WRITES = (S.Create, S.Merge, S.SetItems, S.RemoveItems, S.Delete)


@dataclass(frozen=True)
class Limits:
    """Bounds of an interactive query: rows returned, seconds, and nodes in the graph that is read."""

    max_rows: int = 100_000
    timeout_s: float = 30.0
    max_nodes: int = 1_000_000


class LimitError(RuntimeError):
    """A query went over one of its Limits."""


class GraphSession:
    """Holds the current graph. Writes replace it by the changed one. history: the change log (see
    operators.temporal) that AS OF queries read, with the types of its properties in `history_types`."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, history: DataFrame | None = None, history_types: dict[str, dict[str, str]] | None = None):
        self.spark, self.graph = spark, graph or Graph(spark)
        self.history, self.history_types = history, history_types
        self.event_tables: dict[str, DataFrame] = {}
        self.standing, self.functions, self.indexes = standing.Registry(), etl.Functions(spark), {}
        self.views: dict[str, views.GraphView] = {}
        self._seen: dict[str, Graph] = {}  # the graph that each view's rows were taken from

    # Cypher
    def cypher(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """Rows of a read query; counters of a write query as one row (or the rows of its RETURN). With
        AS OF <microseconds or YYYYMMDD> a read runs on the graph that the history had at that time."""
        text, moment = S.split_as_of(text)
        if moment is not None:
            if self.history is None:
                raise S.CypherError("AS OF needs a session with a history")
            at = temporal.as_of_literal(moment.replace("-", ""))
            if dict(self.history.dtypes)["event_time"] == "timestamp":
                at = F.timestamp_micros(F.lit(at))
            return compile_query(temporal.snapshot_graph(self.history, at, self.history_types), text, params)
        same = self.matching_view(text) if not params else None
        if same is not None:
            return same
        q = S.parse(text)
        if any(isinstance(c, _WRITES) for b in q.branches for c in b):
            self.graph, stats, rows = execute_write(self.graph, text, params)
            return rows if rows is not None else self.spark.createDataFrame([stats])
        return compile_query(self.graph, text, params)

    def rows(self, text: str, params: dict[str, Any] | None = None, limits: Limits = Limits()) -> list[Row]:  # noqa: B008
        """The rows of a query on the driver, within limits: LimitError if there are more rows, if it takes longer
        (its jobs are cancelled) or if the graph has more nodes."""
        if sum(t.df.limit(limits.max_nodes + 1).count() for t in self.graph.vertices.values()) > limits.max_nodes:
            raise LimitError(f"the graph has over {limits.max_nodes} nodes")
        tag, late = f"weft-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(limits.timeout_s, stop)
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            got = self.cypher(text, params).limit(limits.max_rows + 1).collect()
        except Exception as e:
            if late.is_set():
                raise LimitError(f"the query took over {limits.timeout_s} s") from e
            raise
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        if late.is_set():
            raise LimitError(f"the query took over {limits.timeout_s} s")
        if len(got) > limits.max_rows:
            raise LimitError(f"the query has over {limits.max_rows} rows")
        return got

    def batch(self, texts: list[str]) -> list[DataFrame]:
        """Queries one after the other; a later one sees what an earlier one wrote."""
        return [self.cypher(t) for t in texts]

    def explain(self, text: str) -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            compile_query(self.graph, text).explain("formatted")
        return out.getvalue()

    # graph API
    def create_node(self, label: str, props: dict[str, Any]) -> None:
        names = {f"p{i}": v for i, v in enumerate(props.values())}
        self.cypher(f"CREATE (n:`{label}` {{{', '.join(f'`{k}`: $p{i}' for i, k in enumerate(props))}}})", names)

    def add_edge(self, rel_type: str, src_label: str, src: Any, dst_label: str, dst: Any) -> None:
        self.cypher(f"MATCH (a:`{src_label}` {{id: $a}}), (b:`{dst_label}` {{id: $b}}) CREATE (a)-[:`{rel_type}`]->(b)", {"a": src, "b": dst})

    def create_nodes(self, label: str, records: list[dict[str, Any]], schema: str | None = None) -> int:
        """Many nodes at once; of records with one id the last counts, and it replaces a known node's
        properties that it names."""
        rows = self.spark.createDataFrame(records, schema) if schema else self.spark.createDataFrame(records)
        return self.merge_nodes(label, rows.withColumn("_at", F.monotonically_increasing_id()), "_at")

    def merge_nodes(self, label: str, rows: DataFrame, order: str | None = None) -> int:
        """Upserts nodes: rows with `id` and properties; of rows with one id that with the largest `order` counts.
        A null property leaves the old value. Returns the number of ids."""
        names = [c for c in rows.columns if c not in ("id", order)]
        new = rows.where("id is not null").groupBy("id").agg(*[F.max_by(c, order).alias(c) if order else F.last(c).alias(c) for c in names]) if names else rows.select("id").where("id is not null").distinct()
        new = cut(new)
        table = self.graph.vertices.get(label)
        if table is None:
            self.graph = self.graph.with_vertices(label, new)
            return new.count()
        old = table.df
        kinds = dict(old.dtypes)
        fresh = new.select(F.col("id").cast(kinds["id"]).alias("__id"), *[F.col(c).alias(f"__new_{c}") for c in names])
        both = old.join(fresh, old["id"] == fresh["__id"], "full_outer")
        value = lambda c: F.coalesce(F.col(f"__new_{c}").cast(kinds[c]), F.col(c)) if c in kinds and c in names else F.col(f"__new_{c}") if c in names else F.col(c)
        cols = [F.coalesce("id", "__id").alias("id"), *[value(c).alias(c) for c in dict.fromkeys([*[x for x in old.columns if x != "id"], *names])]]
        self.graph = self.graph.with_vertices(label, cut(both.select(*cols)), table.extra)
        return new.count()

    def merge_edges(self, rel_type: str, src_label: str, dst_label: str, rows: DataFrame) -> int:
        """Adds relationships (src, dst, properties) that aren't there yet."""
        old = next((e for e in self.graph.edges if (e.rel_type, e.src_label, e.dst_label) == (rel_type, src_label, dst_label)), None)
        rows = rows.dropDuplicates(["src", "dst"])
        if old is not None:
            kinds = dict(old.df.dtypes)
            rows = rows.withColumns({c: F.col(c).cast(kinds[c]) for c in ("src", "dst")}).join(old.df.select("src", "dst"), ["src", "dst"], "left_anti")
        rows = cut(rows)
        self.graph = self.graph.with_edges(rel_type, src_label, dst_label, old.df.unionByName(rows, allowMissingColumns=True) if old is not None else rows, old.key if old is not None else ())
        return rows.count()

    def create_standing_query(self, spec: dict[str, Any]) -> standing.StandingQuery:
        """From its JSON form (see streaming.standing.query_of)."""
        q = standing.query_of(spec)
        self.standing.register(q)
        return q

    def list_standing_queries(self) -> list[tuple[str, str, int]]:
        return self.standing.listed()

    def remove_standing_query(self, sq_id: str) -> None:
        self.standing.remove(sq_id)

    def standing_matches(self, sq_id: str, label: str) -> DataFrame:
        """Ids of a label's nodes that match now; hops go along relationships from and to that label."""
        edges = None
        for e in self.graph.edges:
            if e.src_label == e.dst_label == label:
                part = e.df.select("src", "dst", F.lit(e.rel_type).alias("rel_type"))
                edges = part if edges is None else edges.unionByName(part)
        return standing.matching(self.graph.vertices[label].df, self.standing.held[sq_id], edges)

    def run_recipe(self, text: str | dict[str, Any], checkpoint: str, **options: Any) -> list:
        from .sources.packages import Recipe

        return Recipe.of(text).start(self.spark, checkpoint, **options)

    def build_vector_index(self, name: str, vectors: DataFrame, **options: Any) -> vector_index.VectorIndex:
        self.indexes[name] = vector_index.VectorIndex.build(vectors, **options)
        return self.indexes[name]

    def vector_insert(self, name: str, vectors: DataFrame) -> None:
        self.indexes[name] = self.indexes[name].insert(vectors)

    def vector_remove(self, name: str, ids: DataFrame) -> None:
        self.indexes[name] = self.indexes[name].remove(ids)

    def vector_search(self, name: str, queries: DataFrame, k: int, **options: Any) -> DataFrame:
        return self.indexes[name].search(queries, k, **options)

    def register_event_table(self, name: str, df: DataFrame) -> None:
        """An event table that SQL may name and join with anything else."""
        self.event_tables[name] = df

    # SQL
    def sql(self, text: str) -> DataFrame:
        """SELECT over the graph's views (labels, nodes, edge_T, Src_T_Dst, _edges, materialized views), or
        INSERT, UPDATE, DELETE and the view DDL."""
        head = text.strip().rstrip(";").strip()
        word = head.split(None, 1)[0].upper()
        if m := re.match(r"(?is)create\s+materialized\s+view\s+(\w+)\s+(?:with\s+(incremental|manual)\s+)?as\s+(.*)$", head):
            self.create_view(m[1], m[3], (m[2] or "manual").lower())
        elif m := re.match(r"(?is)drop\s+materialized\s+view\s+(\w+)$", head):
            self.drop_view(m[1])
        elif word == "INSERT":
            self._insert(head)
        elif word == "UPDATE":
            self._update(head)
        elif word == "DELETE":
            self._delete(head)
        else:
            self.graph.register_views()
            for name, df in self.event_tables.items():
                df.createOrReplaceTempView(name)
            self._current()
            for v in self.views.values():
                v.rows.createOrReplaceTempView(v.name)
            return self.spark.sql(head)
        return self.spark.createDataFrame([("ok",)], "status string")

    def _edge_table(self, name: str):
        for e in self.graph.edges:
            if name in (f"edge_{e.rel_type}", f"{e.src_label}_{e.rel_type}_{e.dst_label}"):
                return e
        return None

    def _insert(self, text: str) -> None:
        m = re.match(r"(?is)insert\s+into\s+(\w+)\s*\(([^)]*)\)\s*values\s*(.*?)(?:\s+on\s+duplicate\s+key\s+update\s+(.*))?$", text)
        if not m:
            raise S.CypherError("INSERT INTO t (columns) VALUES (...) [ON DUPLICATE KEY UPDATE ...]")
        cols = [c.strip() for c in m[2].split(",")]
        rows = self.spark.sql(f"SELECT * FROM VALUES {m[3]} AS t({', '.join(f'`{c}`' for c in cols)})")
        edge = self._edge_table(m[1])
        if edge is not None:
            rows = rows.withColumnsRenamed({"from_id": "src", "to_id": "dst"})
            self.graph = self.graph.with_edges(edge.rel_type, edge.src_label, edge.dst_label, edge.df.unionByName(rows, allowMissingColumns=True), edge.key)
            return
        key = next((c for c in cols if c == "id" or c.endswith("_id")), cols[0])
        rows = rows.withColumnRenamed(key, "id")
        table = self.graph.vertices.get(m[1])
        if table is None:
            self.graph = self.graph.with_vertices(m[1], rows)
            return
        if m[4]:  # existing rows take the assignments, where VALUES(c) is the new row's c; others are added
            sets = dict(x.split("=", 1) for x in re.split(r",(?![^(]*\))", m[4]))
            new = rows.select("id", *[F.col(c).alias(f"__new_{c}") for c in rows.columns if c != "id"]).withColumn("__hit", F.lit(True))
            joined = table.df.join(new, "id", "left")
            for k, e in sets.items():
                e = re.sub(r"(?i)values\s*\(\s*(\w+)\s*\)", r"__new_\1", e.strip())
                joined = joined.withColumn(k.strip(), F.when(F.col("__hit"), F.expr(e)).otherwise(F.col(k.strip())))
            base = joined.select(*table.df.columns)
            rows = rows.join(table.df.select("id"), "id", "left_anti")
        else:
            base = table.df
        self.graph = self.graph.with_vertices(m[1], base.unionByName(rows, allowMissingColumns=True), table.extra)

    def _changed(self, name: str, change) -> None:
        edge = self._edge_table(name)
        if edge is not None:
            df = change(edge.df.withColumnsRenamed({"src": "from_id", "dst": "to_id"})).withColumnsRenamed({"from_id": "src", "to_id": "dst"})
            self.graph = self.graph.with_edges(edge.rel_type, edge.src_label, edge.dst_label, df, edge.key)
        else:
            table = self.graph.vertices[name]
            self.graph = self.graph.with_vertices(name, change(table.df), table.extra)

    def _update(self, text: str) -> None:
        m = re.match(r"(?is)update\s+(\w+)\s+set\s+(.*?)(?:\s+where\s+(.*))?$", text)
        sets = {k.strip(): v.strip() for k, v in (x.split("=", 1) for x in re.split(r",(?![^(]*\))", m[2]))}
        if set(sets) & {"from_id", "to_id"}:
            raise S.CypherError("the ends of a relationship can't be changed")
        hit = F.coalesce(F.expr(m[3]), F.lit(False)) if m[3] else F.lit(True)
        self._changed(m[1], lambda df: df.withColumn("__hit", hit).withColumns({k: F.when(F.col("__hit"), F.expr(v)).otherwise(F.col(k) if k in df.columns else F.lit(None)) for k, v in sets.items()}).drop("__hit"))

    def _delete(self, text: str) -> None:
        m = re.match(r"(?is)delete\s+from\s+(\w+)\s+where\s+(.*)$", text)
        if not m:
            raise S.CypherError("DELETE needs a WHERE")
        keep = ~F.coalesce(F.expr(m[2]), F.lit(False))
        if self._edge_table(m[1]) is None:  # a node takes its relationships along
            gone = self.graph.vertices[m[1]].df.where(~keep).select("id")
            for e in self.graph.edges:
                df = e.df
                if e.src_label == m[1]:
                    df = df.join(gone, df["src"] == gone["id"], "left_anti")
                if e.dst_label == m[1]:
                    df = df.join(gone, df["dst"] == gone["id"], "left_anti")
                self.graph = self.graph.with_edges(e.rel_type, e.src_label, e.dst_label, df, e.key)
        self._changed(m[1], lambda df: df.where(keep))

    # materialized views
    def create_view(self, name: str, source: str, mode: str = "manual") -> views.GraphView:
        """A view that holds its rows from now on. mode: manual (stays until refresh_view) or incremental
        (`sql` and `cypher` bring it up to date when the graph has changed)."""
        if name in self.views:
            raise ValueError(f"view {name} exists")
        if mode not in ("manual", "incremental"):
            raise ValueError(f"mode {mode!r}: manual or incremental")
        self.views[name] = views.GraphView(name, source, mode, cut(self._source(source)))
        self._seen[name] = self.graph
        return self.views[name]

    def _current(self) -> None:
        for name, v in self.views.items():
            if v.mode == "incremental" and self._seen[name] is not self.graph:
                self.refresh_view(name)

    def _source(self, source: str) -> DataFrame:
        if source.lstrip()[:6].upper() == "SELECT":
            self.graph.register_views()
            return self.spark.sql(source)
        return compile_query(self.graph, source)

    def refresh_view(self, name: str) -> views.GraphView:
        v = self.views[name]
        self.views[name] = v.refreshed(self._source(v.source))
        self._seen[name] = self.graph
        return self.views[name]

    def drop_view(self, name: str) -> None:
        del self.views[name], self._seen[name]

    def matching_view(self, text: str) -> DataFrame | None:
        """The rows of a view whose source parses to the same query, if no write has come since they were taken."""
        mine = [v for name, v in self.views.items() if self._seen[name] is self.graph and v.source.lstrip()[:6].upper() != "SELECT" and not v.source.startswith("standing:")]
        if not mine:
            return None
        tree = S.parse(text)
        return next((v.rows for v in mine if S.parse(v.source) == tree), None)

    def link_view(self, name: str, q: standing.StandingQuery, nodes: DataFrame, edges: DataFrame | None = None) -> views.GraphView:
        """A view that follows a standing query: it begins with the nodes that match now, and `follow` applies
        what the query reports later."""
        rows = nodes.join(standing.matching(nodes, q, edges), "id", "left_semi")
        self.views[name] = views.GraphView(name, f"standing:{q.sq_id}", "manual", cut(rows), key=("id",))
        self._seen[name] = self.graph
        return self.views[name]

    def follow(self, name: str, changes: DataFrame) -> views.GraphView:
        """changes: the view's columns, `transition` (matched: the row is put in or replaced; unmatched: it is
        taken out) and `seq`; of one id's changes the last counts."""
        op = F.when(F.col("transition") == "matched", "update").otherwise("delete")
        self.views[name] = self.views[name].applied(changes.withColumn("op", op).drop("transition"))
        return self.views[name]

    def list_tables(self) -> list[str]:
        return sorted([*self.graph.register_views(), *self.views, *self.event_tables])

    def list_columns(self) -> DataFrame:
        """table_name, column_name, ordinal, data_type of every table and view, from their schemas alone."""
        rows = []
        for name in self.list_tables():
            df = self.views[name].rows if name in self.views else self.event_tables.get(name)
            schema = df.schema if df is not None else self.spark.table(name).schema
            rows += [(name, f.name, i + 1, f.dataType.simpleString()) for i, f in enumerate(schema)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string")
