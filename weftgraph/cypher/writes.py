"""Write queries as set-based changes: a graph goes in, a changed graph and counters come out.

Every clause applies to all rows that the read part before it found. Rows to write are checkpointed
before they are used twice, so generated ids stay the same when a task runs again.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import EdgeTable, Graph
from ..plans.lineage import cut
from . import syntax as S
from .compiler import Bound, Compiler, Scope
from .syntax import CypherError

COUNTERS = ("nodes_created", "nodes_deleted", "relationships_created", "relationships_deleted", "properties_set", "properties_removed", "labels_added", "labels_removed")


def generated_id(kind: str, table: DataFrame | None, rows: DataFrame) -> Column:
    """A new id of a table's id type for each of `rows` (checkpointed): random where there is room for it,
    the next numbers in an int, dealt by partition without bringing the rows together."""
    if kind in ("int", "smallint", "tinyint"):
        last = table.agg(F.max("id")).first()[0] or 0
        sizes = rows.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()  # a row per partition
        starts, at = [], last + 1
        for r in sizes:
            starts += [F.lit(r.p), F.lit(at)]
            at += r["count"]
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        return (F.element_at(F.create_map(*starts), F.spark_partition_id()) + within).cast(kind) if starts else F.lit(None).cast(kind)
    return F.uuid() if kind == "string" else F.shiftrightunsigned(F.xxhash64(F.uuid()), 1).cast(kind)


class Writer:
    def __init__(self, graph: Graph, params: dict[str, Any] | None = None):
        self.graph, self.params = graph, params or {}
        self.stats = dict.fromkeys(COUNTERS, 0)

    def run(self, text: str) -> tuple[Graph, dict[str, int], DataFrame | None]:
        q = S.parse(text)
        if len(q.branches) != 1:
            raise CypherError("UNION of writes")
        scope, result = Scope(None), None
        for c in q.branches[0]:
            if isinstance(c, (S.Match, S.Unwind, S.CallQuery, S.LoadCsv, S.Project)):
                comp = self.compiler(q)
                scope = comp.run([c], scope)
                if isinstance(c, S.Project) and c.final:
                    result = scope.df
                elif scope.df is not None:
                    scope = Scope(cut(scope.df), scope.vars)
            elif isinstance(c, S.Create):
                for p in c.parts:
                    scope = self.create(p, scope)
            elif isinstance(c, S.Merge):
                scope = self.merge(c, scope)
            elif isinstance(c, S.SetItems):
                scope = self.assign(c.items, scope)
            elif isinstance(c, S.RemoveItems):
                scope = self.remove(c.items, scope)
            elif isinstance(c, S.Delete):
                self.delete(c, scope)
        return self.graph, self.stats, result

    def compiler(self, q: S.Query | None = None) -> Compiler:
        comp = Compiler(self.graph, self.params)
        comp.used["*"] = {"*"}
        comp.whole_edges = True
        return comp

    def _scope_df(self, scope: Scope) -> DataFrame:
        return scope.df if scope.df is not None else self.graph.spark.range(1).select(F.lit(1).alias("__one"))

    def create(self, p: S.Path, scope: Scope) -> Scope:
        comp = self.compiler()
        names = [comp._name(n.var) if n.var else f"new{id(n)}" for n in p.nodes]
        for n, v in zip(p.nodes, names, strict=True):
            if v not in scope.vars:
                scope = self.new_node(n, v, scope)
        for e, i in zip(p.edges, range(len(p.edges)), strict=True):
            a, b = (names[i], names[i + 1]) if e.direction == "out" else (names[i + 1], names[i])
            if e.direction == "both" or len(e.types) != 1:
                raise CypherError("CREATE takes directed relationships of one type")
            self.new_edges(e, a, b, scope)
        return scope

    def new_node(self, n: S.NodeP, v: str, scope: Scope) -> Scope:
        label = n.labels[0] if n.labels else "Node"
        table = self.graph.vertices.get(label)
        kind = table.df.schema["id"].dataType.simpleString() if table else "string"
        comp, df = self.compiler(), self._scope_df(scope)
        df = cut(df)
        props = {k: comp.expr(e, Scope(df, scope.vars)) for k, e in n.props}
        given = props.pop("__qid", None)
        given = props.pop("id", None) if given is None else given
        ident = given.cast(kind) if given is not None else generated_id(kind, table.df if table else None, df)
        df = cut(df.select("*", ident.alias(f"__{v}__id"), F.lit(label).alias(f"__{v}__lab"), *[x.alias(f"__{v}__p_{k}") for k, x in props.items()]))
        rows = df.select(F.col(f"__{v}__id").alias("id"), *[F.col(f"__{v}__p_{k}").alias(k) for k in props], *([F.array(*map(F.lit, n.labels[1:])).alias("_labels")] if len(n.labels) > 1 else []))
        extra = table.extra if table else None
        if len(n.labels) > 1:
            extra = extra or "_labels"
        base = table.df.unionByName(rows, allowMissingColumns=True) if table else rows
        self.graph = self.graph.with_vertices(label, base, extra)
        count = rows.count()
        self.stats["nodes_created"] += count
        self.stats["labels_added"] += count * max(1, len(n.labels))
        self.stats["properties_set"] += count * len(props)
        return Scope(df, {**scope.vars, v: Bound("node", (label,), tuple(props))})

    def new_edges(self, e: S.EdgeP, a: str, b: str, scope: Scope) -> None:
        comp = self.compiler()
        for src in scope.vars[a].labels:
            for dst in scope.vars[b].labels:
                rows = scope.df.where((F.col(f"__{a}__lab") == src) & (F.col(f"__{b}__lab") == dst)).select(F.col(f"__{a}__id").alias("src"), F.col(f"__{b}__id").alias("dst"), *[comp.expr(x, scope).alias(k) for k, x in e.props]).dropDuplicates(["src", "dst"])
                old = next((t for t in self.graph.edges if (t.rel_type, t.src_label, t.dst_label) == (e.types[0], src, dst)), None)
                if old:
                    rows = rows.join(old.df.select("src", "dst"), ["src", "dst"], "left_anti")
                rows = cut(rows)
                n = rows.count()
                if n or old is None:
                    self.graph = self.graph.with_edges(e.types[0], src, dst, old.df.unionByName(rows, allowMissingColumns=True) if old else rows, old.key if old else ())
                self.stats["relationships_created"] += n
                self.stats["properties_set"] += n * len(e.props)

    def merge(self, c: S.Merge, scope: Scope) -> Scope:
        if c.part.edges:
            raise CypherError("MERGE takes a node pattern")
        n = c.part.nodes[0]
        v = n.var or "merged"
        label = n.labels[0] if n.labels else "Node"
        exists = label in self.graph.vertices and all(k in ("id", "__qid") or k in self.graph.vertices[label].properties for k, _ in n.props)
        df = self._scope_df(scope)
        comp, hit = self.compiler(), None
        if exists:
            found = comp.run([S.Match([S.Path(None, (S.NodeP(v, n.labels, n.props),), ())])], Scope(df, dict(scope.vars)))
            hit = cut(found.df)
            missing = df.join(hit.select(*df.columns).distinct(), [df[k].eqNullSafe(hit[k]) for k in df.columns], "left_anti")
            if not hit.isEmpty():
                self.assign(c.on_match, Scope(hit, found.vars))
        wanted = cut((missing if exists else df).dropDuplicates())
        if exists and wanted.isEmpty():
            return Scope(hit, found.vars)
        own = comp.expr(S.MapOf(n.props), Scope(wanted, scope.vars)) if n.props else F.lit(1)
        once = cut(wanted.withColumn("__own", F.xxhash64(own.cast("string"))).dropDuplicates(["__own"]).drop("__own"))
        out = self.new_node(n, v, Scope(once, scope.vars))
        self.assign(c.on_create, out)
        again = self.compiler().run([S.Match([S.Path(None, (S.NodeP(v, n.labels, n.props),), ())])], Scope(df, dict(scope.vars)))
        return Scope(cut(again.df), again.vars)

    def _met(self, t: EdgeTable, v: str, scope: Scope) -> DataFrame:
        """The rows that stand for relationships of `t`, its columns named __old_*. A relationship is told by
        its ends and all its properties: parallel ones that differ in any are others."""
        own = scope.df.where((F.col(f"__{v}__type") == t.rel_type) & (F.col(f"__{v}__srclab") == t.src_label) & (F.col(f"__{v}__dstlab") == t.dst_label))
        kinds = dict(t.df.dtypes)
        old = [F.col(f"__{v}__{c}" if c in ("src", "dst") else f"__{v}__p_{c}").cast(kinds[c]).alias(f"__old_{c}") for c in t.df.columns]
        return own.select("*", *old)

    def _tables_of(self, v: str, scope: Scope) -> list[EdgeTable]:
        return [t for t in self.graph.edges if t.rel_type in scope.vars[v].labels]

    def _update_edges(self, v: str, values: dict[str, Column], scope: Scope, only: EdgeTable | None = None) -> int:
        changed = 0
        for t in self._tables_of(v, scope) if only is None else [only]:
            names = [f"__old_{c}" for c in t.df.columns]
            new = cut(self._met(t, v, scope).select(*names, *[x.alias(f"__new_{k}") for k, x in values.items()]).dropDuplicates(names).withColumn("__hit", F.lit(True)))
            n = new.count()
            changed += n
            if not n:
                continue
            on = [t.df[c].eqNullSafe(new[f"__old_{c}"]) for c in t.df.columns]
            df = t.df.join(new, on, "left").drop(*names)
            for k in values:
                df = df.withColumn(k, F.when(F.col("__hit"), F.col(f"__new_{k}")).otherwise(F.col(k)) if k in t.df.columns else F.col(f"__new_{k}"))
            self._replace_edges(t, df.drop("__hit", *[f"__new_{k}" for k in values]))
        return changed

    def _replace_edges(self, t: EdgeTable, df: DataFrame) -> None:
        same = (t.rel_type, t.src_label, t.dst_label)
        self.graph = replace(self.graph, edges=tuple(replace(x, df=df, node_side=None, whole=None) if (x.rel_type, x.src_label, x.dst_label) == same else x for x in self.graph.edges))

    @staticmethod
    def _seen(v: str, values: dict[str, Column], scope: Scope) -> Scope:
        """The scope after a change of v's properties: later clauses read the new values."""
        b = scope.vars[v]
        df = scope.df.withColumns({f"__{v}__p_{k}": x for k, x in values.items()})
        return Scope(df, {**scope.vars, v: replace(b, props=tuple(dict.fromkeys([*b.props, *values])))})

    def _update(self, v: str, values: dict[str, Column], scope: Scope) -> int:
        """Writes value columns to all nodes or relationships that `v` stands for; one that is met several
        times takes one of its rows."""
        if scope.vars[v].kind == "edge":
            return self._update_edges(v, values, scope)
        changed = 0
        for label in scope.vars[v].labels:
            table = self.graph.vertices[label]
            new = scope.df.where((F.col(f"__{v}__lab") == label) & F.col(f"__{v}__id").isNotNull()).select(F.col(f"__{v}__id").alias("id"), *[x.alias(f"__new_{k}") for k, x in values.items()]).dropDuplicates(["id"])
            new = cut(new)
            n = new.count()
            changed += n
            if not n:
                continue
            df = table.df.join(new.withColumn("__hit", F.lit(True)), "id", "left")
            for k in values:
                df = df.withColumn(k, F.when(F.col("__hit"), F.col(f"__new_{k}")).otherwise(F.col(k)) if k in table.df.columns else F.col(f"__new_{k}"))
            self.graph = self.graph.with_vertices(label, df.drop("__hit", *[f"__new_{k}" for k in values]), table.extra)
        return changed

    def assign(self, items: list, scope: Scope) -> Scope:
        by_var: dict[str, dict[str, Column]] = {}
        comp = self.compiler()
        for i in items:
            if i[0] == "label":
                self.labels(i[1], i[2], scope, add=True)
            elif i[0] == "prop":
                by_var.setdefault(i[1], {})[i[2]] = comp.expr(i[3], scope)
            else:
                if not isinstance(i[2], S.MapOf):
                    raise CypherError("SET n += takes a map")
                for k, e in i[2].items:
                    by_var.setdefault(i[1], {})[k] = comp.expr(e, scope)
        for v, values in by_var.items():  # all from the values before
            self.stats["properties_set"] += self._update(v, values, scope) * len(values)
        for v, values in by_var.items():
            scope = self._seen(v, values, scope)
        return Scope(cut(scope.df), scope.vars) if by_var else scope

    def remove(self, items: list, scope: Scope) -> Scope:
        for i in items:
            if i[0] == "label":
                self.labels(i[1], i[2], scope, add=False)
                continue
            if scope.vars[i[1]].kind == "edge":
                for t in self._tables_of(i[1], scope):
                    if i[2] in t.properties:
                        self.stats["properties_removed"] += self._update_edges(i[1], {i[2]: F.lit(None).cast(t.df.schema[i[2]].dataType)}, scope, t)
            for label in scope.vars[i[1]].labels if scope.vars[i[1]].kind == "node" else ():
                fields = {f.name: f.dataType for f in self.graph.vertices[label].df.schema}
                if i[2] in fields:
                    own = Scope(scope.df.where(F.col(f"__{i[1]}__lab") == label), {i[1]: Bound("node", (label,))})
                    self.stats["properties_removed"] += self._update(i[1], {i[2]: F.lit(None).cast(fields[i[2]])}, own)
            if i[2] in scope.vars[i[1]].props:
                scope = self._seen(i[1], {i[2]: F.lit(None).cast(scope.df.schema[f"__{i[1]}__p_{i[2]}"].dataType)}, scope)
        return scope

    def labels(self, v: str, name: str, scope: Scope, add: bool) -> None:
        for label in scope.vars[v].labels:
            table = self.graph.vertices[label]
            extra = table.extra or "_labels"
            if table.extra is None:
                self.graph = self.graph.with_vertices(label, table.df.withColumn(extra, F.array().cast("array<string>")), extra)
            df = self.graph.vertices[label].df
            ids = cut(scope.df.where(F.col(f"__{v}__lab") == label).select(F.col(f"__{v}__id").alias("id")).distinct())
            n = ids.count()
            old = F.coalesce(F.col(extra), F.array().cast("array<string>"))
            new = F.array_union(old, F.array(F.lit(name))) if add else F.array_remove(old, name)
            df = df.join(ids.withColumn("__hit", F.lit(True)), "id", "left").withColumn(extra, F.when(F.col("__hit"), new).otherwise(F.col(extra))).drop("__hit")
            self.graph = self.graph.with_vertices(label, df, extra)
            self.stats["labels_added" if add else "labels_removed"] += n

    def delete(self, c: S.Delete, scope: Scope) -> None:
        for v in c.names:
            if scope.vars[v].kind == "edge":
                for t in self._tables_of(v, scope):
                    gone = self._met(t, v, scope).select(*[f"__old_{c}" for c in t.df.columns]).distinct()
                    self._drop_edges(t, t.df.join(gone, [t.df[c].eqNullSafe(gone[f"__old_{c}"]) for c in t.df.columns], "left_anti"))
                continue
            for label in scope.vars[v].labels:
                ids = cut(scope.df.where(F.col(f"__{v}__lab") == label).select(F.col(f"__{v}__id").alias("id")).distinct())
                for t in self.graph.edges:
                    for end, side in (("src", t.src_label), ("dst", t.dst_label)):
                        if side != label:
                            continue
                        now = next(x for x in self.graph.edges if (x.rel_type, x.src_label, x.dst_label) == (t.rel_type, t.src_label, t.dst_label))
                        touched = now.df.join(ids, now.df[end] == ids["id"], "left_semi")
                        if not c.detach and not touched.isEmpty():
                            raise CypherError(f"{v} has relationships: use DETACH DELETE")
                        self._drop_edges(now, now.df.join(ids, now.df[end] == ids["id"], "left_anti"))
                table = self.graph.vertices[label]
                kept = table.df.join(ids, "id", "left_anti")
                self.stats["nodes_deleted"] += table.df.join(ids, "id", "left_semi").count()
                self.graph = self.graph.with_vertices(label, kept, table.extra)

    def _drop_edges(self, t: EdgeTable, kept: DataFrame) -> None:
        kept = cut(kept)
        self.stats["relationships_deleted"] += t.df.count() - kept.count()
        self._replace_edges(t, kept)


def execute_write(graph: Graph, text: str, params: dict[str, Any] | None = None) -> tuple[Graph, dict[str, int], DataFrame | None]:
    """The changed graph, the counters and, if the text ends with RETURN, its rows."""
    return Writer(graph, params).run(text)
