"""Read queries as DataFrame plans.

Each variable of a query owns columns of one wide DataFrame: `__v__id`, `__v__lab` and `__v__p_<prop>`
for a node, `__v__src`, `__v__dst`, `__v__type`, `__v__k` and `__v__p_<prop>` for a relationship, `__v`
for a value. A hop is one equi-join with the relationship table; a node's own table is joined only if
the query reads a property of it, since the relationship carries the other end's id. Properties
that the query doesn't name are never selected.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import AnyOf, EdgeTable, Graph
from ..functions import scalar
from ..plans.paths import var_length
from . import syntax as S
from .syntax import CypherError

MAX_PATTERN_DEPTH = 10
_COMPARE = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


@dataclass
class Bound:
    """What a variable stands for."""

    kind: str  # node, edge, value
    labels: tuple[str, ...] = ()  # node: labels it may have; edge: types
    props: tuple[str, ...] = ()  # property columns at hand


@dataclass
class Scope:
    df: DataFrame | None
    vars: dict[str, Bound] = field(default_factory=dict)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def conjuncts(e: Any) -> list:
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, S.Bin) and e.op == "and" else [e]


class Compiler:
    def __init__(self, graph: Graph, params: dict[str, Any] | None = None):
        self.graph, self.params, self.fresh, self.lambdas = graph, params or {}, 0, 0
        self.used: dict[str, set[str]] = {}
        self.whole_edges = False  # writes need the ends' labels of a relationship as well

    # --- which properties are read ---------------------------------------------------------------

    def _note(self, e: Any) -> None:
        if isinstance(e, S.Prop) and isinstance(e.of, S.Var):
            self.used.setdefault(e.of.name, set()).add(e.name)
        elif isinstance(e, S.Var):
            self.used.setdefault(e.name, set()).add("*")
        elif isinstance(e, S.Call) and e.name in ("id", "type", "labels", "count") and len(e.args) == 1 and isinstance(e.args[0], S.Var):
            if e.name == "labels":
                self.used.setdefault(e.args[0].name, set()).add("*labels")
        else:
            for c in S.children(e):
                self._note(c)

    def _note_clauses(self, clauses: list) -> None:
        for c in clauses:
            if isinstance(c, S.Match):
                self._note(c.where) if c.where is not None else None
                for p in c.parts:
                    for x in (*p.nodes, *p.edges):
                        for _, v in x.props:
                            self._note(v)
            elif isinstance(c, S.Project):
                for i in c.items:
                    if isinstance(i.expr, S.Var) and not c.final:  # handed on under a name: follow that name
                        self.used.setdefault(i.expr.name, set()).update({"*"} if i.alias != i.expr.name else set())
                    else:
                        self._note(i.expr)
                if c.star and c.final:
                    self.used["*"] = {"*"}
                for e in (c.where, c.skip, c.limit, *[x for x, _ in c.order]):
                    if e is not None:
                        self._note(e)
            elif isinstance(c, S.Unwind):
                self._note(c.expr)
            elif isinstance(c, S.CallQuery):
                for b in c.query.branches:
                    self._note_clauses(b)
            elif isinstance(c, S.SetItems):
                for i in c.items:
                    if i[0] != "label":
                        self._note(i[-1])

    def _wanted(self, var: str, available: list[str], inline: tuple) -> list[str]:
        used = self.used.get(var, set()) | self.used.get("*", set()) | {k for k, _ in inline}
        return list(available) if "*" in used else [p for p in available if p in used]

    def _name(self, var: str | None) -> str:
        if var:
            return var
        self.fresh += 1
        return f"anon{self.fresh}"

    # --- queries ---------------------------------------------------------------------------------

    def query(self, q: S.Query) -> DataFrame:
        out = self.branch(q.branches[0])
        for clauses, every in zip(q.branches[1:], q.alls, strict=True):
            other = self.branch(clauses)
            if len(other.columns) != len(out.columns):
                raise CypherError("the branches of UNION return different numbers of columns")
            out = out.union(other)
            if not every:
                out = out.distinct()
        return out

    def branch(self, clauses: list) -> DataFrame:
        if not isinstance(clauses[-1], S.Project) or not clauses[-1].final:
            raise CypherError("a read query ends with RETURN")
        return self.run(clauses, Scope(None)).df

    def run(self, clauses: list, scope: Scope) -> Scope:
        self._note_clauses(clauses)
        for c in clauses:
            if isinstance(c, S.Match):
                scope = self.optional(c, scope) if c.optional else self.where(self.match(c.parts, scope), c.where)
            elif isinstance(c, S.Project):
                scope = self.project(c, scope)
            elif isinstance(c, S.Unwind):
                df = self._rows(scope)
                scope = Scope(df.withColumn(f"__{c.var}", F.explode(self.expr(c.expr, Scope(df, scope.vars)))), {**scope.vars, c.var: Bound("value")})
            elif isinstance(c, S.CallQuery):
                scope = self.subquery(c.query, scope)
            elif isinstance(c, S.LoadCsv):
                df = self.graph.spark.read.option("header", c.headers).csv(c.path)
                row = F.create_map(*[x for n in df.columns for x in (F.lit(n), F.col(f"`{n}`"))]) if c.headers else F.array(*[F.col(f"`{n}`") for n in df.columns])
                df = df.select(row.alias(f"__{c.var}"))
                scope = Scope(df if scope.df is None else scope.df.crossJoin(df), {**scope.vars, c.var: Bound("value")})
            else:
                raise CypherError(f"{type(c).__name__} isn't a read clause")
        return scope

    def _rows(self, scope: Scope) -> DataFrame:
        return scope.df if scope.df is not None else self.graph.spark.range(1).select(F.lit(1).alias("__one"))

    # --- patterns --------------------------------------------------------------------------------

    def scan(self, p: S.NodeP, var: str) -> tuple[DataFrame, Bound]:
        tables = self.graph.labelled(p.labels)
        if not tables:
            raise CypherError(f"no table for labels {':'.join(p.labels)}")
        kinds = {t.df.schema["id"].dataType.simpleString() for t, _ in tables}
        parts, props = [], []
        for t, rest in tables:
            want = self._wanted(var, t.properties, p.props)
            df = t.df
            if rest:
                df = df.where(F.arrays_overlap(t.extra, F.array(*map(F.lit, rest))) if isinstance(rest, AnyOf) else _all([F.array_contains(t.extra, x) for x in rest]))
            ident = F.col("id") if len(kinds) == 1 else F.col("id").cast("string")
            lab = [F.lit(t.label).alias(f"__{var}__lab")] + ([F.col(t.extra).alias(f"__{var}__extra")] if t.extra and self._labels(var) else [])
            parts.append(df.select(ident.alias(f"__{var}__id"), *lab, *[F.col(c).alias(f"__{var}__p_{c}") for c in want]))
            props += [c for c in want if c not in props]
        df = parts[0]
        for x in parts[1:]:
            df = df.unionByName(x, allowMissingColumns=True)
        return df, Bound("node", tuple(t.label for t, _ in tables), tuple(props))

    def _star(self, var: str) -> bool:
        return "*" in self.used.get(var, set()) | self.used.get("*", set())

    def _labels(self, var: str) -> bool:
        """Whether the further labels of `var` are read."""
        return self._star(var) or "*labels" in self.used.get(var, set())

    def inline(self, props: tuple, var: str, scope: Scope) -> Scope:
        if props:
            scope.df = scope.df.where(_all([self.expr(S.Prop(S.Var(var), k), scope) == self.expr(v, scope) for k, v in props]))
        return scope

    def match(self, parts: list, scope: Scope) -> Scope:
        hops: list[tuple[str, tuple[tuple[str, str, str], ...]]] = []
        for p in parts:
            if sum(1 if e.length is None else e.length[1] or 1 for e in p.edges) > MAX_PATTERN_DEPTH:
                raise CypherError(f"pattern is deeper than {MAX_PATTERN_DEPTH}")
        if self.closes(parts):
            scope = self.cyclic(parts, scope, hops)
        else:
            for p in parts:
                scope = self.path(p, scope, hops)
        # relationships of one MATCH are distinct: compare only pairs that may be the same one
        for i, (a, ta) in enumerate(hops):
            for b, tb in hops[:i]:
                if set(ta) & set(tb):
                    same = F.col(f"__{a}__k").eqNullSafe(F.col(f"__{b}__k"))
                    scope.df = scope.df.where(~same)
        return scope

    def path(self, p: S.Path, scope: Scope, hops: list) -> Scope:
        names = [self._name(n.var) for n in p.nodes]
        known = [i for i, n in enumerate(names) if n in scope.vars]
        at = known[0] if known else self.first(p)
        if not known:
            df, bound = self.scan(p.nodes[at], names[at])
            scope = Scope(df if scope.df is None else scope.df.crossJoin(df), {**scope.vars, names[at]: bound})
            scope = self.inline(p.nodes[at].props, names[at], scope)
        else:
            scope = self.constrain(p.nodes[at], names[at], scope)
        edge_names = [self._name(e.var) for e in p.edges]
        for i in range(at, len(p.edges)):
            scope = self.hop(scope, names[i], p.edges[i], edge_names[i], p.nodes[i + 1], names[i + 1], False, hops, len(p.edges) > 1 or bool(hops))
        for i in range(at - 1, -1, -1):
            scope = self.hop(scope, names[i + 1], p.edges[i], edge_names[i], p.nodes[i], names[i], True, hops, len(p.edges) > 1 or bool(hops))
        return self.named(p, names, edge_names, scope)

    def named(self, p: S.Path, names: list[str], edge_names: list[str], scope: Scope) -> Scope:
        """The scope with the path's variable, if it has one."""
        if p.var:
            nodes = F.array(*[F.struct(F.col(f"__{n}__lab").alias("label"), F.col(f"__{n}__id").cast("string").alias("id")) for n in names])
            rels = F.array(*[F.struct(F.col(f"__{e}__type").alias("type")) for e, x in zip(edge_names, p.edges, strict=True) if x.length is None]) if p.edges else F.array()
            scope = Scope(scope.df.withColumn(f"__{p.var}", F.struct(nodes.alias("nodes"), rels.alias("relationships"))), {**scope.vars, p.var: Bound("value")})
        return scope

    def closes(self, parts: list) -> bool:
        """Whether the pattern holds a cycle of single relationships, whose order may then be chosen: nothing in
        it reads the pattern's own variables."""
        root: dict[Any, Any] = {}

        def find(x: Any) -> Any:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        if any(e.length is not None for p in parts for e in p.edges):
            return False
        own = [x.var for p in parts for x in (*p.nodes, *p.edges) if x.var]
        if any(self._reads(v, own) for p in parts for x in (*p.nodes, *p.edges) for _, v in x.props):
            return False
        cycle = False
        for i, p in enumerate(parts):
            ends = [n.var or (i, j) for j, n in enumerate(p.nodes)]
            for a, b in zip(ends, ends[1:], strict=False):
                a, b = find(a), find(b)
                cycle = cycle or a == b
                root[a] = b
        return cycle

    def cyclic(self, parts: list, scope: Scope, hops: list) -> Scope:
        """Joins a pattern that holds a cycle, its relationships in the order in which rows grow least: those
        between bound nodes, then those of which a node has one at most, then those from a node that no two rows
        share (no more rows than relationships), then the others. A node is bound as its first mention says."""
        names = [[self._name(n.var) for n in p.nodes] for p in parts]
        edge_names = [[self._name(e.var) for e in p.edges] for p in parts]
        mentions: dict[str, list[S.NodeP]] = {}
        for p, own in zip(parts, names, strict=True):
            for n, v in zip(p.nodes, own, strict=True):
                mentions.setdefault(v, []).append(n)
        left = [(i, j) for i, p in enumerate(parts) for j in range(len(p.edges))]
        alone: set[str] = set()  # nodes that no two rows share

        def settle(v: str, scope: Scope, seen: int) -> Scope:
            for n in mentions[v][seen:]:
                scope = self.constrain(n, v, scope)
            return scope

        def sides(i: int, j: int, flip: bool, scope: Scope) -> tuple[str, str, str | None]:
            """(near, far, which of them holds the relationship in its own table)."""
            a, b, e = names[i][j + flip], names[i][j + 1 - flip], parts[i].edges[j]
            label = lambda v: scope.vars[v].labels if v in scope.vars else tuple(t.label for t, _ in self.graph.labelled(mentions[v][0].labels))
            src, dst = (a, b) if (e.direction == "out") != flip else (b, a)
            tables = self.edge_tables(e.types, label(src), label(dst)) if e.direction != "both" else []
            side = tables[0].node_side if len(tables) == 1 else None
            return a, b, {"src": src, "dst": dst}.get(side)

        def rank(i: int, j: int, flip: bool, scope: Scope) -> int:
            a, b, holder = sides(i, j, flip, scope)
            return 0 if b in scope.vars else 1 if holder == a else 2 if a in alone else 3

        for v in [v for v in mentions if v in scope.vars]:
            scope = settle(v, scope, 0)
        for i, p in enumerate(parts):
            if not any(v in scope.vars for v in names[i]):
                v = names[i][self.first(p)]
                df, bound = self.scan(mentions[v][0], v)
                alone = set() if scope.df is not None or len(bound.labels) > 1 else {v}
                scope = Scope(df if scope.df is None else scope.df.crossJoin(df), {**scope.vars, v: bound})
                scope = settle(v, self.inline(mentions[v][0].props, v, scope), 1)
            while True:
                ways = [(k, m, flip) for k, m in left for flip in (False, True) if names[k][m + flip] in scope.vars]
                if not ways:
                    break
                k, m, flip = min(ways, key=lambda w: (rank(*w, scope), w))
                (a, b, holder), new = sides(k, m, flip, scope), names[k][m + 1 - flip] not in scope.vars
                scope = self.hop(scope, a, parts[k].edges[m], edge_names[k][m], mentions[b][0] if new else S.NodeP(b), b, flip, hops, True)
                scope = settle(b, scope, 1) if new else scope
                alone = alone if holder == a or not new and holder else {b} if new and holder == b and a in alone else set()
                left.remove((k, m))
        for p, own, rels in zip(parts, names, edge_names, strict=True):
            scope = self.named(p, own, rels, scope)
        return scope

    def first(self, p: S.Path) -> int:
        """The node to begin with: the second if the first one's own table holds the relationship, which then
        reads that table once."""
        if not p.edges or p.edges[0].length is not None or p.edges[0].direction == "both":
            return 0
        e, (a, b) = p.edges[0], ([t.label for t, _ in self.graph.labelled(n.labels)] for n in p.nodes[:2])
        ways = [t for t in (self.edge_tables(e.types, a, b) if e.direction == "out" else self.edge_tables(e.types, b, a))]
        return int(len(ways) == 1 and ways[0].node_side == ("src" if e.direction == "out" else "dst"))

    def constrain(self, p: S.NodeP, var: str, scope: Scope) -> Scope:
        if scope.vars[var].kind != "node":
            raise CypherError(f"{var} isn't a node")
        if p.labels:
            scope = Scope(scope.df.where(F.col(f"__{var}__lab").isin(*p.labels)), scope.vars)
        return self.inline(p.props, var, scope)

    def edge_tables(self, types: tuple, src: tuple | None, dst: tuple | None) -> list[EdgeTable]:
        return [e for e in self.graph.edges if (not types or e.rel_type in types) and (src is None or e.src_label in src) and (dst is None or e.dst_label in dst)]

    def hop(self, scope: Scope, a: str, e: S.EdgeP, r: str, p: S.NodeP, b: str, flip: bool, hops: list, unique: bool) -> Scope:
        """Joins the relationship `e` from the bound node `a` to `b`."""
        direction = {"out": "in", "in": "out"}.get(e.direction, e.direction) if flip else e.direction
        near = scope.vars[a].labels
        far = scope.vars[b].labels if b in scope.vars else tuple(t.label for t, _ in self.graph.labelled(p.labels))
        ways = [(t, "src", "dst") for t in self.edge_tables(e.types, near, far) if direction in ("out", "both")]
        ways += [(t, "dst", "src") for t in self.edge_tables(e.types, far, near) if direction in ("in", "both")]
        if not ways:
            raise CypherError(f"no relationship {'|'.join(e.types) or '*'} joins {'|'.join(near)} and {'|'.join(far)}")
        ids = {k for t, x, y in ways for k in (t.df.schema[x].dataType.simpleString(), t.df.schema[y].dataType.simpleString())}
        text = len(ids) > 1 and len({t.df.schema[y].dataType.simpleString() for t, _, y in ways}) > 1 or dict(scope.df.dtypes).get(f"__{a}__id") == "string"
        ident = (lambda c: F.col(c).cast("string")) if text else F.col
        label = {"src": lambda t: t.src_label, "dst": lambda t: t.dst_label}
        if e.length is not None:
            return self.long_hop(scope, a, e, p, b, ways, ident, label)
        parts, props = [], []
        own = self.same_scan(ways, p, b, scope)
        for t, x, y in ways:
            want = self._wanted(r, t.properties, e.props)
            df = t.whole if own else t.df
            df = df.where(F.col("src") != F.col("dst")) if direction == "both" and x == "dst" and t.src_label == t.dst_label else df
            key = [F.struct(F.lit(t.rel_type).alias("t"), F.concat_ws(":", F.lit(t.src_label), F.lit(t.dst_label), *[F.col(c).cast("string") for c in ("src", "dst", *t.key)]).alias("k")).alias(f"__{r}__k")] if unique else []
            parts.append(df.select(ident(x).alias("__near"), F.lit(label[x](t)).alias("__nearlab"), ident(y).alias("__far"), F.lit(label[y](t)).alias("__farlab"), F.lit(t.rel_type).alias(f"__{r}__type"), ident("src").alias(f"__{r}__src"), ident("dst").alias(f"__{r}__dst"), *key, *([F.lit(t.src_label).alias(f"__{r}__srclab"), F.lit(t.dst_label).alias(f"__{r}__dstlab")] if self.whole_edges else []), *[F.col(c).alias(f"__{r}__p_{c}") for c in want], *[F.col(f"node_{c}").alias(f"__{b}__p_{c}") for c in own]))
            props += [c for c in want if c not in props]
        edges = parts[0]
        for x in parts[1:]:
            edges = edges.unionByName(x, allowMissingColumns=True)
        if unique:
            hops.append((r, tuple({(t.rel_type, t.src_label, t.dst_label) for t, _, _ in ways})))
        on = [F.col(f"__{a}__id") == F.col("__near")]
        if len(near) > 1 or len({label[x](t) for t, x, _ in ways}) > 1:
            on.append(F.col(f"__{a}__lab") == F.col("__nearlab"))
        return self.arrive(scope, edges, on, p, b, ways, label, {r: Bound("edge", tuple(dict.fromkeys(t.rel_type for t, _, _ in ways)), tuple(props))}, e.props, r, own)

    def same_scan(self, ways: list, p: S.NodeP, b: str, scope: Scope) -> list[str]:
        """Properties of the new node `b` that the relationship's own table holds, if it is the node's table."""
        if b in scope.vars or len(ways) != 1 or ways[0][0].node_side != ways[0][2]:
            return []
        t, _, y = ways[0]
        label = t.src_label if y == "src" else t.dst_label
        table = self.graph.vertices[label]
        if table.extra or table.unmet(p.labels):
            return []
        return self._wanted(b, table.properties, p.props)

    def arrive(self, scope: Scope, edges: DataFrame, on: list, p: S.NodeP, b: str, ways: list, label: dict, more: dict, edge_props: tuple, r: str | None, own: list[str] | tuple = ()) -> Scope:
        labels = tuple(dict.fromkeys(label[y](t) for t, _, y in ways))
        if b in scope.vars:
            on = [*on, F.col(f"__{b}__id") == F.col("__far")]
            if len(labels) > 1 or len(scope.vars[b].labels) > 1:
                on.append(F.col(f"__{b}__lab") == F.col("__farlab"))
            out = Scope(scope.df.join(edges, _all(on)).drop("__near", "__nearlab", "__far", "__farlab"), {**scope.vars, **more})
            out = self.constrain(p, b, out)
        else:
            df = scope.df.join(edges, _all(on)).drop("__near", "__nearlab").withColumnRenamed("__far", f"__{b}__id").withColumnRenamed("__farlab", f"__{b}__lab")
            bound = Bound("node", labels, tuple(own))
            tables = [t for t, _ in self.graph.labelled(p.labels) if t.label in labels]
            extra = any(t.unmet(p.labels) for t in tables)
            if not own and (extra or any(self._wanted(b, t.properties, p.props) for t in tables) or self._star(b) or self._labels(b) and any(t.extra for t in tables)):
                nodes, full = self.scan(S.NodeP(p.var, p.labels, p.props), b)
                nodes = nodes.withColumnRenamed(f"__{b}__id", "__id").withColumnRenamed(f"__{b}__lab", "__lab")
                match = F.col(f"__{b}__id") == F.col("__id").cast(dict(df.dtypes)[f"__{b}__id"])
                df = df.join(nodes, match & (F.col(f"__{b}__lab") == F.col("__lab")) if len(full.labels) > 1 or len(labels) > 1 else match).drop("__id", "__lab")
                bound = Bound("node", labels, full.props)
            out = self.inline(p.props, b, Scope(df, {**scope.vars, **more, b: bound}))
        return self.inline(edge_props, r, out) if r else out

    def long_hop(self, scope: Scope, a: str, e: S.EdgeP, p: S.NodeP, b: str, ways: list, ident, label: dict) -> Scope:
        if e.var or e.props:
            raise CypherError("a variable-length relationship has neither a name nor properties here")
        # the inner nodes may have any label, so the tables are those of the types, whatever they join
        inner = self.edge_tables(e.types, None, None)
        one = len({x for t in inner for x in (t.src_label, t.dst_label)} | set(scope.vars[a].labels)) == 1  # ids as they are
        node = lambda c, lab: ident(c) if one else F.struct(F.lit(lab).alias("l"), F.col(c).cast("string").alias("i"))
        parts = []
        for t in inner:
            if any(x == "src" for _, x, _ in ways):
                parts.append(t.df.select(node("src", t.src_label).alias("u"), node("dst", t.dst_label).alias("v")))
            if any(x == "dst" for _, x, _ in ways):
                parts.append(t.df.select(node("dst", t.dst_label).alias("u"), node("src", t.src_label).alias("v")))
        edges = reduce(DataFrame.union, parts)
        start = F.col(f"__{a}__id") if one else F.struct(F.col(f"__{a}__lab").alias("l"), F.col(f"__{a}__id").cast("string").alias("i"))
        starts = scope.df.select(start.alias("start")).distinct()
        reached = var_length(edges, starts, *e.length)
        kind = dict(scope.df.dtypes)[f"__{a}__id"]
        ends = tuple(dict.fromkeys([label[y](t) for t, _, y in ways] + ([*scope.vars[a].labels] if e.length[0] == 0 else [])))
        if one:
            lab = F.lit(scope.vars[a].labels[0])
            reached = reached.select(F.col("start").alias("__near"), lab.alias("__nearlab"), F.col("node").alias("__far"), lab.alias("__farlab"))
            return self.arrive(scope, reached, [F.col(f"__{a}__id") == F.col("__near")], p, b, ways, label, {}, (), None)
        reached = reached.where(F.col("node.l").isin(*ends)).select(F.col("start.i").cast(kind).alias("__near"), F.col("start.l").alias("__nearlab"), F.col("node.i").cast(kind).alias("__far"), F.col("node.l").alias("__farlab"))
        on = [F.col(f"__{a}__id") == F.col("__near"), F.col(f"__{a}__lab") == F.col("__nearlab")]
        return self.arrive(scope, reached, on, p, b, ways, label, {}, (), None)

    def where(self, scope: Scope, e: Any) -> Scope:
        for c in conjuncts(e) if e is not None else []:
            negated = isinstance(c, S.Un) and c.op == "not" and isinstance(c.arg, S.Exists)
            if isinstance(c, S.Exists) or negated:
                scope = self.semi(scope, c.arg if negated else c, "left_anti" if negated else "left_semi")
            else:
                known = scope.vars
                c, scope = self.lifted(c, scope)
                scope = Scope(scope.df.where(self.expr(c, scope)).drop(*[f"__{v}" for v in scope.vars if v not in known]), known)
        return scope

    def inner(self, parts: tuple, where: Any, scope: Scope) -> tuple[DataFrame, list[Column], Scope, Any]:
        """A pattern compiled by itself, its shared variables renamed; the join condition with `scope`;
        and what of `where` reads outer variables."""
        own = self.match(list(parts), Scope(None))
        shared = [v for v in own.vars if v in scope.vars]
        outer = [v for v in scope.vars if v not in own.vars]
        mine, rest = [], []
        for c in conjuncts(where) if where is not None else []:
            (rest if self._reads(c, outer) else mine).append(c)
        for c in mine:
            own = self.where(own, c)
        df, on = own.df, []
        for v in shared:
            for c in [x for x in df.columns if x.startswith(f"__{v}__") or x == f"__{v}"]:
                df = df.withColumnRenamed(c, f"__in{c}")
            on.append(F.col(f"__{v}__id") == F.col(f"__in__{v}__id"))
            if len(scope.vars[v].labels) > 1 or len(own.vars[v].labels) > 1:
                on.append(F.col(f"__{v}__lab") == F.col(f"__in__{v}__lab"))
        return df, on, own, rest

    def _reads(self, e: Any, names: list[str]) -> bool:
        return isinstance(e, S.Var) and e.name in names or any(self._reads(c, names) for c in S.children(e))

    def semi(self, scope: Scope, e: S.Exists, how: str) -> Scope:
        df, on, own, rest = self.inner(e.parts, e.where, scope)
        both = Scope(None, {**own.vars, **scope.vars})
        on += [self.expr(c, both) for c in rest]
        return Scope(scope.df.join(df, _all(on or [F.lit(True)]), how), scope.vars)

    def lifted(self, e: Any, scope: Scope) -> tuple[Any, Scope]:
        """`e` with each EXISTS { } inside it replaced by a truth value that the rows of the scope get for it."""
        if isinstance(e, S.Exists):
            self.fresh += 1
            name = f"exists{self.fresh}"
            return S.Var(name), Scope(self.flagged(e, name, scope), {**scope.vars, name: Bound("value")})
        if isinstance(e, (tuple, list)):
            out = []
            for x in e:
                x, scope = self.lifted(x, scope)
                out.append(x)
            return type(e)(out), scope
        if not is_dataclass(e):
            return e, scope
        changed = {}
        for f in fields(e):
            changed[f.name], scope = self.lifted(getattr(e, f.name), scope)
        return replace(e, **changed), scope

    def flagged(self, e: S.Exists, name: str, scope: Scope) -> DataFrame:
        """The scope's rows with `__name`: whether the pattern exists for their values. The values are taken once
        each, met with the pattern by a semi-join, and joined back."""
        df, on, own, rest = self.inner(e.parts, e.where, scope)
        on = on + [self.expr(c, Scope(None, {**own.vars, **scope.vars})) for c in rest]
        read = [v for v in scope.vars if v in own.vars or any(self._reads(c, [v]) for c in rest)]
        cols = [c for v in read for c in scope.df.columns if c == f"__{v}" or c.startswith(f"__{v}__") and (v not in own.vars or c.endswith(("__id", "__lab")) or any(self._reads(x, [v]) for x in rest))]
        if not cols:
            return scope.df.join(df.limit(1).select(F.lit(True).alias("__hit")), F.lit(True), "left").withColumn(f"__{name}", F.coalesce("__hit", F.lit(False))).drop("__hit")
        hit = scope.df.select(*cols).distinct().join(df, _all(on or [F.lit(True)]), "left_semi")
        hit = hit.select(*[F.col(f"`{c}`").alias(f"__hit{i}") for i, c in enumerate(cols)], F.lit(True).alias("__hit"))
        out = scope.df.join(hit, _all([F.col(f"`{c}`").eqNullSafe(F.col(f"__hit{i}")) for i, c in enumerate(cols)]), "left")
        return out.withColumn(f"__{name}", F.coalesce("__hit", F.lit(False))).drop("__hit", *[f"__hit{i}" for i in range(len(cols))])

    def optional(self, c: S.Match, scope: Scope) -> Scope:
        if scope.df is None:
            scope = Scope(self._rows(scope), {})
        df, on, own, rest = self.inner(tuple(c.parts), c.where, scope)
        both = Scope(None, {**own.vars, **scope.vars})
        on += [self.expr(x, both) for x in rest]
        out = scope.df.join(df, _all(on or [F.lit(True)]), "left_outer")
        return Scope(out.drop(*[x for x in out.columns if x.startswith("__in__")]), both.vars)

    def subquery(self, q: S.Query, scope: Scope) -> Scope:
        """Uncorrelated: a cross join. With a leading WITH: for each combination of the imported
        values once, joined back on them."""
        first = q.branches[0][0]
        if isinstance(first, S.Project) and not first.final and not any(S.has_aggregate(i.expr) for i in first.items):
            names = [i.expr.name for i in first.items if isinstance(i.expr, S.Var)]
            keys = [c for n in names for c in scope.df.columns if c == f"__{n}" or c.startswith(f"__{n}__")]
            seed = scope.df.select(*keys).distinct()
            mark = {n: scope.vars[n] for n in names}
            idents = [f"__{n}__id" if scope.vars[n].kind == "node" else f"__{n}" for n in names]
            inner = Scope(seed.select("*", *[F.col(k).alias(f"__imp{j}") for j, k in enumerate(idents)]), {**mark, **{f"imp{j}": Bound("value") for j in range(len(idents))}})
            body = q.branches[0][1:]
            last = body[-1]
            carried = S.Project([*last.items, *[S.Item(S.Var(f"imp{j}"), f"__imp{j}") for j in range(len(idents))]], last.star, last.distinct, None, last.order, last.skip, last.limit, True)
            out = self.run([*body[:-1], carried], inner).df
            new = [c for c in out.columns if not c.startswith("__imp")]
            out = out.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in new], *[f"__imp{j}" for j in range(len(idents))])
            on = _all([F.col(k).eqNullSafe(F.col(f"__imp{j}")) for j, k in enumerate(idents)])
            df = scope.df.join(out, on).drop(*[f"__imp{j}" for j in range(len(idents))])
        else:
            out = self.query(q)
            new = out.columns
            out = out.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in new])
            df = out if scope.df is None else scope.df.crossJoin(out)
        return Scope(df, {**scope.vars, **{c: Bound("value") for c in new}})

    # --- projections -----------------------------------------------------------------------------

    def project(self, c: S.Project, scope: Scope) -> Scope:
        df = self._rows(scope)
        named = scope.vars
        items, scope = self.lifted(list(c.items), Scope(df, scope.vars))
        if c.star:
            items = [S.Item(S.Var(v), v) for v in named if not v.startswith("anon")] + items
        if any(S.has_aggregate(i.expr) for i in items):
            out = self.aggregated(items, scope, c)
        else:
            out = self.plain(items, scope, c)
        if c.final:
            names = [i.alias for i in items]
            return Scope(out.df.select(*[self.whole(v, out).alias(n) for v, n in zip([i.alias for i in items], names, strict=True)]), {})
        return self.where(out, c.where) if c.where is not None else out

    def whole(self, var: str, scope: Scope) -> Column:
        """A variable as one value."""
        b = scope.vars[var]
        if b.kind == "value":
            return F.col(f"`__{var}`")
        props = [F.col(f"`__{var}__p_{p}`").alias(p) for p in b.props]
        if b.kind == "node":
            return F.struct(F.col(f"`__{var}__id`").alias("_id"), F.col(f"`__{var}__lab`").alias("_label"), *props)
        return F.struct(F.col(f"`__{var}__type`").alias("_type"), F.col(f"`__{var}__src`").alias("_src"), F.col(f"`__{var}__dst`").alias("_dst"), *props)

    def _passed(self, i: S.Item, scope: Scope) -> list[Column] | None:
        """The columns of a node or relationship handed on whole."""
        if isinstance(i.expr, S.Var) and i.expr.name in scope.vars and scope.vars[i.expr.name].kind != "value":
            old = f"__{i.expr.name}__"
            return [F.col(f"`{x}`").alias(f"__{i.alias}__{x[len(old) :]}") for x in scope.df.columns if x.startswith(old)]
        return None

    def _bound(self, i: S.Item, scope: Scope) -> Bound:
        return scope.vars[i.expr.name] if isinstance(i.expr, S.Var) and i.expr.name in scope.vars else Bound("value")

    def plain(self, items: list, scope: Scope, c: S.Project) -> Scope:
        cols: list[Column] = []
        for i in items:
            cols += self._passed(i, scope) or [self.expr(i.expr, scope).alias(f"__{i.alias}")]
        vars_ = {i.alias: self._bound(i, scope) for i in items}
        order = []
        if c.order and not c.distinct:
            for k, (e, desc) in enumerate(c.order):
                alias = next((i for i in items if e in (i.expr, S.Var(i.alias))), None)
                cols.append(self.expr(alias.expr if alias else e, scope).alias(f"__sort{k}"))
                order.append(F.col(f"__sort{k}").desc() if desc else F.col(f"__sort{k}").asc())
        df = scope.df.select(*cols)
        if c.distinct:
            out = Scope(df.distinct(), vars_)
            return Scope(self.cut(self.sorted(out, items, c.order), c, scope), vars_)
        df = df.orderBy(*order) if order else df
        df = self.cut(df, c, scope)
        return Scope(df.drop(*[f"__sort{k}" for k in range(len(order))]), vars_)

    def sorted(self, out: Scope, items: list, order: list) -> DataFrame:
        if not order:
            return out.df
        keys = []
        for e, desc in order:
            alias = next((i for i in items if e in (i.expr, S.Var(i.alias))), None)
            k = self.expr(S.Var(alias.alias), out) if alias else self.expr(self.renamed(e, items), out)
            keys.append(k.desc() if desc else k.asc())
        return out.df.orderBy(*keys)

    def renamed(self, e: Any, items: list) -> Any:
        """`e` over the output: expressions that an item computes become that item."""
        hit = next((i for i in items if i.expr == e), None)
        if hit:
            return S.Var(hit.alias)
        if isinstance(e, S.Bin):
            return S.Bin(e.op, self.renamed(e.left, items), self.renamed(e.right, items))
        if isinstance(e, S.Un):
            return S.Un(e.op, self.renamed(e.arg, items))
        if isinstance(e, S.Call):
            return S.Call(e.name, tuple(self.renamed(a, items) for a in e.args), e.distinct, e.star)
        return e

    def cut(self, df: DataFrame, c: S.Project, scope: Scope) -> DataFrame:
        n = [None if e is None else e.value if isinstance(e, S.Lit) else self.params[e.name] if isinstance(e, S.Param) else None for e in (c.skip, c.limit)]
        if (c.skip is not None and n[0] is None) or (c.limit is not None and n[1] is None):
            raise CypherError("SKIP and LIMIT take numbers or parameters")
        if n[0]:
            df = df.offset(n[0])
        return df.limit(n[1]) if n[1] is not None else df

    def aggregated(self, items: list, scope: Scope, c: S.Project) -> Scope:
        keys, aggs, after = [], [], []
        calls: dict[Any, str] = {}
        ordered: dict[str, Column] = {}

        def lifted(e: Any) -> Any:
            if isinstance(e, S.Call) and e.name in S.AGGREGATES:
                if any(map(S.has_aggregate, e.args)):
                    raise CypherError("an aggregate inside an aggregate")
                if e not in calls:
                    calls[e] = f"agg{len(calls)}"
                    p = e.args[1].value if len(e.args) > 1 and isinstance(e.args[1], S.Lit) else None
                    arg = [] if e.star else [F.col(f"__{e.args[0].name}__id") if isinstance(e.args[0], S.Var) and e.args[0].name in scope.vars and scope.vars[e.args[0].name].kind == "node" and e.name == "count" else self.expr(e.args[0], scope)]
                    if e.name == "percentiledisc":  # only SQL has it, over a named column
                        ordered[f"__in_{calls[e]}"] = arg[0]
                        aggs.append(F.expr(f"percentile_disc({0.5 if p is None else p}) WITHIN GROUP (ORDER BY __in_{calls[e]})").alias(f"__{calls[e]}"))
                    else:
                        aggs.append(scalar.aggregate(e.name, arg, e.distinct, p).alias(f"__{calls[e]}"))
                return S.Var(calls[e])
            if isinstance(e, S.Bin):
                return S.Bin(e.op, lifted(e.left), lifted(e.right))
            if isinstance(e, S.Un):
                return S.Un(e.op, lifted(e.arg))
            if isinstance(e, S.Call):
                return S.Call(e.name, tuple(map(lifted, e.args)), e.distinct, e.star)
            if isinstance(e, S.Case):
                return S.Case(lifted(e.subject) if e.subject is not None else None, tuple((lifted(a), lifted(b)) for a, b in e.whens), lifted(e.default) if e.default is not None else None)
            if isinstance(e, S.Index):
                return S.Index(lifted(e.of), lifted(e.at))
            hit = next((i for i in items if i.expr == e and not S.has_aggregate(i.expr)), None)
            return S.Var(hit.alias) if hit else e

        for i in items:
            if not S.has_aggregate(i.expr):
                keys += self._passed(i, scope) or [self.expr(i.expr, scope).alias(f"__{i.alias}")]
        order = [(lifted(e), d) if S.has_aggregate(e) and not any(e == i.expr for i in items) else (e, d) for e, d in c.order]
        for i in items:
            after.append((i, lifted(i.expr) if S.has_aggregate(i.expr) else None))
        grouped = scope.df.withColumns(ordered).groupBy(*keys).agg(*aggs) if ordered else scope.df.groupBy(*keys).agg(*aggs)
        inside = {i.alias: self._bound(i, scope) for i, e in after if e is None} | {n: Bound("value") for n in calls.values()}
        mid = Scope(grouped, inside)
        cols: list[Column] = []
        for i, e in after:
            same = self._passed(S.Item(S.Var(i.alias), i.alias), mid) if e is None else None
            cols += same or [self.expr(S.Var(i.alias) if e is None else e, mid).alias(f"__{i.alias}")]
        hidden = [F.col(f"__{n}") for n in calls.values() if n not in [i.alias for i in items]]
        out = Scope(grouped.select(*cols, *hidden), {i.alias: inside.get(i.alias, Bound("value")) if e is None else Bound("value") for i, e in after} | {n: Bound("value") for n in calls.values()})
        df = out.df.distinct() if c.distinct else out.df
        df = self.cut(self.sorted(Scope(df, out.vars), items, order), c, scope)
        return Scope(df.drop(*[f"__{n}" for n in calls.values() if n not in [i.alias for i in items]]), {k: v for k, v in out.vars.items() if k in [i.alias for i in items]})

    # --- expressions -----------------------------------------------------------------------------

    def kind(self, c: Column, scope: Scope) -> str:
        if scope.df is None or self.lambdas:  # a lambda's variable has no type by itself
            return "unknown"
        return scope.df.select(c).schema[0].dataType.simpleString()

    def expr(self, e: Any, scope: Scope, local: dict[str, Column] | None = None) -> Column:
        local = local or {}
        sub = lambda x: self.expr(x, scope, local)
        if isinstance(e, S.Lit):
            return F.lit(e.value)
        if isinstance(e, S.Param):
            if e.name not in self.params:
                raise CypherError(f"no value for ${e.name}")
            v = self.params[e.name]
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if isinstance(e, S.Var):
            if e.name in local:
                return local[e.name]
            if e.name not in scope.vars:
                raise CypherError(f"undefined variable {e.name}")
            return self.whole(e.name, scope)
        if isinstance(e, S.Prop):
            if isinstance(e.of, S.Var) and e.of.name not in local and e.of.name in scope.vars and scope.vars[e.of.name].kind != "value":
                b = scope.vars[e.of.name]
                if e.name == "id" and "id" not in b.props and b.kind == "node":
                    return F.col(f"`__{e.of.name}__id`")
                return F.col(f"`__{e.of.name}__p_{e.name}`") if e.name in b.props else F.lit(None)
            return sub(e.of)[e.name]
        if isinstance(e, S.Un):
            x = sub(e.arg) if not isinstance(e.arg, S.Var) or e.arg.name in local or scope.vars.get(e.arg.name, Bound("value")).kind == "value" else F.col(f"__{e.arg.name}__{'id' if scope.vars[e.arg.name].kind == 'node' else 'type'}")
            return {"not": lambda: ~x, "-": lambda: -x, "isnull": x.isNull, "notnull": x.isNotNull}[e.op]()
        if isinstance(e, S.Bin):
            return self.binary(e, scope, sub)
        if isinstance(e, S.Case):
            subject = sub(e.subject) if e.subject is not None else None
            out = None
            for test, value in e.whens:
                cond = sub(test) if subject is None else subject == sub(test)
                out = F.when(cond, sub(value)) if out is None else out.when(cond, sub(value))
            return out.otherwise(sub(e.default)) if e.default is not None else out
        if isinstance(e, S.ListOf):
            return F.array(*map(sub, e.items))
        if isinstance(e, S.MapOf):
            return F.struct(*[sub(v).alias(k) for k, v in e.items])
        if isinstance(e, S.Index):
            at = sub(e.at)
            base = sub(e.of)
            return base[at] if self.kind(base, scope).startswith("map") else F.get(base, F.when(at < 0, F.size(base) + at).otherwise(at))
        if isinstance(e, S.Comprehension):
            source = sub(e.source)
            self.lambdas += 1
            if e.where is not None:
                source = F.filter(source, lambda x: F.coalesce(self.expr(e.where, scope, {**local, e.var: x}), F.lit(False)))
            out = F.transform(source, lambda x: self.expr(e.result, scope, {**local, e.var: x})) if e.result is not None else source
            self.lambdas -= 1
            return out
        if isinstance(e, S.Exists):
            raise CypherError("EXISTS { } can't stand inside a list comprehension or an aggregate")
        return self.call(e, scope, sub)

    def binary(self, e: S.Bin, scope: Scope, sub) -> Column:
        if e.op in ("=", "<>") and isinstance(e.left, S.Var) and isinstance(e.right, S.Var):
            a, b = scope.vars.get(e.left.name), scope.vars.get(e.right.name)
            if a and b and a.kind == b.kind == "node":
                same = (F.col(f"__{e.left.name}__id") == F.col(f"__{e.right.name}__id")) & (F.col(f"__{e.left.name}__lab") == F.col(f"__{e.right.name}__lab"))
                return same if e.op == "=" else ~same
        if e.op == "in" and isinstance(e.right, S.ListOf):
            return sub(e.left).isin(*map(sub, e.right.items)) if e.right.items else F.lit(False)
        a, b = sub(e.left), sub(e.right)
        if e.op in _COMPARE:
            return getattr(a, _COMPARE[e.op])(b)
        if e.op == "and":
            return a & b
        if e.op == "or":
            return a | b
        if e.op == "xor":
            return (a & ~b) | (~a & b)
        if e.op == "starts":
            return a.startswith(b)
        if e.op == "ends":
            return a.endswith(b)
        if e.op == "contains":
            return a.contains(b)
        if e.op == "=~":
            return F.rlike(a, b)
        if e.op == "in":
            return F.array_contains(b, a)
        if e.op == "+":
            ka, kb = self.kind(a, scope), self.kind(b, scope)
            if ka.startswith("array") or kb.startswith("array"):
                return F.concat(a if ka.startswith("array") else F.array(a), b if kb.startswith("array") else F.array(b))
            return F.concat(a.cast("string"), b.cast("string")) if "string" in (ka, kb) else a + b
        return {"-": a.__sub__, "*": a.__mul__, "/": a.__truediv__, "%": a.__mod__}[e.op](b)

    def call(self, e: S.Call, scope: Scope, sub) -> Column:
        if e.name in S.AGGREGATES:
            raise CypherError(f"{e.name}() is only for RETURN and WITH")
        var = e.args[0].name if len(e.args) == 1 and isinstance(e.args[0], S.Var) else None
        bound = scope.vars.get(var) if var else None
        if bound is not None and bound.kind != "value":
            if e.name == "id" and bound.kind == "node":
                return F.col(f"__{var}__id")
            if e.name == "type" and bound.kind == "edge":
                return F.col(f"__{var}__type")
            if e.name == "labels":
                one = F.array(F.col(f"__{var}__lab"))
                return F.array_union(one, F.coalesce(F.col(f"__{var}__extra"), F.array().cast("array<string>"))) if scope.df is not None and f"__{var}__extra" in scope.df.columns else one
            props = [(p, F.col(f"`__{var}__p_{p}`")) for p in bound.props]
            if e.name == "properties":
                return F.struct(*[c.alias(p) for p, c in props])
            if e.name == "keys":
                return F.filter(F.array(*[F.when(c.isNotNull(), F.lit(p)) for p, c in props]), lambda x: x.isNotNull())
            if e.name == "startnode":
                return F.col(f"__{var}__src")
            if e.name == "endnode":
                return F.col(f"__{var}__dst")
        if e.name == "exists":
            return sub(e.args[0]).isNotNull()
        if e.name in ("nodes", "relationships"):
            return sub(e.args[0])[e.name]
        if e.name in ("size", "length"):
            x = sub(e.args[0])
            kind = self.kind(x, scope)
            return F.size(x["relationships"]) if kind.startswith("struct") else F.size(x) if kind.startswith(("array", "map")) else F.char_length(x)
        if e.name == "reverse":
            return F.reverse(sub(e.args[0]))
        if e.name == "type":
            return F.lit(self.kind(sub(e.args[0]), scope))
        if e.name not in scalar.SCALAR:
            raise CypherError(f"unknown function {e.name}()")
        least, most, build = scalar.SCALAR[e.name]
        if not least <= len(e.args) <= most:
            raise CypherError(f"{e.name}() takes {least}..{most} arguments, not {len(e.args)}")
        return build(*map(sub, e.args))


def compile_query(graph: Graph, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    return Compiler(graph, params).query(S.parse(text))
