"""The property graph as DataFrames: one table per label and one per kind of relationship."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class AnyOf(tuple):
    """Labels of which a node needs one; a plain tuple of labels asks for all."""


@dataclass(frozen=True)
class VertexTable:
    """`df` has the column `id` and the label's properties. `extra`: an optional column of further
    labels (array of strings), for nodes that carry several."""

    label: str
    df: DataFrame
    extra: str | None = None

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", self.extra)]

    def unmet(self, labels: tuple[str, ...]) -> tuple[str, ...]:
        """Of `labels` those that the table's own label doesn't settle."""
        if isinstance(labels, AnyOf):
            return () if self.label in labels else labels
        return tuple(x for x in labels if x != self.label)


@dataclass(frozen=True)
class EdgeTable:
    """`df` has `src`, `dst` and the relationship's properties. `key`: columns that tell parallel
    relationships apart, beside src and dst. `node_side`: the end whose nodes' own table this is, one row
    a node; `whole` is then `df` with that node's properties as `node_<name>`, so that a hop to it reads
    one table only."""

    rel_type: str
    src_label: str
    dst_label: str
    df: DataFrame
    key: tuple[str, ...] = ()
    node_side: str | None = None
    whole: DataFrame | None = None

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("src", "dst")]


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    vertices: dict[str, VertexTable] = field(default_factory=dict)
    edges: tuple[EdgeTable, ...] = ()

    def with_vertices(self, label: str, df: DataFrame, extra: str | None = None) -> Graph:
        # a label's new table isn't the one that relationships were taken from
        edges = tuple(replace(e, node_side=None, whole=None) if e.node_side and label == (e.src_label if e.node_side == "src" else e.dst_label) else e for e in self.edges)
        return replace(self, vertices={**self.vertices, label: VertexTable(label, df, extra)}, edges=edges)

    def with_edges(self, rel_type: str, src_label: str, dst_label: str, df: DataFrame, key: tuple[str, ...] = ()) -> Graph:
        kept = tuple(e for e in self.edges if (e.rel_type, e.src_label, e.dst_label) != (rel_type, src_label, dst_label))
        return replace(self, edges=(*kept, EdgeTable(rel_type, src_label, dst_label, df, key)))

    def with_foreign_key(self, rel_type: str, src_label: str, dst_label: str, side: str, other: str, *props: str) -> Graph:
        """A relationship that the nodes of one end (`side`: src or dst) hold in their column `other`, with
        `props` of them as its properties."""
        table = self.vertices[src_label if side == "src" else dst_label]
        ends = {side: F.col("id"), "dst" if side == "src" else "src": F.col(other)}
        rows = table.df.where(F.col(other).isNotNull())
        cols = [ends["src"].alias("src"), ends["dst"].alias("dst"), *props]
        made = EdgeTable(rel_type, src_label, dst_label, rows.select(*cols), (), side, rows.select(*cols, *[F.col(c).alias(f"node_{c}") for c in table.properties]))
        return replace(self, edges=(*self.edges, made))

    # scans
    def labelled(self, labels: tuple[str, ...]) -> list[tuple[VertexTable, tuple[str, ...]]]:
        """Tables that may hold nodes with all `labels` (one of them, if AnyOf), each with the labels to look up
        in `extra`."""
        return [(t, t.unmet(labels)) for t in self.vertices.values() if t.extra or not t.unmet(labels)]

    def nodes(self) -> DataFrame:
        """All nodes: id (string), labels, props (map of strings)."""
        parts = []
        for t in self.vertices.values():
            labels = F.array(F.lit(t.label))
            if t.extra:
                labels = F.array_union(labels, F.coalesce(F.col(t.extra), F.array().cast("array<string>")))
            props = F.map_filter(F.create_map(*[x for c in t.properties for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if t.properties else F.create_map().cast("map<string,string>")
            parts.append(t.df.select(F.col("id").cast("string").alias("id"), labels.alias("labels"), props.alias("props")))
        return _union(parts)

    def all_edges(self) -> DataFrame:
        """All relationships: from_id, to_id (strings), edge_type, edge_id, properties (map of strings)."""
        parts = []
        for e in self.edges:
            props = F.create_map(*[x for c in e.properties for x in (F.lit(c), F.col(c).cast("string"))]) if e.properties else F.create_map().cast("map<string,string>")
            ident = F.concat_ws(":", F.lit(e.rel_type), *[F.col(c).cast("string") for c in ("src", "dst", *e.key)])
            parts.append(e.df.select(F.col("src").cast("string").alias("from_id"), F.col("dst").cast("string").alias("to_id"), F.lit(e.rel_type).alias("edge_type"), ident.alias("edge_id"), props.alias("properties")))
        return _union(parts)

    def register_views(self) -> list[str]:
        """Temp views for SQL: each label, `nodes`, `edge_T`, `Src_T_Dst` and `_edges`."""
        made = []

        def view(name: str, df: DataFrame) -> None:
            df.createOrReplaceTempView(name)
            made.append(name)

        for t in self.vertices.values():
            view(t.label, t.df)
        if self.vertices:
            view("nodes", self.nodes())
        by_type: dict[str, list[DataFrame]] = {}
        for e in self.edges:
            df = e.df.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.lit(e.rel_type).alias("edge_type"), *e.properties)
            view(f"{e.src_label}_{e.rel_type}_{e.dst_label}", df)
            by_type.setdefault(e.rel_type, []).append(df)
        for rel_type, parts in by_type.items():
            view(f"edge_{rel_type}", _union(parts))
        if self.edges:
            view("_edges", self.all_edges())
        return made


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def tpch_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The star-schema tables as a graph. Property names lose their table prefix."""
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def plain(df: DataFrame, key: str, prefix: str) -> DataFrame:
        return df.select(F.col(key).alias("id"), *[F.col(c).alias(c.removeprefix(prefix)) for c in df.columns if c != key])

    customer, orders, lineitem, events = t("customer"), t("orders"), t("lineitem"), t("events")
    g = Graph(spark)
    for label, df, key, prefix in (("Region", t("region"), "r_regionkey", "r_"), ("Nation", t("nation"), "n_nationkey", "n_"), ("Customer", customer, "c_custkey", "c_"), ("Supplier", t("supplier"), "s_suppkey", "s_"), ("Part", t("part"), "p_partkey", "p_"), ("Order", orders, "o_orderkey", "o_"), ("Event", events, "event_id", "")):
        g = g.with_vertices(label, plain(df, key, prefix))
    g = g.with_vertices("User", events.select(F.col("user_id").alias("id")).distinct())
    pair = lambda df, a, b, *props: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), *props)
    line = [F.col(f"l_{c}").alias(c) for c in ("quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate", "suppkey", "linenumber") if f"l_{c}" in lineitem.columns]
    g = g.with_foreign_key("IN_REGION", "Nation", "Region", "src", "regionkey")
    g = g.with_foreign_key("IN_NATION", "Customer", "Nation", "src", "nationkey")
    g = g.with_foreign_key("IN_NATION", "Supplier", "Nation", "src", "nationkey")
    g = g.with_foreign_key("PLACED", "Customer", "Order", "dst", "custkey", "orderdate")
    g = g.with_edges("CONTAINS", "Order", "Part", pair(lineitem, "l_orderkey", "l_partkey", *line), ("linenumber", "extendedprice"))
    g = g.with_edges("SUPPLIED_BY", "Order", "Supplier", pair(lineitem, "l_orderkey", "l_suppkey", F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("shipdate")), ("quantity", "shipdate"))
    g = g.with_foreign_key("DID", "User", "Event", "dst", "user_id")
    following = F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    near = customer.select(F.col("c_custkey").alias("src"), following.alias("dst")).where("dst is not null")
    return g.with_edges("KNOWS", "Customer", "Customer", near)

