"""Reads of single nodes and sets of them, indexes by label, property and time, and table statistics. All are
plans over the graph's tables: Parquet's row-group statistics and Catalyst's pushdown are the indexes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Graph


def with_all_labels(nodes: DataFrame, names: list[str]) -> DataFrame:
    """nodes: a column `labels` (array). Those that have every label; all nodes for no names."""
    ok = F.lit(True)
    for n in names:
        ok = ok & F.array_contains("labels", n)
    return nodes.where(ok)


def with_any_label(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Those that have at least one of the labels; none for no names."""
    return nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, names)))) if names else nodes.limit(0)


def property_range(rows: DataFrame, prop: str, low: Any, high: Any) -> DataFrame:
    """Rows whose property lies in [low, high], whichever bound is the larger one."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return rows.where(F.col(prop).between(F.least(low, high), F.greatest(low, high)))


def node(graph: Graph, label: str, ident: Any) -> DataFrame:
    """The node's row: id and properties (no row if there is none)."""
    return graph.vertices[label].df.where(F.col("id") == F.lit(ident))


def node_property(graph: Graph, label: str, ident: Any, prop: str) -> Any:
    r = node(graph, label, ident).select(prop).first()
    return r[0] if r else None


def node_states(graph: Graph, label: str, ids: DataFrame) -> DataFrame:
    """The rows of all nodes whose ids stand in the first column of `ids`: one semi-join, however many."""
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    return graph.vertices[label].df.join(wanted, "id", "left_semi")


def outgoing(graph: Graph, label: str, ident: Any, rel_type: str | None = None) -> DataFrame:
    """rel_type, dst_label, dst (text) of the relationships that leave a node."""
    out = None
    for e in graph.edges:
        if e.src_label == label and rel_type in (None, e.rel_type):
            part = e.df.where(F.col("src") == F.lit(ident)).select(F.lit(e.rel_type).alias("rel_type"), F.lit(e.dst_label).alias("dst_label"), F.col("dst").cast("string").alias("dst"))
            out = part if out is None else out.union(part)
    return out if out is not None else graph.spark.createDataFrame([], "rel_type string, dst_label string, dst string")


def time_range(rows: DataFrame, time: str, start: Any, end: Any) -> DataFrame:
    """Rows with start <= time < end; on Parquet only row groups that overlap the range are read."""
    return rows.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))


def statistics(rows: DataFrame, columns: list[str] | None = None, *, exact: bool = False) -> DataFrame:
    """property, least, most (text), total (double; null if not numeric), nulls, present, distinct of each column,
    in one aggregation. distinct is an estimate (HyperLogLog++) unless `exact`."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = columns or list(kinds)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        number = kinds[c].endswith("int") or kinds[c] in ("float", "double") or kinds[c].startswith("decimal")
        aggs += [F.min(x).cast("string").alias(f"l{i}"), F.max(x).cast("string").alias(f"m{i}"), (F.sum(x.cast("double")) if number else F.lit(None).cast("double")).alias(f"t{i}"), F.count_if(x.isNull()).alias(f"n{i}"), F.count(x).alias(f"p{i}"), (F.count_distinct(x) if exact else F.approx_count_distinct(x)).alias(f"d{i}")]
    one = rows.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("property"), F.col(f"l{i}").alias("least"), F.col(f"m{i}").alias("most"), F.col(f"t{i}").alias("total"), F.col(f"n{i}").alias("nulls"), F.col(f"p{i}").alias("present"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*parts)))
