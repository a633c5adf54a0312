"""Set-based graph analytics over edge tables (src, dst): one plan answers all starts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.paths import levels


def two_hops(edges: DataFrame) -> DataFrame:
    """start, via, candidate of every path of two edges that doesn't return to its start."""
    a = edges.select(F.col("src").alias("start"), F.col("dst").alias("via"))
    b = edges.select(F.col("src").alias("via"), F.col("dst").alias("candidate"))
    return a.join(b, "via").where("start <> candidate")


def friends_of_friends(edges: DataFrame) -> DataFrame:
    """start, candidate at two hops, without direct friends."""
    direct = edges.select(F.col("src").alias("start"), F.col("dst").alias("candidate"))
    return two_hops(edges).select("start", "candidate").distinct().join(direct, ["start", "candidate"], "left_anti")


def recommendations(edges: DataFrame, least_common: int = 2) -> DataFrame:
    """start, candidate, common: friends of friends with at least so many friends in common."""
    direct = edges.select(F.col("src").alias("start"), F.col("dst").alias("candidate"))
    wedges = two_hops(edges).distinct().groupBy("start", "candidate").agg(F.count("*").alias("common")).where(F.col("common") >= least_common)
    return wedges.join(direct, ["start", "candidate"], "left_anti")


def common_neighbors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: a, b. a, b, common: nodes that both point to."""
    e = edges.select("src", "dst").distinct()
    left = pairs.join(e.select(F.col("src").alias("a"), F.col("dst").alias("common")), "a")
    return left.join(e.select(F.col("src").alias("b"), F.col("dst").alias("common")), ["b", "common"]).select("a", "b", "common")


def degree(edges: DataFrame, k: int | None = None) -> DataFrame:
    """node, degree by outgoing edges; the k largest (ties by node) if k is given."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return out if k is None else out.orderBy(F.desc("degree"), "node").limit(k)


def trending(knows: DataFrame, created: DataFrame, topics: DataFrame) -> DataFrame:
    """start, topic, n: what the friends of `start` created, by topic. created: src, dst; topics: id, topic."""
    friends = knows.select(F.col("src").alias("start"), F.col("dst").alias("friend"))
    made = created.select(F.col("src").alias("friend"), F.col("dst").alias("id"))
    return friends.join(made, "friend").join(topics, "id").groupBy("start", "topic").agg(F.count("*").alias("n"))


def nearest_with_edge(edges: DataFrame, starts: DataFrame, typed: DataFrame, longest: int = 6) -> DataFrame:
    """start, node, hops: the nearest node (smallest of equally near ones) that has an outgoing edge in
    `typed`; the start itself counts at 0 hops."""
    holders = typed.select(F.col("src").alias("node")).distinct()
    starts = starts.select("start").distinct()
    parts = [starts.select("start", F.col("start").alias("node")).join(holders, "node", "left_semi").withColumn("hops", F.lit(0))]
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    for depth, step in levels(e, starts, longest):
        parts.append(step.join(holders, "node", "left_semi").withColumn("hops", F.lit(depth)).select("start", "node", "hops"))
    out = parts[0].select("start", "node", "hops")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("start").agg(F.min(F.struct("hops", "node")).alias("m")).select("start", "m.node", "m.hops")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str = "ts", values: list[str] | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of the same key at or before its time.

    One union and one window instead of a range join: both sides go to their key once, and the running
    last non-null value is carried forward. Right rows come before left rows of the same time; of
    right rows with one key and time, that with the largest values counts."""
    values = values or [c for c in right.columns if c not in (*by, time)]
    r = right.select(*by, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__r"), F.lit(None).alias("__l"))
    l = left.select(*by, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__r"), F.struct(*left.columns).alias("__l"))  # noqa: E741
    r, l = r.withColumn("__l", F.lit(None).cast(l.schema["__l"].dataType)), l.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType))  # noqa: E741
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = r.select(*l.columns).unionByName(l).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__l.*", *[F.col(f"__last.{v}").alias(v) for v in values])
