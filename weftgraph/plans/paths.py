"""Iterative traversals as joins: variable-length paths, breadth-first search, shortest paths and
transitive closure. Every level is one equi-join on the frontier; visited pairs leave by anti-join."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: After so many levels what they have found is cut, so that plans don't grow with the length of a path.
CUT_LEVELS = 8


def levels(edges: DataFrame, starts: DataFrame, longest: int | None):
    """edges: u, v; starts: start (distinct). Yields for depth 1, 2, ...: (start, node) reached by an
    edge from a node whose distance is depth - 1; ends with an empty frontier, or after `longest`."""
    edges = cut(edges.select("u", "v").distinct())  # every level reads them again
    frontier = starts.select("start", F.col("start").alias("node"))
    visited = frontier
    for depth in count(1):
        if longest is not None and depth > longest:
            return
        step = frontier.join(edges, frontier["node"] == edges["u"]).select("start", F.col("v").alias("node")).distinct()
        # the rows and which of them are new, in one job
        step = cut(step.join(visited.withColumn("old", F.lit(True)), ["start", "node"], "left"))
        yield depth, step.select("start", "node")
        frontier = step.where("old is null").select("start", "node")
        if depth == longest or frontier.isEmpty():
            return
        visited = visited.unionByName(frontier)
        if depth % CUT_LEVELS == 0:
            visited = cut(visited)


def distances(edges: DataFrame, starts: DataFrame, longest: int | None) -> DataFrame:
    """start, node, hops: the fewest edges (at least one) from each start to what it reaches within `longest`, by one
    search from all starts."""
    parts = []
    for depth, step in levels(edges, starts, longest):
        parts.append(step.withColumn("hops", F.lit(depth)))
        if len(parts) > CUT_LEVELS:
            parts = [cut(reduce(DataFrame.unionByName, parts).groupBy("start", "node").agg(F.min("hops").alias("hops")))]
    if not parts:
        return starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).limit(0)
    return reduce(DataFrame.unionByName, parts).groupBy("start", "node").agg(F.min("hops").alias("hops"))


def lookup(closure_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: u, v. With `reachable` and `distance` (null where v can't be reached), from a closure's rows."""
    found = pairs.select("u", "v").distinct().join(closure_rows.select("u", "v", "distance"), ["u", "v"], "left")
    return found.select("u", "v", F.col("distance").isNotNull().alias("reachable"), "distance")


def var_length(edges: DataFrame, starts: DataFrame, least: int, most: int | None) -> DataFrame:
    """Distinct (start, node): an edge u -> node exists with dist(start, u) = d - 1 for some d in
    [least, most]; with least = 0 the start itself as well. most = None: as far as there are edges."""
    parts = [starts.select("start", F.col("start").alias("node"))] if least == 0 else []
    for depth, step in levels(edges, starts, most):
        if depth >= least:
            parts.append(step)
        if len(parts) > CUT_LEVELS:
            parts = [cut(reduce(DataFrame.unionByName, parts).distinct())]
    if not parts:
        return starts.select("start", F.col("start").alias("node")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """node, depth: what the starts together reach by at most `max_depth` edges, at its first depth. A
    start comes out only if an edge leads back to it."""
    edges = cut(edges.select("u", "v").distinct())
    frontier, seen = starts.select(F.col(starts.columns[0]).alias("node")).distinct(), None
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["u"]).select(F.col("v").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen, "node", "left_anti")
        frontier = cut(step)
        if frontier.isEmpty():
            break
        found = frontier.withColumn("depth", F.lit(depth))
        seen = found if seen is None else seen.unionByName(found)
    return seen if seen is not None else frontier.withColumn("depth", F.lit(0)).limit(0)


def closure(edges: DataFrame, max_depth: int = 16) -> DataFrame:
    """u, v, distance of all pairs with a path of 1..max_depth edges: semi-naive, so each round joins
    only the pairs that the last one found. A pair (u, u) stands for a cycle."""
    edges = cut(edges.select("u", "v").distinct())
    delta = edges.withColumn("distance", F.lit(1))
    reach = delta
    for depth in range(2, max_depth + 1):
        step = delta.select("u", F.col("v").alias("m")).join(edges.select(F.col("u").alias("m"), "v"), "m").select("u", "v").distinct()
        delta = cut(step.join(reach, ["u", "v"], "left_anti").withColumn("distance", F.lit(depth)))
        if delta.isEmpty():
            break
        reach = reach.unionByName(delta)
    return reach


def closure_add(reach: DataFrame, edges: DataFrame, added: DataFrame, max_depth: int = 16) -> DataFrame:
    """The closure after `added` edges (u, v), from the old one: paths that use a new edge are old path +
    new edge + old path, repeated until nothing gets nearer. `edges`: the old edges, for the new ones
    that stand in them already."""
    new = added.select("u", "v").distinct().join(edges.select("u", "v"), ["u", "v"], "left_anti")
    known = reach.unionByName(new.withColumn("distance", F.lit(1))).groupBy("u", "v").agg(F.min("distance").alias("distance"))
    known = cut(known)
    while True:
        left = known.select("u", F.col("v").alias("a"), F.col("distance").alias("dl")).unionByName(new.select(F.col("u"), F.col("u").alias("a"), F.lit(0).alias("dl")))
        right = known.select(F.col("u").alias("b"), "v", F.col("distance").alias("dr")).unionByName(new.select(F.col("v").alias("b"), "v", F.lit(0).alias("dr")))
        via = left.join(new.select(F.col("u").alias("a"), F.col("v").alias("b")), "a").join(right, "b").select("u", "v", (F.col("dl") + 1 + F.col("dr")).alias("distance")).where(F.col("distance") <= max_depth)
        better = cut(known.unionByName(via).groupBy("u", "v").agg(F.min("distance").alias("distance")))
        if better.join(known, ["u", "v", "distance"], "left_anti").isEmpty():
            return better
        known = better


def closure_remove(edges: DataFrame, removed: DataFrame, reach: DataFrame, max_depth: int = 16) -> DataFrame:
    """The closure after `removed` edges: only sources that reached a removed edge are computed anew."""
    left = edges.select("u", "v").join(removed.select("u", "v"), ["u", "v"], "left_anti")
    heads = removed.select(F.col("u").alias("h")).distinct()
    touched = reach.join(heads, reach["v"] == heads["h"], "left_semi").select("u").union(heads.select(F.col("h").alias("u"))).distinct()
    keep = reach.join(touched, "u", "left_anti")
    parts = [keep]
    starts = touched.select(F.col("u").alias("start"))
    for depth, step in levels(left, starts, max_depth):
        parts.append(step.select(F.col("start").alias("u"), F.col("node").alias("v"), F.lit(depth).alias("distance")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("u", "v").agg(F.min("distance").alias("distance"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, longest: int = 6) -> DataFrame:
    """pairs: start, goal. start, goal, hops for those at a distance of at most `longest` (0 if equal)."""
    pairs = pairs.select("start", "goal").distinct()
    parts = [pairs.where("start = goal").withColumn("hops", F.lit(0))]
    for depth, step in levels(edges, pairs.select("start").distinct(), longest):
        parts.append(pairs.join(step, (pairs["start"] == step["start"]) & (pairs["goal"] == step["node"])).select(pairs["start"], "goal", F.lit(depth).alias("hops")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("start", "goal").agg(F.min("hops").alias("hops"))
