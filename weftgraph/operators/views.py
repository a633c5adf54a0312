"""Materialized views: over the graph, and over event tables as versioned generations with incremental
maintenance."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

LOGGED = 1000
VERSION, SNAPSHOT, UPDATED = "_mv_version", "_mv_src_snapshot_id", "_mv_updated_at"


@dataclass(frozen=True)
class GraphView:
    """The rows of a query, kept under a name. `key`: the columns that tell rows apart in deltas."""

    name: str
    source: str
    mode: str
    rows: DataFrame
    version: int = 1
    key: tuple[str, ...] = field(default=())
    log: tuple[tuple[int, dict[str, int]], ...] = ()  # the last LOGGED changes: version, number of each op

    def refreshed(self, rows: DataFrame) -> GraphView:
        return replace(self, rows=cut(rows), version=self.version + 1)

    def applied(self, deltas: DataFrame, expected: int | None = None) -> GraphView:
        """With `deltas` (see apply_deltas) applied. ValueError if the view isn't at the version that the caller
        expects, or if a row to insert is there already."""
        if expected is not None and expected != self.version:
            raise ValueError(f"{self.name} is at version {self.version}, not {expected}")
        if not deltas.where("op = 'insert'").select(*self.key).join(self.rows, list(self.key), "left_semi").isEmpty():
            raise ValueError(f"{self.name}: a row to insert is there already")
        version, counts = self.version + 1, {r.op: r["count"] for r in deltas.groupBy("op").count().collect()}
        return replace(self, rows=cut(apply_deltas(self.rows, deltas, list(self.key))), version=version, log=(*self.log, (version, counts))[-LOGGED:])


def apply_deltas(rows: DataFrame, deltas: DataFrame, key: list[str]) -> DataFrame:
    """`deltas`: the columns of rows, `op` (insert, update, delete) and `seq`; the last op of a key wins."""
    last = deltas.groupBy(*key).agg(F.max_by(F.struct(*[c for c in deltas.columns if c not in key]), "seq").alias("d"))
    new = last.where("d.op <> 'delete'").select(*key, *[F.col(f"d.{c}").alias(c) for c in rows.columns if c not in key])
    return rows.join(last.select(*key), key, "left_anti").unionByName(new.select(*rows.columns))


def row_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What turns `old` into `new`: op insert, update or delete with the key and the new values (the old
    ones for delete)."""
    values = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*values).alias("_old"))
    b = new.select(*key, F.struct(*values).alias("_new"))
    both = a.join(b, key, "full_outer")
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    out = both.withColumn("op", op).where("op is not null")
    return out.select("op", *key, *[F.when(F.col("op") == "delete", F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c) for c in values])


# --- aggregates over an event table --------------------------------------------------------------


@dataclass(frozen=True)
class AggregateView:
    """aggs: (function, column, alias) with function count, sum, avg, min or max; numeric inputs are
    doubles. `where`: an SQL condition on the source."""

    group_by: tuple[str, ...]
    aggs: tuple[tuple[str, str, str], ...]
    where: str | None = None

    def partial(self, events: DataFrame) -> DataFrame:
        """One row per group in mergeable form: an avg is kept as a sum and a count."""
        df = events.where(self.where) if self.where else events
        cols = []
        for f, c, alias in self.aggs:
            x = F.col(c).cast("double") if f != "count" and c != "*" else F.lit(1) if c == "*" else F.col(c)
            if f == "avg":
                cols += [F.sum(x).alias(f"{alias}__sum"), F.count(x).alias(f"{alias}__count")]
            else:
                cols.append(getattr(F, f)(x).alias(alias))
        return df.groupBy(*self.group_by).agg(*cols)

    def merged(self, *partials: DataFrame) -> DataFrame:
        """Partials of disjoint inputs as one: counts and sums add up, extremes meet."""
        df = partials[0]
        for p in partials[1:]:
            df = df.unionByName(p)
        cols = []
        for f, _, alias in self.aggs:
            if f == "avg":
                cols += [F.sum(f"{alias}__sum").alias(f"{alias}__sum"), F.sum(f"{alias}__count").alias(f"{alias}__count")]
            else:
                cols.append((F.sum if f in ("count", "sum") else getattr(F, f))(alias).alias(alias))
        return df.groupBy(*self.group_by).agg(*cols)

    def final(self, partial: DataFrame) -> DataFrame:
        """What the view shows."""
        return partial.select(*self.group_by, *[F.try_divide(F.col(f"{a}__sum"), F.col(f"{a}__count")).alias(a) if f == "avg" else F.col(a) for f, _, a in self.aggs])


def generation(rows: DataFrame, version: int, snapshot: int) -> DataFrame:
    """Rows as one generation of a view's table."""
    return rows.withColumn(VERSION, F.lit(version).cast("long")).withColumn(SNAPSHOT, F.lit(snapshot).cast("long")).withColumn(UPDATED, F.current_timestamp())


def latest(table: DataFrame) -> DataFrame:
    """The newest generation, without the internal columns. The maximum is one aggregate; with the table
    partitioned by version it prunes to one folder."""
    newest = table.agg(F.max(VERSION).alias("_newest"))
    return table.join(F.broadcast(newest), F.col(VERSION) == F.col("_newest")).drop("_newest", VERSION, SNAPSHOT, UPDATED)  # one row


def refresh_incremental(view: AggregateView, table: DataFrame | None, events: DataFrame, snapshot_col: str, upto: int) -> DataFrame | None:
    """The next generation from the last one and the events with snapshots in (last, upto]; None if there is
    nothing new. Without a generation: from all events up to `upto`."""
    head = table.agg(F.max(VERSION).alias("v"), F.max(SNAPSHOT).alias("s")).first() if table is not None else None
    if head is None or head["v"] is None:
        return generation(view.partial(events.where(F.col(snapshot_col) <= upto)), 1, upto)
    if head["s"] >= upto:
        return None
    delta = view.partial(events.where((F.col(snapshot_col) > head["s"]) & (F.col(snapshot_col) <= upto)))
    return generation(view.merged(latest(table), delta), head["v"] + 1, upto)


def retained(table: DataFrame, min_keep: int, not_older_than_days: int) -> DataFrame:
    """Generations that stay: the newest `min_keep` and all that are young enough."""
    versions = table.groupBy(VERSION).agg(F.max(UPDATED).alias("_at")).withColumn("_rank", F.row_number().over(Window.orderBy(F.col(VERSION).desc())))
    keep = versions.where((F.col("_rank") <= min_keep) | (F.col("_at") >= F.date_sub(F.current_date(), not_older_than_days))).select(VERSION)
    return table.join(keep, VERSION, "left_semi")


def retractable(changes: DataFrame, group: str, value: str, sign: str) -> DataFrame:
    """count, sum, min and max per group under insertions (+1) and deletions (-1). Each value's
    multiplicity is summed first, so an extreme that was deleted gives way to the next value."""
    multiset = changes.groupBy(group, value).agg(F.sum(sign).alias("m")).where("m > 0")
    return multiset.groupBy(group).agg(F.sum("m").alias("n"), F.sum(F.col(value) * F.col("m")).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
