"""Views over event tables as versioned Parquet tables, their refresh modes, and a scheduler for them."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views

DEFAULT_SECONDS = 60
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Mode:
    """kind: pull (a full refresh every `seconds`), push (an incremental refresh whenever there are new snapshots)
    or hybrid (both)."""

    kind: str = "pull"
    seconds: int = DEFAULT_SECONDS

    @classmethod
    def of(cls, text: str) -> Mode:
        """`push`, `hybrid[:seconds]`, `pull[:seconds]` or `scheduled[:seconds]`; anything else, and a number of
        seconds that isn't positive, is pull every 60 seconds."""
        kind, _, rest = text.strip().lower().partition(":")
        rest = rest.strip()
        seconds = int(rest) if rest.isdigit() and int(rest) > 0 else DEFAULT_SECONDS
        if kind in ("push", "hybrid"):
            return cls(kind, seconds)
        return cls("pull", seconds if kind in ("pull", "scheduled", "") else DEFAULT_SECONDS)


@dataclass
class EventView:
    """`query`: an AggregateView, kept up incrementally, or the text of an SQL query over the source's name."""

    name: str
    source: str
    query: views.AggregateView | str
    mode: Mode


@dataclass
class EventViews:
    """Event tables (with a `_snapshot` column) by name, and views whose generations are folders below
    `root`: the view's name, partitioned by version. A reader sees whole generations only."""

    spark: SparkSession
    root: str
    tables: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    held: dict[str, EventView] = field(default_factory=dict)
    made: set[str] = field(default_factory=set)

    def register_table(self, name: str, read: Callable[[], DataFrame]) -> None:
        """read: gives the table as it is when it is called."""
        self.tables[name] = read

    def create(self, name: str, source: str, query: views.AggregateView | str, mode: str = "pull") -> int:
        """The view with its first generation; returns that one's number of rows."""
        if name in self.held:
            raise ValueError(f"view {name} exists")
        self.held[name] = EventView(name, source, query, Mode.of(mode))
        return self.refresh(name)

    def drop(self, name: str) -> None:
        del self.held[name]
        self.made.discard(name)

    def listed(self) -> list[tuple[str, str, str]]:
        return sorted((v.name, v.source, v.mode.kind) for v in self.held.values())

    def _table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{name}") if name in self.made else None

    def _heads(self, v: EventView) -> tuple[int, int, int]:
        """(last version, its snapshot, the source's newest snapshot)."""
        table, newest = self._table(v.name), self.tables[v.source]().agg(F.max("_snapshot")).first()[0]
        head = table.agg(F.max(views.VERSION), F.max(views.SNAPSHOT)).first() if table is not None else (0, -1)
        return head[0] or 0, -1 if head[1] is None else head[1], -1 if newest is None else newest

    def _write(self, v: EventView, rows: DataFrame) -> int:
        rows.write.mode("append").partitionBy(views.VERSION).parquet(f"{self.root}/{v.name}")
        self.made.add(v.name)
        return self.rows(v.name).count()

    def refresh(self, name: str) -> int:
        """A new generation from the whole source; returns its number of rows."""
        v = self.held[name]
        version, _, newest = self._heads(v)
        source = self.tables[v.source]().where(F.col("_snapshot") <= newest)
        if isinstance(v.query, str):
            source.createOrReplaceTempView(v.source)
            rows = self.spark.sql(v.query)
        else:
            rows = v.query.partial(source)
        return self._write(v, views.generation(rows, version + 1, newest))

    def refresh_incremental(self, name: str) -> int:
        """A new generation from the last one and the new snapshots; 0, and nothing written, if there are none.
        An SQL view, whose text can't be merged, is computed from the whole source."""
        v = self.held[name]
        version, done, newest = self._heads(v)
        if newest <= done:
            return 0
        if isinstance(v.query, str) or not version:
            return self.refresh(name)
        rows = views.refresh_incremental(v.query, self._table(name), self.tables[v.source](), "_snapshot", newest)
        return self._write(v, rows)

    def rows(self, name: str) -> DataFrame:
        """The newest generation."""
        v, table = self.held[name], views.latest(self._table(name))
        return table if isinstance(v.query, str) else v.query.final(table)

    def start(self, scheduler: Scheduler, name: str, push_seconds: float = 1.0) -> None:
        """Refreshes by the view's mode from now on."""
        v = self.held[name]
        if v.mode.kind != "push":
            scheduler.schedule(name, lambda: self.refresh(name), v.mode.seconds)
        if v.mode.kind != "pull":
            scheduler.schedule(f"{name}:push", lambda: self.refresh_incremental(name), push_seconds)


class Scheduler:
    """Calls functions every so many seconds, each by a thread of its own; a call that fails is logged and the
    next one comes at its time."""

    def __init__(self) -> None:
        self.tasks: dict[str, threading.Event] = {}

    def schedule(self, name: str, call: Callable[[], object], seconds: float) -> None:
        """A task under a known name takes the old one's place. The first call comes after `seconds`."""
        self.cancel(name)
        stop = self.tasks[name] = threading.Event()

        def run() -> None:
            while not stop.wait(seconds):
                try:
                    call()
                except Exception:  # noqa: BLE001
                    log.exception("scheduled task %s", name)

        threading.Thread(target=run, name=f"weft-{name}", daemon=True).start()

    def cancel(self, name: str) -> None:
        stop = self.tasks.pop(name, None)
        if stop is not None:
            stop.set()

    def listed(self) -> list[str]:
        return sorted(self.tasks)

    def cancel_all(self) -> None:
        for name in self.listed():
            self.cancel(name)
