"""Event-time windows on streams. The watermark's delay is out-of-orderness plus allowed lateness: in
append mode a window then comes out exactly when no accepted event can change it any more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_millis(text: str) -> int:
    unit = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    n, u = text.split()
    return int(n) * unit[u.rstrip("s")]


def _delay(*parts: str) -> str:
    """'10 seconds', '5 seconds' -> '15000 milliseconds'."""
    return f"{sum(map(in_millis, parts))} milliseconds"


def watermarked(df: DataFrame, ts: str, out_of_orderness: str = "0 seconds", lateness: str = "0 seconds") -> DataFrame:
    return df.withWatermark(ts, _delay(out_of_orderness, lateness))


def tumbling_stream(df: DataFrame, ts: str, value: str, size: str, out_of_orderness: str = "0 seconds", lateness: str = "0 seconds", slide: str | None = None) -> DataFrame:
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = watermarked(df, ts, out_of_orderness, lateness).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total", "least", "most")


def session_stream(df: DataFrame, ts: str, gap: str, by: str, delay: str = "0 seconds") -> DataFrame:
    return df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(df: DataFrame, key: list[str], ts: str, within: str) -> DataFrame:
    """At most one event per key inside the watermark: requests that are sent again count once."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)


def joined_streams(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str = "10 seconds") -> DataFrame:
    """Events of both streams with one key whose times lie within `within` (state is bounded by it)."""
    l, r = left.withWatermark(left_ts, delay).alias("l"), right.withWatermark(right_ts, delay).alias("r")  # noqa: E741
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & F.expr(f"r.{right_ts} BETWEEN l.{left_ts} - INTERVAL {within} AND l.{left_ts} + INTERVAL {within}")
    return l.join(r, on)
