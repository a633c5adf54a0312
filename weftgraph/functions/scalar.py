"""Scalar and aggregate functions of the Cypher surface, as built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _split(s: Column, d: Column) -> Column:
    """Literal delimiter; Spark's own takes a regex."""
    return F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")))


def _substring(s: Column, start: Column, n: Column | None = None) -> Column:
    """0-based start."""
    return F.substr(s, start + 1, n) if n is not None else F.substr(s, start + 1)


def _range(lo: Column, hi: Column, step: Column | None = None) -> Column:
    step = F.lit(1) if step is None else step
    empty = F.array().cast("array<bigint>")
    return F.when((step > 0) & (lo > hi) | (step < 0) & (lo < hi), empty).otherwise(F.sequence(lo.cast("long"), hi.cast("long"), step.cast("long")))


def _to_boolean(c: Column) -> Column:
    return F.when(F.lower(c.cast("string")).isin("true", "false"), F.lower(c.cast("string")) == "true")


def time_window_bucket(ts: Column, size: Column) -> Column:
    """Start of the window of `size` that holds `ts`; floors for negative times as well."""
    return ts - F.pmod(ts, size)


#: name -> (least and most number of arguments, builder)
SCALAR: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "tostring": (1, 1, lambda x: x.cast("string")),
    "tointeger": (1, 1, lambda x: _to_integer(x)),
    "tofloat": (1, 1, lambda x: x.cast("double")),
    "toboolean": (1, 1, _to_boolean),
    "toupper": (1, 1, F.upper), "upper": (1, 1, F.upper),
    "tolower": (1, 1, F.lower), "lower": (1, 1, F.lower),
    "trim": (1, 1, _trim),
    "ltrim": (1, 1, lambda x: F.regexp_replace(x, r"^\s+", "")),
    "rtrim": (1, 1, lambda x: F.regexp_replace(x, r"\s+$", "")),
    "substring": (2, 3, _substring),
    "left": (2, 2, lambda s, n: F.substr(s, F.lit(1), n)),
    "right": (2, 2, lambda s, n: F.right(s, n)),
    "replace": (3, 3, F.replace),
    "split": (2, 2, _split),
    "coalesce": (1, 99, F.coalesce),
    "abs": (1, 1, F.abs), "ceil": (1, 1, lambda x: F.ceil(x).cast("double")), "floor": (1, 1, lambda x: F.floor(x).cast("double")),
    "round": (1, 2, lambda x, n=None: F.round(x) if n is None else F.round(x, n)),
    "sqrt": (1, 1, F.sqrt), "sign": (1, 1, lambda x: F.signum(x).cast("long")),
    "sin": (1, 1, F.sin), "cos": (1, 1, F.cos), "tan": (1, 1, F.tan), "asin": (1, 1, F.asin), "acos": (1, 1, F.acos), "atan": (1, 1, F.atan), "atan2": (2, 2, F.atan2),
    "exp": (1, 1, F.exp), "log": (1, 1, F.ln), "log10": (1, 1, F.log10), "pow": (2, 2, F.pow), "rand": (0, 0, F.rand),
    "head": (1, 1, lambda x: F.get(x, F.lit(0))),
    "last": (1, 1, lambda x: F.get(x, F.size(x) - 1)),
    "tail": (1, 1, lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(0)))),
    "range": (2, 3, _range),
    "date": (1, 1, F.to_date), "datetime": (1, 1, F.to_timestamp),
    "timestamp": (0, 1, lambda x=None: F.unix_millis(F.current_timestamp() if x is None else x)),
    "time": (1, 1, lambda x: F.date_format(F.to_timestamp(x), "HH:mm:ss")),
    "duration": (1, 1, lambda x: x.cast("interval")),
    "time_window_bucket": (2, 2, time_window_bucket),
    "keys": (1, 1, F.map_keys),
}

def _to_integer(x: Column) -> Column:
    """Fractions are cut off, booleans are 0 and 1, and a string that isn't a number is an error."""
    s = F.lower(F.trim(x.cast("string")))
    whole = F.when(s.rlike(r"^[-+]?\d+$"), s).cast("long")
    return F.when(s == "true", F.lit(1).cast("long")).when(s == "false", F.lit(0).cast("long")).otherwise(F.coalesce(whole, s.cast("double").cast("long")))


def aggregate(name: str, args: list[Column], distinct: bool, p: float | None = None) -> Column:
    """An aggregate of the language; p: the fraction of a percentile (0.5 if the call names none)."""
    x = args[0] if args else F.lit(1)
    if name == "count":
        return F.count_distinct(x) if distinct else F.count(x)
    if name == "sum":
        return F.sum_distinct(x) if distinct else F.sum(x)
    if name == "avg":
        return F.expr("avg(1)") if not args else (F.sum_distinct(x) / F.count_distinct(x) if distinct else F.avg(x))
    if name in ("min", "max"):
        return F.min(x) if name == "min" else F.max(x)
    if name == "collect":  # nulls are kept, in a struct's shell
        held = F.struct(x.alias("v"))
        return F.transform(F.collect_set(held) if distinct else F.collect_list(held), lambda s: s["v"])
    if name == "stdev":
        return F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))).otherwise(F.lit(0.0))
    if name == "stdevp":
        return F.coalesce(F.stddev_pop(x), F.lit(0.0))
    return F.percentile(x, 0.5 if p is None else p)
