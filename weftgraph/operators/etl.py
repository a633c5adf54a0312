"""ETL rules, their functions, and the UDF pipelines."""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- functions ---------------------------------------------------------------------------------


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def parse_temp(s: Column) -> Column:
    return _or_null(F.regexp_extract(s, r"^\s*([-+]?\d+(?:\.\d+)?)\s*[^\d]*$", 1)).try_cast("double")


def parse_geo(s: Column) -> Column:
    p = F.split(s, ",")
    lat, lon = F.trim(F.get(p, F.lit(0))).try_cast("double"), F.trim(F.get(p, F.lit(1))).try_cast("double")
    return F.when((F.size(p) == 2) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def regex_extract(s: Column, pattern: str) -> Column:
    """Group 1 if the pattern has one, else the match; null without a match."""
    group = 1 if re.compile(pattern).groups else 0
    return F.when(F.rlike(s, F.lit(pattern)), F.regexp_extract(s, pattern, group))


def timestamp_parse(x: Column) -> Column:
    n = x.cast("string").try_cast("double")
    return F.coalesce(F.timestamp_micros((n * 1_000_000).cast("long")), F.try_to_timestamp(x.cast("string")))


def validate_email(s: Column) -> Column:
    """One @ with letters, digits and . _ % + - before it; after it letters, digits, . and -, ending in a dot
    that something precedes and at least two letters follow."""
    letters, digits = string.ascii_letters, string.digits
    only = lambda x, allowed: (F.length(x) > 0) & (F.length(F.translate(x, allowed, "")) == 0)
    parts = F.split(s, "@", -1)
    local, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    top = F.substring_index(domain, ".", -1)
    held = (F.size(parts) == 2) & only(local, letters + digits + "._%+-") & only(domain, letters + digits + ".-") & only(top, letters)
    return F.coalesce(held & (F.length(top) >= 2) & (F.length(domain) > F.length(top) + 1), F.lit(False))


#: Fixed value.
KM_PER_MILE = 1.60934


def _number(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def _scaled(x: Column, unit: Column, ways: dict[str, Callable[[Column], Column]]) -> Column:
    """`x` by the way that `unit` names; as it is for any other name."""
    out = x
    for name, way in ways.items():
        out = F.when(unit == name, way(x)).otherwise(out)
    return out


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "parse_temp": parse_temp,
    "parse_geo": parse_geo,
    "fahrenheit_to_celsius": lambda x: (x.cast("double") - 32) * 5 / 9,
    "parse_json": F.try_parse_json,
    "regex_extract": regex_extract,
    "base64_decode": lambda s: F.decode(F.try_to_binary(s, F.lit("base64")), "UTF-8"),
    "timestamp_parse": timestamp_parse,
    "validate_email": validate_email,
    "to_uppercase": F.upper,
    "to_lowercase": F.lower,
    # a missing number is 0, a missing text empty, a missing truth value false
    "speed_convert": lambda speed, unit: _scaled(_number(speed), unit, {"mph_to_kmh": lambda x: x * KM_PER_MILE, "kmh_to_mph": lambda x: x / KM_PER_MILE}),
    "temp_convert": lambda temp, to: _scaled(_number(temp), F.coalesce(to, F.lit("f")), {"f": lambda x: x * 9 / 5 + 32, "c": lambda x: (x - 32) * 5 / 9}),
    "to_upper": lambda s: F.upper(F.coalesce(s, F.lit(""))),
    "length": lambda s: F.coalesce(F.octet_length(s), F.lit(0)),
    "not": lambda b: ~F.coalesce(b, F.lit(False)),
}

# --- rules -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """kind: required, range (args least, most), regex (pattern), type (Spark type name)."""

    field: str
    kind: str
    args: tuple = ()

    def column(self) -> Column:
        x = F.col(self.field)
        if self.kind == "required":
            return x.isNotNull()
        if self.kind == "range":
            return F.coalesce(x.try_cast("double").between(*self.args), F.lit(False))
        if self.kind == "regex":
            return F.coalesce(F.rlike(x.cast("string"), F.lit(self.args[0])), F.lit(False))
        if self.kind == "type":
            return x.isNull() | x.try_cast(self.args[0]).isNotNull()
        raise ValueError(f"unknown check {self.kind!r}")


@dataclass(frozen=True)
class Mapping:
    """A target field from a source field, through one of FUNCTIONS if named."""

    source: str
    target: str
    function: str | None = None
    args: tuple = ()


@dataclass
class Pipeline:
    """where -> map -> validate -> enrich, each optional. Rows that fail a check go to `rejected`; with
    on_error 'halt' the first such row fails the job."""

    where: str | Column | None = None
    mappings: list[Mapping] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)
    enrich: dict[str, Column] = field(default_factory=dict)
    on_error: str = "skip"

    def run(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        if self.where is not None:
            df = df.where(self.where)
        if self.mappings:
            df = df.select(*[(FUNCTIONS[m.function](F.col(m.source), *m.args) if m.function else F.col(m.source)).alias(m.target) for m in self.mappings])
        ok = F.lit(True)
        for c in self.checks:
            ok = ok & c.column()
        if self.on_error == "halt" and self.checks:
            good = df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a row fails a check")).cast("boolean")))
            bad = df.limit(0)
        else:
            good, bad = df.where(ok), df.where(~ok)
        return (good.withColumns(self.enrich) if self.enrich else good), bad


def rendered_statement(df: DataFrame, template: str) -> Column:
    """An output statement for each row: `{field}` (or `'{field}'`) becomes the field's literal. Texts are
    quoted with \\ and ' escaped, so a value can't end its literal; numbers and truth values stand as they are;
    lists, maps and structs are quoted JSON; a null is null. A name that is no field stays."""
    kinds, parts, at = {f.name: f.dataType.simpleString() for f in df.schema}, [], 0

    def quoted(x: Column) -> Column:
        return F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))

    for m in re.finditer(r"'\{(\w+)\}'|\{(\w+)\}", template):
        name = m[1] or m[2]
        if name not in kinds:
            continue
        x, kind = F.col(name), kinds[name]
        if kind in ("boolean", "float", "double") or kind.endswith("int") or kind.startswith("decimal"):
            text = x.cast("string")
        else:
            text = quoted(F.to_json(x) if kind.startswith(("array", "map", "struct")) else x.cast("string"))
        parts += [F.lit(template[at : m.start()]), F.coalesce(text, F.lit("null"))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


@dataclass
class Rules:
    """Named pipelines. A stream's foreachBatch asks for them anew with each batch, so a rule that is added,
    replaced or removed takes effect with the next one, without a restart."""

    held: dict[str, tuple[int, Pipeline]] = field(default_factory=dict)

    def register(self, name: str, pipeline: Pipeline) -> int:
        version = self.held[name][0] + 1 if name in self.held else 1
        self.held[name] = (version, pipeline)
        return version

    def remove(self, name: str) -> None:
        del self.held[name]

    def listed(self) -> list[tuple[str, int]]:
        return sorted((n, v) for n, (v, _) in self.held.items())

    def load(self, text: str | dict) -> list[str]:
        """Rules from JSON: {name: {where, mappings: [{source, target, function, args}], checks: [{field, kind,
        args}], enrich: {name: expression}, on_error}}. Returns the names whose rules changed."""
        spec = json.loads(text) if isinstance(text, str) else text
        changed = []
        for name, r in spec.items():
            p = Pipeline(r.get("where"), [Mapping(m["source"], m["target"], m.get("function"), tuple(m.get("args", ()))) for m in r.get("mappings", [])], [Check(c["field"], c["kind"], tuple(c.get("args", ()))) for c in r.get("checks", [])], {k: expression(x) for k, x in r.get("enrich", {}).items()}, r.get("on_error", "skip"))
            if name not in self.held or str(self.held[name][1]) != str(p):
                self.register(name, p)
                changed.append(name)
        return changed

    def batch(self, name: str, write: Callable[[DataFrame, DataFrame], None]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: write(good, rejected) of the rule as it is when the batch runs."""
        return lambda df, _: write(*self.held[name][1].run(df))


# --- expression functions ------------------------------------------------------------------------

_EXPR = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|'([^']*)'|(<=|>=|==|!=|&&|\|\||[-+*/<>]))")


def expression(text: str) -> Column:
    """`+ - * /`, comparisons, `&&` and `||` over fields, without parentheses. Comparisons stand on the
    level of + and -: a + 1 > b - 1 is ((a + 1) > b) - 1, as the language has it."""
    toks, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _EXPR.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        toks.append(m)
        at = m.end()
    pos = 0

    def op(*ops: str) -> str | None:
        nonlocal pos
        if pos < len(toks) and toks[pos][4] in ops:
            pos += 1
            return toks[pos - 1][4]
        return None

    def leaf() -> Column:
        nonlocal pos
        if op("-"):
            return -leaf()
        if pos >= len(toks) or toks[pos][4]:
            raise ValueError("an operand is missing")
        m = toks[pos]
        pos += 1
        return F.lit(float(m[1])) if m[1] else F.col(m[2]) if m[2] else F.lit(m[3])

    binary = {"+": "__add__", "-": "__sub__", "*": "__mul__", "/": "__truediv__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "==": "__eq__", "!=": "__ne__"}

    def level(ops: tuple, deeper: Callable[[], Column]) -> Column:
        left = deeper()
        while o := op(*ops):
            left = getattr(left, binary[o])(deeper())
        return left

    def product() -> Column:
        return level(("*", "/"), leaf)

    def total() -> Column:
        return level(("+", "-", "<", "<=", ">", ">=", "==", "!="), product)

    def both() -> Column:
        left = total()
        while op("&&"):
            left = left & total()
        return left

    out = both()
    while op("||"):
        out = out | both()
    if pos < len(toks):
        raise ValueError(f"unexpected {toks[pos][0]!r}")
    return out


# --- named functions and pipelines of them ---------------------------------------------------------


@dataclass
class Functions:
    """Named functions over rows: built-in expressions first, Python functions (dict -> value) where
    nothing else will do; those run as Arrow batches, never row by row through pickle."""

    spark: SparkSession
    held: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def register(self, name: str, build: Callable[..., Column]) -> None:
        self.held[name] = build

    def register_expression(self, name: str, text: str) -> None:
        self.held[name] = lambda: expression(text)

    def register_python(self, name: str, f: Callable[[dict], Any], columns: list[str], kind: str = "string", *, timeout_s: float = 30.0, max_bytes: int = 1 << 20) -> None:
        """f: a row's columns as a dictionary -> value. Rows come in Arrow batches; a row that takes longer
        than `timeout_s`, or whose text is over `max_bytes`, fails the job."""

        def one(r: dict) -> Any:
            x = f(r)
            if isinstance(x, (str, bytes)) and len(x) > max_bytes:
                raise ValueError(f"{name}: a result of {len(x)} is over {max_bytes}")
            return x

        @F.pandas_udf(kind)
        def batch(rows: pd.DataFrame) -> pd.Series:
            import signal

            def late(*_: Any) -> None:
                raise TimeoutError(f"{name}: a row took over {timeout_s} s")

            old, out = signal.signal(signal.SIGALRM, late), []
            try:
                for r in rows.to_dict("records"):
                    signal.setitimer(signal.ITIMER_REAL, timeout_s)
                    out.append(one(r))
            finally:
                signal.setitimer(signal.ITIMER_REAL, 0)
                signal.signal(signal.SIGALRM, old)
            return pd.Series(out)

        self.held[name] = lambda: batch(F.struct(*columns))

    def unregister(self, name: str) -> None:
        del self.held[name]

    def names(self) -> list[str]:
        return sorted(self.held)

    def apply(self, name: str, *args: Column) -> Column:
        return self.held[name](*args)


def udf_pipeline(df: DataFrame, filters: list[Column], maps: dict[str, Column], enrich: dict[str, Column]) -> DataFrame:
    """filter -> map (each result under its name) -> enrich."""
    for f in filters:
        df = df.where(f)
    return df.withColumns(maps).withColumns(enrich) if enrich else df.withColumns(maps)


def aggregate_pipeline(df: DataFrame, by: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """aggs: alias -> (count, sum, avg, min or max; column). Empty avg, min and max are 0.0."""
    cols = []
    for alias, (f, c) in aggs.items():
        x = F.count(c) if f == "count" else getattr(F, f)(F.col(c).cast("double"))
        cols.append((x if f == "count" else F.coalesce(x, F.lit(0.0))).alias(alias))
    return df.groupBy(*by).agg(*cols)
