"""Chat formatting by a template compiler.

A small, sandboxed template language is parsed into a syntax tree, constants are folded, and the tree
becomes nested Python closures, generators that render a conversation turn by turn. There is no
attribute access beyond a message's `role` and `text`, no calls but the listed filters and no way to
reach Python objects, so a template can't do anything but produce text.

    {{ expression }}                         output
    {% for m in messages %} ... {% endfor %} over the turns; loop.first, loop.index0 inside
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %} what is rendered inside is under the loss mask
    {# comment #}
Expressions: 'text', 12, true, false, names, m.role, m.text, ==, !=, +, and, or, not, ( ), and filters
e | upper, e | lower, e | trim, e | escape.

`escape` makes control strings inside texts harmless and is undone by `unescape`: every backslash
becomes \\\\ and every "<|" becomes "<\\|", so escaped text never holds "<|".

Rows are put together by conv_id and sorted by (turn, role, text) inside partitions, and rendered as
they stream by: no conversation is held as a whole, and output comes in chunks of about CHUNK
characters (cut between segments, so a text is never split) with the spans of the loss mask in each.
Null role or text: empty. Rows with a null conv_id are one conversation. A conversation of any number of
turns is rendered by one task, in the order that it has, a text at a time. Rows with equal conv_id
and turn all count. An empty table gives no rows. Extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

CHUNK = 1 << 18
#: The production template: every role is written between its marks, assistants' texts are learnt.
TEMPLATE = "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>{% endfor %}"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|\|)", r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "escape": escape}


class TemplateError(ValueError):
    """The template is malformed or asks for something outside the language."""


# --- syntax tree -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body) pairs; the last condition may be Const(True)


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parser ------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(==|!=|[+|()]))")


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def word(self) -> str | None:
        return (m[3] or m[4]) if self.at < len(self.tokens) and (m := self.tokens[self.at]) else None

    def take(self, *words: str) -> str | None:
        w = self.word()
        if w in words:
            self.at += 1
            return w
        return None

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][0]!r}")
        return out

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.sum()
        while op := self.take("==", "!="):
            left = Op(op, (left, self.sum()))
        return left

    def sum(self):
        left = self.filtered()
        while self.take("+"):
            left = Op("+", (left, self.filtered()))
        return left

    def filtered(self):
        value = self.primary()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = Op(f"|{name}", (value,))
        return value

    def primary(self):
        if self.take("("):
            value = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        m = self.tokens[self.at]
        self.at += 1
        if m[1] is not None:
            return Const(re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1][1:-1]))
        if m[2] is not None:
            return Const(int(m[2]))
        if m[3] in ("true", "false"):
            return Const(m[3] == "true")
        if m[3] is None:
            raise TemplateError(f"unexpected {m[0]!r}")
        path = tuple(m[3].split("."))
        if len(path) == 2 and path[1] not in ("role", "text", "first", "index0"):
            raise TemplateError(f"no field {m[3]!r}")
        return Name(path)


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pos = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal pos
        body = []
        while pos < len(pieces):
            kind, value = pieces[pos]
            pos += 1
            if kind == "text":
                body.append(Text(value))
            elif kind == "out":
                body.append(Output(_Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(body), value
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                    if not m:
                        raise TemplateError(f"only 'for NAME in messages': {value!r}")
                    body.append(For(m[1], block("endfor")[0]))
                elif word == "generation":
                    body.append(Generation(block("endgeneration")[0]))
                elif word == "if":
                    branches, condition = [], _Expression(rest).whole()
                    while True:
                        inner, end = block("elif", "else", "endif")
                        branches.append((condition, inner))
                        if end.startswith("elif"):
                            condition = _Expression(end[4:]).whole()
                        elif end == "else":
                            branches.append((Const(True), block("endif")[0]))
                            break
                        else:
                            break
                    body.append(If(tuple(branches)))
                else:
                    raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(body), ""

    return block()[0]


# --- constant folding --------------------------------------------------------------------------

_OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b if type(a) is type(b) is int else _shown(a) + _shown(b), "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b}
_OPS |= {f"|{k}": (lambda f: lambda a: f(_shown(a)))(f) for k, f in FILTERS.items()}


def _shown(x: Any) -> str:
    return x if isinstance(x, str) else "true" if x is True else "false" if x is False else "" if x is None else str(x)


def folded(node):
    """The node with constant expressions computed, dead branches gone and neighbouring texts joined."""
    if isinstance(node, Op):
        args = tuple(map(folded, node.args))
        return Const(_OPS[node.name](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.name, args)
    if isinstance(node, Output):
        value = folded(node.value)
        return Text(_shown(value.value)) if isinstance(value, Const) else Output(value)
    if isinstance(node, For):
        return For(node.name, folded(node.body))
    if isinstance(node, Generation):
        return Generation(folded(node.body))
    if isinstance(node, If):
        kept = []
        for condition, body in node.branches:
            condition = folded(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            kept.append((condition, folded(body)))
            if isinstance(condition, Const):
                break
        if not kept:
            return Text("")
        return kept[0][1] if isinstance(kept[0][0], Const) else If(tuple(kept))
    if isinstance(node, tuple):
        out: list = []
        for x in map(folded, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + y.value)
                elif y != Text(""):
                    out.append(y)
        return tuple(out)
    return node


# --- closures ----------------------------------------------------------------------------------

Segment = tuple[str, bool]  # text, whether it is under the loss mask


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        if len(node.path) == 1:
            def plain(env, name=node.path[0]):
                if not isinstance(env.get(name, _MISSING), (str, int, bool)):
                    raise TemplateError(f"{name!r} has no value here")
                return env[name]
            return plain
        owner, key = node.path

        def item(env):
            if not isinstance(env.get(owner), dict) or key not in env[owner]:
                raise TemplateError(f"{owner}.{key} has no value here")
            return env[owner][key]
        return item
    args = [_value(a) for a in node.args]
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    f = _OPS[node.name]
    return lambda env: f(*(a(env) for a in args))


_MISSING = object()


def _body(nodes: tuple, learnt: bool) -> Callable[[dict], Iterator[Segment]]:
    steps = [_step(n, learnt) for n in nodes]

    def run(env):
        for s in steps:
            yield from s(env)
    return run


def _step(node, learnt: bool) -> Callable[[dict], Iterator[Segment]]:
    if isinstance(node, Text):
        return lambda env, s=((node.value, learnt),): iter(s)
    if isinstance(node, Output):
        value = _value(node.value)

        def show(env):
            yield _shown(value(env)), learnt
        return show
    if isinstance(node, Generation):
        return _body(node.body, True)
    if isinstance(node, If):
        branches = [(_value(c), _body(b, learnt)) for c, b in node.branches]

        def choose(env):
            for c, b in branches:
                if c(env):
                    yield from b(env)
                    return
        return choose
    body, name = _body(node.body, learnt), node.name

    def loop(env):
        for i, m in enumerate(env["messages"]):
            yield from body({**env, "messages": (), name: m, "loop": {"first": i == 0, "index0": i}})
    return loop


def compiled(source: str) -> Callable[[Iterable[dict]], Iterator[Segment]]:
    """A renderer: takes the messages ({role, text}) one by one and yields segments one by one."""
    run = _body(folded(parse(source)), False)
    return lambda messages: run({"messages": messages})


# --- the operator ------------------------------------------------------------------------------

CHUNKS = "conv_id long, chunk long, text string, spans array<struct<start:long,stop:long>>, last boolean"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Runs of rows with one first column, as (key, iterator of rows); one row is held at a time."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    held = next(rows, None)
    while held is not None:
        key = held[0]

        def run():
            nonlocal held
            while held is not None and held[0] == key:
                row, held = held, None
                yield row
                held = next(rows, None)

        own = run()
        yield key, own
        for _ in own:  # what a template left unread
            pass


def format_conversations(df: DataFrame, template: str = TEMPLATE, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """CHUNKS: the rendered conversations in chunks, in order within each partition. `spans` are the
    code points of the chunk's text that are under the loss mask; a span ends with its chunk."""
    compiled(template)  # errors show on the driver

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compiled(template)

        def chunk(key, n, parts, spans, last):
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([n], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([last], pa.bool_())], ["conv_id", "chunk", "text", "spans", "last"])

        for key, rows in _grouped(batches):
            n, parts, spans, size = 0, [], [], 0
            for piece, learnt in run({"role": r or "", "text": t or ""} for _, r, t in rows):
                if not piece and not learnt:
                    continue
                if learnt:
                    spans.append({"start": size, "stop": size + len(piece)})
                parts.append(piece)
                size += len(piece)
                if size >= CHUNK:
                    yield chunk(key, n, parts, spans, False)
                    n, parts, spans, size = n + 1, [], [], 0
            yield chunk(key, n, parts, spans, True)

    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return map_batches(rows, render, CHUNKS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(r"<\|turn\|>((?:(?!<\|).)*)<\|text\|>((?:(?!<\|).)*)<\|end\|>", re.S)


def read_back(chunks: DataFrame) -> DataFrame:
    """DIGEST of what `format_conversations` wrote with TEMPLATE, parsed from the chunks alone: turns
    are found by their marks and unescaped; loss text is what the spans say, unescaped. The chunks
    must still be in their partitions' order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches):
            turns, loss, n, chars, formatted, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, []
            for _, _, text, spans, last in rows:
                formatted += len(text)
                rest.append(text)
                if "<|end|>" in rest[-1] or last:
                    whole, at = "".join(rest), 0
                    for m in _TURN.finditer(whole):
                        if m.start() != at:
                            raise ValueError(f"conversation {key}: text outside turns")
                        turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                        n, at = n + 1, m.end()
                    rest = [whole[at:]]
                for s in spans:  # a text is never cut between chunks
                    plain = unescape(text[s["start"] : s["stop"]])
                    chars += len(plain)
                    loss.update(plain.encode("utf-8", "surrogatepass"))
            if "".join(rest):
                raise ValueError(f"conversation {key}: unfinished turn")
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([formatted], pa.int64())], [x.split()[0] for x in DIGEST.split(", ")])

    return map_batches(chunks, read, DIGEST)
