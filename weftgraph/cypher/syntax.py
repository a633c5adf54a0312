"""Tokens, tree and recursive-descent parser of the Cypher subset, with $param binding added."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..catalog import AnyOf

MAX_DEPTH = 128


class CypherError(ValueError):
    """The text isn't a query of the supported language."""


# --- tree --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Un:
    op: str
    arg: Any


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Case:
    subject: Any
    whens: tuple
    default: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple  # (key, expression)


@dataclass(frozen=True)
class Comprehension:
    var: str
    source: Any
    where: Any
    result: Any


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Exists:
    parts: tuple
    where: Any


@dataclass(frozen=True)
class NodeP:
    var: str | None
    labels: tuple = ()
    props: tuple = ()


@dataclass(frozen=True)
class EdgeP:
    var: str | None
    types: tuple = ()
    direction: str = "out"  # out, in, both
    length: tuple | None = None  # (min, max or None)
    props: tuple = ()


@dataclass(frozen=True)
class Path:
    var: str | None
    nodes: tuple
    edges: tuple


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str


@dataclass
class Match:
    parts: list
    where: Any = None
    optional: bool = False


@dataclass
class Project:
    items: list
    star: bool = False
    distinct: bool = False
    where: Any = None
    order: list = field(default_factory=list)  # (expression, descending)
    skip: Any = None
    limit: Any = None
    final: bool = True


@dataclass
class Unwind:
    expr: Any
    var: str


@dataclass
class CallQuery:
    query: Any


@dataclass
class LoadCsv:
    path: str
    var: str
    headers: bool


@dataclass
class Create:
    parts: list


@dataclass
class Merge:
    part: Path
    on_create: list = field(default_factory=list)
    on_match: list = field(default_factory=list)


@dataclass
class SetItems:
    items: list  # ("prop", var, key, e) | ("map", var, e) | ("label", var, label)


@dataclass
class RemoveItems:
    items: list  # ("prop", var, key) | ("label", var, label)


@dataclass
class Delete:
    names: list
    detach: bool


@dataclass
class Query:
    branches: list  # lists of clauses
    alls: list  # for each UNION, whether it is UNION ALL


# --- tokens ------------------------------------------------------------------------------------

_SPEC = re.compile(
    r"(?P<skip>\s+|//[^\n]*|--[^\n]*|/\*.*?\*/)|(?P<num>\d+\.(?!\.)\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<name>[^\W\d]\w*)|`(?P<quoted>[^`]+)`|\$(?P<param>\w+)|(?P<op><>|<=|>=|=~|\+=|==|!=|\.\.|<-|->|[-+*/%=<>()\[\]{},:;.|^])",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _SPEC.match(source, at)
        if not m:
            raise CypherError(f"can't read {source[at : at + 20]!r} at {at}")
        kind = m.lastgroup
        if kind == "str":
            out.append(Token("str", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m["str"][1:-1], flags=re.S), at))
        elif kind != "skip":
            text = m[kind]
            out.append(Token("name" if kind == "quoted" else kind, {"==": "=", "!=": "<>"}.get(text, text) if kind == "op" else text, at) if kind != "quoted" else Token("quoted", text, at))
        at = m.end()
    return [*out, Token("end", "", at)]


def split_as_of(source: str) -> tuple[str, str | None]:
    """(the query without its AS OF, the literal after it): AS OF <number or string> outside of strings and
    comments, at most once."""
    toks = tokens(source)
    for a, b, c in zip(toks, toks[1:], toks[2:], strict=False):
        if a.kind == b.kind == "name" and (a.text.upper(), b.text.upper()) == ("AS", "OF") and c.kind in ("num", "str"):
            end = next(t.at for t in toks if t.at > c.at)
            return source[: a.at] + source[end:], c.text
    return source, None


AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}
_CLAUSES = {"MATCH", "OPTIONAL", "WITH", "RETURN", "UNWIND", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH", "CALL", "LOAD", "UNION", "WHERE", "ORDER", "SKIP", "LIMIT", "ON"}


class Parser:
    def __init__(self, source: str):
        self.source, self.toks, self.i, self.depth = source, tokens(source), 0, 0

    # helpers
    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def is_kw(self, *words: str) -> bool:
        return all(self.peek(k).kind == "name" and self.peek(k).text.upper() == w for k, w in enumerate(words))

    def kw(self, *words: str) -> bool:
        if self.is_kw(*words):
            self.i += len(words)
            return True
        return False

    def op(self, *ops: str) -> str | None:
        if self.tok.kind == "op" and self.tok.text in ops:
            self.i += 1
            return self.toks[self.i - 1].text
        return None

    def need(self, what: str) -> None:
        if not (self.op(what) or self.kw(what)):
            raise CypherError(f"expected {what} at {self.tok.at}, found {self.tok.text!r}")

    def name(self) -> str:
        if self.tok.kind not in ("name", "quoted"):
            raise CypherError(f"expected a name at {self.tok.at}, found {self.tok.text!r}")
        self.i += 1
        return self.toks[self.i - 1].text

    # clauses
    def query(self, closing: str | None = None) -> Query:
        branches, alls = [self.clauses(closing)], []
        while self.kw("UNION"):
            alls.append(self.kw("ALL"))
            branches.append(self.clauses(closing))
        self.op(";")
        if closing is None and self.tok.kind != "end":
            raise CypherError(f"unexpected {self.tok.text!r} at {self.tok.at}")
        return Query(branches, alls)

    def clauses(self, closing: str | None) -> list:
        out = []
        while self.tok.kind != "end" and not self.is_kw("UNION") and not (self.tok.kind == "op" and self.tok.text in (closing, ";")):
            out.append(self.clause())
        if not out:
            raise CypherError("empty query")
        return out

    def clause(self):
        if self.kw("OPTIONAL", "MATCH"):
            return Match(self.parts(), self.expr() if self.kw("WHERE") else None, True)
        if self.kw("MATCH"):
            return Match(self.parts(), self.expr() if self.kw("WHERE") else None)
        if self.kw("WITH"):
            return self.projection(False)
        if self.kw("RETURN"):
            return self.projection(True)
        if self.kw("UNWIND"):
            e = self.expr()
            self.need("AS")
            return Unwind(e, self.name())
        if self.kw("CALL"):
            self.need("{")
            q = self.query("}")
            self.need("}")
            return CallQuery(q)
        if self.kw("LOAD", "CSV"):
            headers = self.kw("WITH", "HEADERS")
            self.need("FROM")
            if self.tok.kind != "str":
                raise CypherError("LOAD CSV needs a quoted path")
            path = self.tok.text
            self.i += 1
            self.need("AS")
            return LoadCsv(path, self.name(), headers)
        if self.kw("CREATE"):
            return Create(self.parts())
        if self.kw("MERGE"):
            out = Merge(self.part())
            while self.kw("ON"):
                target = out.on_create if self.kw("CREATE") else out.on_match if self.kw("MATCH") else None
                if target is None:
                    raise CypherError("expected ON CREATE or ON MATCH")
                self.need("SET")
                target.extend(self.set_items())
            return out
        if self.kw("SET"):
            return SetItems(self.set_items())
        if self.kw("REMOVE"):
            items = []
            while True:
                v = self.name()
                items.append(("prop", v, self.name()) if self.op(".") else ("label", v, self.label()))
                if not self.op(","):
                    return RemoveItems(items)
        detach = self.kw("DETACH")
        if self.kw("DELETE"):
            names = [self.name()]
            while self.op(","):
                names.append(self.name())
            return Delete(names, detach)
        raise CypherError(f"unexpected {self.tok.text!r} at {self.tok.at}")

    def label(self) -> str:
        self.need(":")
        return self.name()

    def set_items(self) -> list:
        out = []
        while True:
            v = self.name()
            if self.op("."):
                k = self.name()
                self.need("=")
                out.append(("prop", v, k, self.expr()))
            elif self.op("+="):
                out.append(("map", v, self.expr()))
            else:
                out.append(("label", v, self.label()))
            if not self.op(","):
                return out

    def projection(self, final: bool) -> Project:
        out = Project([], final=final, distinct=self.kw("DISTINCT"))
        if self.op("*"):
            out.star = True
            if self.op(","):
                out.items = self.items()
        else:
            out.items = self.items()
        if not final and self.kw("WHERE"):
            out.where = self.expr()
        if self.kw("ORDER", "BY"):
            while True:
                e = self.expr()
                desc = self.kw("DESC") or self.kw("DESCENDING")
                if not desc:
                    self.kw("ASC") or self.kw("ASCENDING")
                out.order.append((e, desc))
                if not self.op(","):
                    break
        if self.kw("SKIP"):
            out.skip = self.expr()
        if self.kw("LIMIT"):
            out.limit = self.expr()
        if not final and out.where is None and self.kw("WHERE"):
            out.where = self.expr()
        return out

    def items(self) -> list[Item]:
        out = []
        while True:
            start = self.tok.at
            e = self.expr()
            text = self.source[start : self.toks[self.i - 1].at + len(self.toks[self.i - 1].text)].strip()
            out.append(Item(e, self.name() if self.kw("AS") else e.name if isinstance(e, Var) else text))
            if not self.op(","):
                return out

    # patterns
    def parts(self) -> list[Path]:
        out = [self.part()]
        while self.op(","):
            out.append(self.part())
        return out

    def part(self) -> Path:
        var = None
        if self.tok.kind in ("name", "quoted") and self.peek().text == "=":
            var = self.name()
            self.need("=")
        nodes, edges = [self.node()], []
        while self.tok.kind == "op" and self.tok.text in ("-", "<-"):
            edges.append(self.edge())
            nodes.append(self.node())
        return Path(var, tuple(nodes), tuple(edges))

    def node(self) -> NodeP:
        self.need("(")
        var = self.name() if self.tok.kind in ("name", "quoted") else None
        labels, kind = [], tuple
        while self.op(":"):
            labels.append(self.name())
            while self.op("|"):
                labels.append(self.name())
                kind = AnyOf
        props = self.map_items() if self.op("{") else ()
        self.need(")")
        return NodeP(var, kind(labels), props)

    def edge(self) -> EdgeP:
        left = self.op("<-", "-") == "<-"
        var, types, length, props = None, [], None, ()
        if self.op("["):
            var = self.name() if self.tok.kind in ("name", "quoted") else None
            if self.op(":"):
                types.append(self.name())
                while self.op("|"):
                    self.op(":")
                    types.append(self.name())
            if self.op("*"):
                lo = self.integer()
                if self.op(".."):
                    length = (1 if lo is None else lo, self.integer())
                else:
                    length = (1, None) if lo is None else (lo, lo)
            props = self.map_items() if self.op("{") else ()
            self.need("]")
        right = self.op("->", "-")
        if right is None:
            raise CypherError(f"expected -> or - at {self.tok.at}")
        if left and right == "->":
            raise CypherError("a relationship can't point both ways")
        return EdgeP(var, tuple(types), "in" if left else "out" if right == "->" else "both", length, props)

    def integer(self) -> int | None:
        if self.tok.kind == "num" and self.tok.text.isdigit():
            self.i += 1
            return int(self.toks[self.i - 1].text)
        return None

    def map_items(self) -> tuple:
        out = []
        while not self.op("}"):
            k = self.name()
            self.need(":")
            out.append((k, self.expr()))
            if not self.op(","):
                self.need("}")
                break
        return tuple(out)

    # expressions, loosest first
    def expr(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise CypherError("expression is nested too deeply")
        left = self.xor()
        while self.kw("OR"):
            left = Bin("or", left, self.xor())
        self.depth -= 1
        return left

    def xor(self):
        left = self.conj()
        while self.kw("XOR"):
            left = Bin("xor", left, self.conj())
        return left

    def conj(self):
        left = self.neg()
        while self.kw("AND"):
            left = Bin("and", left, self.neg())
        return left

    def neg(self):
        return Un("not", self.neg()) if self.kw("NOT") else self.compare()

    def compare(self):
        left = self.add()
        if o := self.op("=", "<>", "<", "<=", ">", ">=", "=~"):
            left = Bin(o, left, self.add())
        elif self.kw("STARTS", "WITH"):
            left = Bin("starts", left, self.add())
        elif self.kw("ENDS", "WITH"):
            left = Bin("ends", left, self.add())
        elif self.kw("CONTAINS"):
            left = Bin("contains", left, self.add())
        elif self.kw("IN"):
            left = Bin("in", left, self.add())
        elif self.kw("NOT", "IN"):
            left = Un("not", Bin("in", left, self.add()))
        while self.is_kw("IS"):
            self.i += 1
            left = Un("notnull" if self.kw("NOT") else "isnull", left)
            self.need("NULL")
        return left

    def add(self):
        left = self.mul()
        while o := self.op("+", "-"):
            left = Bin(o, left, self.mul())
        return left

    def mul(self):
        left = self.unary()
        while o := self.op("*", "/", "%"):
            left = Bin(o, left, self.unary())
        return left

    def unary(self):
        if self.op("-"):
            arg = self.unary()
            return Lit(-arg.value) if isinstance(arg, Lit) and type(arg.value) in (int, float) else Un("-", arg)
        return self.postfix()

    def postfix(self):
        e = self.primary()
        while True:
            if self.op("."):
                e = Prop(e, self.name())
            elif self.op("["):
                e = Index(e, self.expr())
                self.need("]")
            else:
                return e

    def primary(self):
        t = self.tok
        if t.kind == "num":
            self.i += 1
            return Lit(int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind == "str":
            self.i += 1
            return Lit(t.text)
        if t.kind == "param":
            self.i += 1
            return Param(t.text)
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        if self.op("["):
            if self.tok.kind == "name" and self.peek().kind == "name" and self.peek().text.upper() == "IN":
                v = self.name()
                self.need("IN")
                source = self.expr()
                where = self.expr() if self.kw("WHERE") else None
                result = self.expr() if self.op("|") else None
                self.need("]")
                return Comprehension(v, source, where, result)
            items = []
            while not self.op("]"):
                items.append(self.expr())
                if not self.op(","):
                    self.need("]")
                    break
            return ListOf(tuple(items))
        if self.op("{"):
            return MapOf(self.map_items())
        if self.kw("TRUE"):
            return Lit(True)
        if self.kw("FALSE"):
            return Lit(False)
        if self.kw("NULL"):
            return Lit(None)
        if self.is_kw("EXISTS") and self.peek().text == "{":
            self.i += 2
            self.kw("MATCH")
            parts = self.parts()
            where = self.expr() if self.kw("WHERE") else None
            self.need("}")
            return Exists(tuple(parts), where)
        if self.is_kw("CASE"):
            self.i += 1
            subject = None if self.is_kw("WHEN") else self.expr()
            whens = []
            while self.kw("WHEN"):
                c = self.expr()
                self.need("THEN")
                whens.append((c, self.expr()))
            default = self.expr() if self.kw("ELSE") else None
            self.need("END")
            return Case(subject, tuple(whens), default)
        if t.kind in ("name", "quoted"):
            if t.kind == "name" and t.text.upper() in _CLAUSES and self.peek().text != "(":
                raise CypherError(f"unexpected {t.text!r} at {t.at}")
            self.i += 1
            if t.kind == "name" and self.op("("):
                if self.op("*"):
                    self.need(")")
                    return Call(t.text.lower(), (), star=True)
                distinct = self.kw("DISTINCT")
                args = []
                while not self.op(")"):
                    args.append(self.expr())
                    if not self.op(","):
                        self.need(")")
                        break
                return Call(t.text.lower(), tuple(args), distinct)
            return Var(t.text)
        raise CypherError(f"unexpected {t.text!r} at {t.at}")


def parse(source: str) -> Query:
    return Parser(source).query()


def children(e: Any) -> list:
    """Direct sub-expressions."""
    if isinstance(e, Prop):
        return [e.of]
    if isinstance(e, Call):
        return list(e.args)
    if isinstance(e, Un):
        return [e.arg]
    if isinstance(e, Bin):
        return [e.left, e.right]
    if isinstance(e, Case):
        return [x for x in (e.subject, e.default, *(y for w in e.whens for y in w)) if x is not None]
    if isinstance(e, ListOf):
        return list(e.items)
    if isinstance(e, MapOf):
        return [v for _, v in e.items]
    if isinstance(e, Comprehension):
        return [x for x in (e.source, e.where, e.result) if x is not None]
    if isinstance(e, Index):
        return [e.of, e.at]
    if isinstance(e, Exists):
        return [x for x in (e.where, *(v for p in e.parts for n in (*p.nodes, *p.edges) for _, v in n.props)) if x is not None]
    return []


def has_aggregate(e: Any) -> bool:
    return isinstance(e, Call) and e.name in AGGREGATES or any(map(has_aggregate, children(e)))
