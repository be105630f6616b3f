"""A compiler for sandboxed conversation templates.

    {{ expression }}                         writes a value
    {% for m in messages %} ... {% endfor %} loops; loop.first, loop.last, loop.index, loop.index0 and loop.previous
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %} marks what is written as the model's own
    {# comment #}

Expressions have strings, whole numbers, true, false, none, names, `a.b` and `a['b']`, filters `a | f`, `~` (join as
text), `+`, `==`, `!=`, `<`, `<=`, `>`, `>=`, `in`, `not`, `and`, `or` and brackets. There are no calls and no Python
attributes: a dot looks up a key of a mapping and nothing else, so a template reaches only what it is given.

Source is parsed to a syntax tree, constant parts are folded, and the tree is turned into Python closures that yield
(text, generated) pieces. Loops draw from any iterator with one item of look-ahead, so a conversation of any length is
rendered as a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    over: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    name: str
    over: Any


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Write:
    value: Any


@dataclass(frozen=True)
class Block:
    parts: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: Block


@dataclass(frozen=True)
class If:
    test: Any
    then: Block
    other: Block


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: Block


def text_of(value: Any) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: text_of(v).strip(),
    "upper": lambda v: text_of(v).upper(),
    "lower": lambda v: text_of(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, Mapping)) else 0,
    "text": text_of,
}

OPERATORS: dict[str, Callable[..., Any]] = {
    "~": lambda a, b: text_of(a) + text_of(b),
    "+": lambda a, b: a + b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
}

_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|([A-Za-z_]\w*)|'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|(==|!=|<=|>=|[~+<>|.()\[\]]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_BINARY = (("or",), ("and",), None, ("==", "!=", "<=", ">=", "<", ">", "in"), ("~", "+"))


class _Expression:
    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.filters, self.tokens, at = filters, [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unreadable expression: {source[at:]!r}")
            kind = next(i for i in range(1, 6) if m[i] is not None)
            value = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m[kind], flags=re.S) if kind in (3, 4) else m[kind]
            self.tokens.append(("number", "name", "string", "string", "sign")[kind - 1 : kind] + (value,))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if kind == "end" or value is not None and (got != value or kind == "string"):
            raise TemplateError(f"expected {value or 'a value'}, found {got or 'the end'}")
        self.at += 1
        return got

    def whole(self):
        out = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def level(self, n: int):
        if n == len(_BINARY):
            return self.postfix()
        if _BINARY[n] is None:
            if self.peek() == ("name", "not"):
                self.take()
                return Op("not", (self.level(n),))
            return self.level(n + 1)
        left = self.level(n + 1)
        while self.peek()[1] in _BINARY[n] and self.peek()[0] != "string":
            op = self.take()
            left = Op(op, (left, self.level(n + 1)))
        return left

    def postfix(self):
        kind, value = self.peek()
        if kind == "number":
            out = Const(int(self.take()))
        elif kind == "string":
            out = Const(self.take())
        elif value == "(":
            self.take()
            out = self.level(0)
            self.take(")")
        elif kind == "name":
            self.take()
            out = Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        else:
            raise TemplateError(f"expected a value, found {value or 'the end'}")
        while self.peek()[0] == "sign" and self.peek()[1] in (".", "[", "|"):
            sign = self.take()
            if sign == "[":
                out = Item(out, self.level(0))
                self.take("]")
            elif self.peek()[0] != "name":
                raise TemplateError(f"expected a name after {sign}")
            elif sign == ".":
                out = Item(out, Const(self.take()))
            else:
                name = self.take()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                out = Filter(name, out)
        return out


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> Block:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("write", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    expression = lambda s: _Expression(s, filters).whole()
    place = 0

    def block(ends: tuple[str, ...]) -> tuple[Block, str]:
        nonlocal place
        out = []
        while place < len(parts):
            kind, body = parts[place]
            place += 1
            if kind == "text":
                out.append(Write(Const(body)))
            elif kind == "write":
                out.append(Write(expression(body)))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return Block(tuple(out)), body
                out.append(tag(word, rest.strip()))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return Block(tuple(out)), ""

    def tag(word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"unreadable loop: {rest!r}")
            return For(m[1], expression(m[2]), block(("endfor",))[0])
        if word == "if":
            then, end = block(("elif", "else", "endif"))
            if end.startswith("elif"):
                return If(expression(rest), then, Block((tag("if", end[4:].strip()),)))
            return If(expression(rest), then, block(("endif",))[0] if end == "else" else Block(()))
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"unreadable assignment: {rest!r}")
            return Set(m[1], expression(m[2]))
        if word == "generation":
            return Generation(block(("endgeneration",))[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block(())[0]


def fold(node, filters: Mapping[str, Callable] = FILTERS):
    """The tree with constant expressions worked out, dead branches gone and neighbouring texts joined."""
    again = lambda n: fold(n, filters)
    if isinstance(node, Op):
        args = tuple(map(again, node.args))
        if node.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if node.name in OPERATORS and all(isinstance(a, Const) for a in args):
            try:
                return Const(OPERATORS[node.name](*(a.value for a in args)))
            except TypeError as e:
                raise TemplateError(str(e)) from e
        return Op(node.name, args)
    if isinstance(node, Filter):
        over = again(node.over)
        return Const(filters[node.name](over.value)) if isinstance(over, Const) else Filter(node.name, over)
    if isinstance(node, Item):
        return Item(again(node.over), again(node.key))
    if isinstance(node, Write):
        return Write(again(node.value))
    if isinstance(node, Set):
        return Set(node.name, again(node.value))
    if isinstance(node, For):
        return For(node.name, again(node.over), again(node.body))
    if isinstance(node, Generation):
        return Generation(again(node.body))
    if isinstance(node, If):
        test, then, other = again(node.test), again(node.then), again(node.other)
        return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
    if isinstance(node, Block):
        out: list = []
        for part in map(again, node.parts):
            for p in part.parts if isinstance(part, Block) else (part,):
                if isinstance(p, Write) and isinstance(p.value, Const):
                    p = Write(Const(text_of(p.value.value)))
                    if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                        out[-1] = Write(Const(out[-1].value.value + p.value.value))
                        continue
                    if not p.value.value:
                        continue
                out.append(p)
        return Block(tuple(out))
    return node


def _value(node, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        over, key = _value(node.over, filters), _value(node.key, filters)

        def item(env: dict) -> Any:
            held = over(env)
            return held.get(key(env)) if isinstance(held, Mapping) else None

        return item
    if isinstance(node, Filter):
        return lambda env, f=filters[node.name], over=_value(node.over, filters): f(over(env))
    a, *rest = (_value(x, filters) for x in node.args)
    if node.name == "and":
        return lambda env, b=rest[0]: a(env) and b(env)
    if node.name == "or":
        return lambda env, b=rest[0]: a(env) or b(env)
    if node.name == "not":
        return lambda env: not a(env)
    return lambda env, b=rest[0], f=OPERATORS[node.name]: f(a(env), b(env))


def _renderer(node, filters: Mapping[str, Callable], generated: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Block):
        parts = [_renderer(p, filters, generated) for p in node.parts]

        def block(env: dict) -> Iterator[Piece]:
            for p in parts:
                yield from p(env)

        return block
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            return lambda env, out=((node.value.value, generated),): iter(out)
        value = _value(node.value, filters)

        def write(env: dict) -> Iterator[Piece]:
            yield text_of(value(env)), generated

        return write
    if isinstance(node, Set):
        value = _value(node.value, filters)

        def put(env: dict) -> Iterator[Piece]:
            env[node.name] = value(env)
            return iter(())

        return put
    if isinstance(node, Generation):
        return _renderer(node.body, filters, True)
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _renderer(node.then, filters, generated), _renderer(node.other, filters, generated)
        return lambda env: (then if test(env) else other)(env)
    over, body = _value(node.over, filters), _renderer(node.body, filters, generated)

    def loop(env: dict) -> Iterator[Piece]:
        items, previous, index = iter(over(env) or ()), None, 0
        done = object()
        now = next(items, done)
        while now is not done:
            after = next(items, done)
            env[node.name] = now
            env["loop"] = {"first": index == 0, "last": after is done, "index": index + 1, "index0": index, "previous": previous}
            yield from body(env)
            previous, now, index = now, after, index + 1

    return loop


class Template:
    """A compiled template. stream(messages=..., name=...) yields (text, generated) pieces."""

    def __init__(self, source: str, filters: Mapping[str, Callable[[Any], Any]] | None = None):
        filters = {**FILTERS, **(filters or {})}
        self.tree = fold(parse(source, filters), filters)
        self._render = _renderer(self.tree, filters, False)

    def stream(self, messages: Iterable[Mapping[str, Any]], **names: Any) -> Iterator[Piece]:
        for text, generated in self._render({**names, "messages": messages}):
            if text:
                yield text, generated

    def render(self, messages: Iterable[Mapping[str, Any]], **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text and the (start, end) spans that are the model's own."""
        parts, spans, at = [], [], 0
        for text, generated in self.stream(messages, **names):
            if generated:
                spans.append((at, at + len(text)))
            parts.append(text)
            at += len(text)
        return "".join(parts), spans
