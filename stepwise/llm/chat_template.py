"""A sandboxed template language for chat formatting, compiled to Python closures.

``{{ expr }}`` prints a value, ``{% if %} {% elif %} {% else %} {% endif %}`` and
``{% for name in expr [if expr] %} {% endfor %}`` control the flow, ``{% set name = expr %}`` names a value
(inside a loop, for the rest of the round; ``{% set name.key = expr %}`` changes a ``namespace(...)``),
``{% generation %} {% endgeneration %}`` marks what a model is to learn, ``{# #}`` is a comment; a ``-``
inside a tag's edge trims white space beyond it.  Expressions have strings, integers, ``true false
none``, names, ``a.b``, ``a['b']``, ``a[0]``, ``a[1:]``, ``== != < <= > >= in is + - ~ * // %``, ``and or
not``, ``a if b else c``, parentheses, filters (``| name``), tests (``is name``), a few methods of text and
``raise_exception(text)``.  ``loop.first``, ``loop.last``, ``loop.index`` and ``loop.index0`` describe the
innermost loop.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes closures
that push pieces of text, each with the mark whether it is generated.  Templates reach no Python
attributes, calls or imports beyond the tables below.  Values are escaped as they are printed or joined
to the template's own text, so no value can look like a control string; what the template itself says
is not escaped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields, is_dataclass
from typing import Any

_CONTROL = re.compile(r"<(~*)\|")
_ESCAPED = re.compile(r"<~(~*)\|")


def escape(text: str) -> str:
    """Put one more ``~`` between ``<`` and ``|``; afterwards no control string is left."""
    return _CONTROL.sub(r"<~\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


class Own(str):
    """Text that the template itself says, values in it escaped."""


class Namespace(dict):
    """What ``set name.key`` may change."""


#: What ``| name`` may call with a text.
FILTERS: dict[str, Callable[[str], str]] = {
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "line": lambda s: json.dumps(s, ensure_ascii=False)[1:-1],  # without line ends, reversible
}
#: What ``| name`` may call with any value.
VALUE_FILTERS: dict[str, Callable[[Any], Any]] = {
    "length": lambda v: len(v) if isinstance(v, str | list | dict) else 0,
    "first": lambda v: v[0] if isinstance(v, str | list) and v else None,
    "last": lambda v: v[-1] if isinstance(v, str | list) and v else None,
    "tojson": lambda v: json.dumps(v, ensure_ascii=False),
}
#: What ``is name`` may ask.
TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda v: v is not None,
    "undefined": lambda v: v is None,
    "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str),
    "mapping": lambda v: isinstance(v, dict),
    "iterable": lambda v: isinstance(v, str | list | dict),
    "number": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "true": lambda v: v is True,
    "false": lambda v: v is False,
}
#: Methods of a text, with texts as arguments.
METHODS = ("strip", "lstrip", "rstrip", "startswith", "endswith", "upper", "lower", "title", "split", "replace")


class TemplateError(ValueError):
    """The template's text is wrong, or it says that the conversation is."""


# --- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Slice:
    of: Any
    begin: Any
    end: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    condition: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Call:
    """A method of ``of``, or a function if that is None."""

    of: Any
    name: str
    args: tuple
    named: tuple = ()


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    expr: Any


@dataclass(frozen=True)
class Set:
    name: str
    key: str | None
    expr: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body) pairs, the condition of "else" is Const(True)


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple
    condition: Any = Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parser

_OPEN = re.compile(r"\{[{%#]")
_CLOSE = {"{": "}}", "%": "%}", "#": "#}"}
_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_QUOTED = re.compile(_STRING, re.S)
_TOKENS = re.compile(rf"\s*(?:(?P<str>{_STRING})|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[<>+*%~|().,:=\[\]-]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_WORDS = ("and", "or", "not", "if", "else", "in", "is")


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        text, at = text.strip(), 0
        while at < len(text):
            found = _TOKENS.match(text, at)
            if not found:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.at = 0

    def next_is(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        hit = self.next_is(*values)
        self.at += hit
        return hit

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def pop(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        kind, token = self.pop()
        if kind != "name" or token in _WORDS:
            raise TemplateError(f"a name is expected, not {token!r}")
        return token

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is out of place")

    def whole(self) -> Any:
        out = self.choice()
        self.end()
        return out

    def choice(self) -> Any:
        out = self.either()
        if self.take("if"):
            condition = self.either()
            out = Choice(condition, out, self.choice() if self.take("else") else Const(None))
        return out

    def chain(self, operators: tuple[str, ...], part: Callable[[], Any]) -> Any:
        """Operators of one rank, from the left."""
        out = part()
        while self.next_is(*operators):
            op = self.pop()[1]
            out = Op(op, (out, part()))
        return out

    def either(self) -> Any:
        return self.chain(("or",), lambda: self.chain(("and",), self.negated))

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.summed()
        while True:
            if self.next_is("==", "!=", "<", "<=", ">", ">=", "in"):
                op = self.pop()[1]
                out = Op(op, (out, self.summed()))
            elif self.take("is"):
                no, test = self.take("not"), self.name()
                if test not in TESTS:
                    raise TemplateError(f"unknown test {test!r}")
                out = Op("is", (out, Const(test)))
                out = Op("not", (out,)) if no else out
            elif self.next_is("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                out = Op("not", (Op("in", (out, self.summed())),))
            else:
                return out

    def summed(self) -> Any:
        return self.chain(("+", "-"), lambda: self.chain(("~",), lambda: self.chain(("*", "//", "%"), self.signed)))

    def signed(self) -> Any:
        return Op("-", (Const(0), self.signed())) if self.take("-") else self.filtered()

    def filtered(self) -> Any:
        out = self.value()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS and name not in VALUE_FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            out = Op("filter", (out, Const(name)))
        return out

    def value(self) -> Any:
        kind, token = self.pop()
        if kind == "str":
            out: Any = Const(Own(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), token[1:-1], flags=re.S)))
        elif kind == "int":
            out = Const(int(token))
        elif token == "(":
            out = self.choice()
            self.need(")")
        elif kind == "name" and token not in _WORDS:
            plain = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            if self.next_is("(") and token in ("namespace", "raise_exception"):
                out = self.call(None, token)
            else:
                out = Const(plain[token]) if token in plain else Name(token)
        else:
            raise TemplateError(f"{token!r} is out of place")
        while True:
            if self.take("."):
                name = self.name()
                out = self.call(out, name) if self.next_is("(") else Item(out, Const(name))
            elif self.take("["):
                begin = None if self.next_is(":") else self.choice()
                if self.take(":"):
                    out = Slice(out, begin or Const(None), Const(None) if self.next_is("]") else self.choice())
                else:
                    out = Item(out, begin)
                self.need("]")
            else:
                return out

    def call(self, of: Any, name: str) -> Call:
        if of is not None and name not in METHODS:
            raise TemplateError(f"unknown method {name!r}")
        self.need("(")
        args, named = [], []
        while not self.take(")"):
            if args or named:
                self.need(",")
            if name == "namespace":
                key = self.name()
                self.need("=")
                named.append((key, self.choice()))
            else:
                args.append(self.choice())
        if name == "raise_exception" and len(args) != 1:
            raise TemplateError("raise_exception takes a text")
        return Call(of, name, tuple(args), tuple(named))


def _parts(source: str) -> list[tuple[str, str]]:
    """("text", ...) and (``{``, ``%`` or ``#``, the tag's inside); a tag ends at its own end mark outside quotes."""
    out, at, trim = [], 0, False
    while True:
        found = _OPEN.search(source, at)
        text = source[at : found.start() if found else len(source)]
        text = text.lstrip() if trim else text
        if not found:
            return [*out, ("text", text)]
        kind, begin = found[0][1], found.end()
        before = source.startswith("-", begin)
        end = begin + before
        while end < len(source) and not source.startswith(_CLOSE[kind], end):
            quoted = _QUOTED.match(source, end) if kind != "#" else None
            end = quoted.end() if quoted else end + 1
        if end >= len(source):
            raise TemplateError(f"a tag is not closed: {source[found.start():][:40]!r}")
        inside = source[begin + before : end]
        trim = inside.endswith("-")
        out += [("text", text.rstrip() if before else text), (kind, inside[: len(inside) - trim].strip())]
        at = end + 2


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = _parts(source)
    place = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        nodes: list[Any] = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind == "text":
                if text:
                    nodes.append(Text(text))
            elif kind == "{":
                nodes.append(Print(_Expression(text).whole()))
            elif kind == "%":
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(nodes), text
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(nodes), ""

    def statement(word: str, rest: str) -> Any:
        if word == "generation":
            return Generation(body("endgeneration")[0])
        if word == "set":
            e = _Expression(rest)
            name, key = e.name(), e.name() if e.take(".") else None
            e.need("=")
            return Set(name, key, e.whole())
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            over, condition = e.either(), e.either() if e.take("if") else Const(True)
            e.end()
            return For(name, over, body("endfor")[0], condition)
        if word == "if":
            branches, condition = [], _Expression(rest).whole()
            while True:
                inside, end = body("elif", "else", "endif")
                branches.append((condition, inside))
                if end == "endif":
                    return If(tuple(branches))
                condition = Const(True) if end == "else" else _Expression(end[4:]).whole()
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


# --- values


def _as_text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _printed(value: Any) -> str:
    return str(value) if isinstance(value, Own) else escape(_as_text(value))


def _joined(a: Any, b: Any) -> str:
    """Two texts as one; what joins the template's own text is escaped."""
    if isinstance(a, Own) or isinstance(b, Own):
        return Own(_printed(a) + _printed(b))
    return _as_text(a) + _as_text(b)


def _apply(op: str, a: Any, b: Any = None) -> Any:
    numbers = isinstance(a, int) and isinstance(b, int)
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op in ("<", "<=", ">", ">="):
        if not (numbers or (isinstance(a, str) and isinstance(b, str))):
            return False
        return a < b if op == "<" else a <= b if op == "<=" else a > b if op == ">" else a >= b
    if op == "not":
        return not a
    if op == "in":
        return a in b if isinstance(b, list | dict) or (isinstance(b, str) and isinstance(a, str)) else False
    if op == "is":
        return TESTS[b](a)
    if op == "filter":
        if b in VALUE_FILTERS:
            return VALUE_FILTERS[b](a)
        done = FILTERS[b](_as_text(a))
        return Own(done) if isinstance(a, Own) else done
    if numbers and op != "~":
        if op in ("//", "%") and not b:
            raise TemplateError("division by zero")
        return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a // b if op == "//" else a % b
    if op == "+" and isinstance(a, list) and isinstance(b, list):
        return a + b
    if op in ("+", "~"):
        return _joined(a, b)
    raise TemplateError(f"{op!r} takes integers")


def _look(holder: Any, key: Any) -> Any:
    if isinstance(holder, dict):
        return holder.get(key) if isinstance(key, str | int) else None
    if isinstance(holder, list | str) and isinstance(key, int) and -len(holder) <= key < len(holder):
        return holder[key]
    return None


def _cut(holder: Any, begin: Any, end: Any) -> Any:
    if not isinstance(holder, list | str) or not all(x is None or isinstance(x, int) for x in (begin, end)):
        return None
    return holder[begin:end]


def _call(of: Any, name: str, args: list) -> Any:
    if name == "raise_exception":
        raise TemplateError(_as_text(args[0]))
    if not all(isinstance(a, str) for a in args):
        raise TemplateError(f"{name} takes texts")
    text = _as_text(of)
    try:
        done = getattr(str(text), name)(*args)
    except TypeError as wrong:
        raise TemplateError(f"{name}: {wrong}") from None
    return Own(done) if isinstance(of, Own) and isinstance(done, str) else done


# --- folding


def fold_expression(node: Any) -> Any:
    """The expression with its constant parts computed."""
    if isinstance(node, Item):
        return Item(fold_expression(node.of), fold_expression(node.key))
    if isinstance(node, Slice):
        return Slice(*map(fold_expression, (node.of, node.begin, node.end)))
    if isinstance(node, Call):
        of = None if node.of is None else fold_expression(node.of)
        return Call(of, node.name, tuple(map(fold_expression, node.args)), tuple((k, fold_expression(v)) for k, v in node.named))
    if isinstance(node, Choice):
        condition, yes, no = map(fold_expression, (node.condition, node.yes, node.no))
        return (yes if condition.value else no) if isinstance(condition, Const) else Choice(condition, yes, no)
    if not isinstance(node, Op):
        return node
    args = tuple(fold_expression(a) for a in node.args)
    if node.op in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Op(node.op, args)
    return Const(_apply(node.op, *[a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(node.op, args)


def fold(nodes: tuple) -> tuple:
    """The tree without dead branches, with constants as text and neighbouring texts as one."""
    out: list[Any] = []
    for node in nodes:
        if isinstance(node, Print):
            expr = fold_expression(node.expr)
            new: list[Any] = [Text(_printed(expr.value)) if isinstance(expr, Const) else Print(expr)]
        elif isinstance(node, Set):
            new = [Set(node.name, node.key, fold_expression(node.expr))]
        elif isinstance(node, If):
            branches: list[tuple] = []
            for condition, inside in node.branches:
                condition = fold_expression(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                branches.append((condition, fold(inside)))
                if isinstance(condition, Const):
                    break
            sure = branches and isinstance(branches[0][0], Const)
            new = list(branches[0][1]) if sure else [If(tuple(branches))] if branches else []
        elif isinstance(node, For):
            new = [For(node.name, fold_expression(node.over), fold(node.body), fold_expression(node.condition))]
        elif isinstance(node, Generation):
            new = [Generation(fold(node.body))]
        else:
            new = [node]
        for n in new:
            if isinstance(n, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + n.text)
            elif not (isinstance(n, Text) and not n.text):
                out.append(n)
    return tuple(out)


# --- closures

Piece = tuple[str, bool]


def _value_of(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _value_of(node.of), _value_of(node.key)
        return lambda scope: _look(of(scope), key(scope))
    if isinstance(node, Slice):
        of, begin, end = map(_value_of, (node.of, node.begin, node.end))
        return lambda scope: _cut(of(scope), begin(scope), end(scope))
    if isinstance(node, Choice):
        condition, yes, no = map(_value_of, (node.condition, node.yes, node.no))
        return lambda scope: (yes if condition(scope) else no)(scope)
    if isinstance(node, Call):
        if node.name == "namespace":
            named = [(k, _value_of(v)) for k, v in node.named]
            return lambda scope: Namespace((k, v(scope)) for k, v in named)
        of, called, values = _value_of(node.of or Const(None)), node.name, [_value_of(a) for a in node.args]
        return lambda scope: _call(of(scope), called, [v(scope) for v in values])
    op, args = node.op, [_value_of(a) for a in node.args]
    if op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if op == "not":
        return lambda scope: not args[0](scope)
    return lambda scope: _apply(op, args[0](scope), args[1](scope))


def _with_last(values: Iterable[Any]) -> Iterator[tuple[Any, bool]]:
    values = iter(values)
    for held in values:
        for value in values:
            yield held, False
            held = value
        yield held, True


def _writer(nodes: tuple, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    parts = [_write(n, generated) for n in nodes]

    def write(scope: dict) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope)

    return write


def _write(node: Any, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Text):
        piece = (node.text, generated)
        return lambda scope: iter((piece,))
    if isinstance(node, Print):
        value = _value_of(node.expr)
        return lambda scope: iter(((_printed(value(scope)), generated),))
    if isinstance(node, Set):
        named, into, expr = node.name, node.key, _value_of(node.expr)

        def assign(scope: dict) -> Iterator[Piece]:
            if into is None:
                scope[named] = expr(scope)
            elif isinstance(scope.get(named), Namespace):
                scope[named][into] = expr(scope)
            else:
                raise TemplateError(f"{named!r} is no namespace")
            return iter(())

        return assign
    if isinstance(node, Generation):
        return _writer(node.body, True)
    if isinstance(node, If):
        branches = [(_value_of(c), _writer(b, generated)) for c, b in node.branches]

        def choose(scope: dict) -> Iterator[Piece]:
            for condition, body in branches:
                if condition(scope):
                    return body(scope)
            return iter(())

        return choose
    name, over, body, fits = node.name, _value_of(node.over), _writer(node.body, generated), _value_of(node.condition)

    def loop(scope: dict) -> Iterator[Piece]:
        values = over(scope) or ()
        if not isinstance(values, list | tuple | dict | Iterator):
            raise TemplateError("a loop needs a list")
        chosen = (v for v in values if fits(scope | {name: v}))
        for k, (value, last) in enumerate(_with_last(chosen)):
            yield from body(scope | {name: value, "loop": {"first": k == 0, "last": last, "index": k + 1, "index0": k}})

    return loop


def _uses(node: Any, name: str) -> int:
    """How often a tree names ``name``."""
    if isinstance(node, Name):
        return int(node.name == name)
    parts = node if isinstance(node, tuple) else [getattr(node, f.name) for f in fields(node)] if is_dataclass(node) else ()
    return sum(_uses(p, name) for p in parts)


def _passes_once(tree: tuple, name: str) -> bool:
    """Whether ``name`` is used by one loop only, which is in no other."""
    loops: list[For] = []

    def walk(nodes: tuple) -> None:
        for n in nodes:
            if isinstance(n, For) and n.over == Name(name):
                loops.append(n)
            elif isinstance(n, If):
                for _, inside in n.branches:
                    walk(inside)
            elif isinstance(n, Generation):
                walk(n.body)

    walk(tree)
    return _uses(tree, name) == len(loops) == 1


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A function from the template's variables to pieces (text, generated).

    Variables may be iterators.  One that a single loop goes over is read piece by piece; any other is
    read into a list first.
    """
    tree = fold(parse(source))
    write = _writer(tree, False)

    def run(scope: dict) -> Iterator[Piece]:
        return write({k: list(v) if isinstance(v, Iterator) and not _passes_once(tree, k) else v for k, v in scope.items()})

    return run
