"""Chat formatting: a compiler from a sandboxed template language to Python closures.

Source -> tokens -> syntax tree -> tree with folded constants -> closures. The language has output
``{{ e }}``, comments ``{# #}``, ``{% for x in e if c %}``, ``{% if %} {% elif %} {% else %}``, ``{% set x = e %}`` and
``{% generation %}`` (text that is trained on); a minus inside a mark (``{%- -%}``) drops the white space beside it. Expressions know
names, literals, lists, ``a.b``, ``a[e]``, ``a[e:e]``, ``== != < <= > >=``, ``in``, ``is defined`` and other tests, ``and or not``,
``a if c else b``, ``+ - * // % ~``, filters with arguments, the text methods of ``METHODS`` and ``raise_exception``. A name or attribute is only ever
a lookup in the given mappings; there are no other calls, no imports and no Python attributes, and loops run
over given lists only, so a template ends and cannot reach the interpreter.

Rendering returns the text and the spans of it that generation blocks made. ``Format`` pairs
a template with the control strings it marks turns with: texts pass through ``escape``, which
leaves no control string in them and is undone by ``unescape``, so turns and trained text can be
read back exactly.

Defined results: null role and text are empty; rows of a conversation are put in the order of
(turn, role, text), nulls first, repeated rows are turns of their own; an empty table gives an
empty result; other columns are not read. A conversation is one record and is rendered in one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through_python


class TemplateError(ValueError):
    """A template that is not in the language, or an operation that it does not allow."""


# --- syntax tree -----------------------------------------------------------------------------


@dataclass
class Literal:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: Any
    key: Any


@dataclass
class Unary:
    of: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Filter:
    of: Any
    name: str
    args: list = field(default_factory=list)


@dataclass
class Choice:
    condition: Any
    yes: Any
    no: Any


@dataclass
class Several:
    items: list


@dataclass
class Slice:
    of: Any
    start: Any
    stop: Any


@dataclass
class Test:
    of: Any
    name: str
    negated: bool


@dataclass
class Text:
    value: str


@dataclass
class Output:
    value: Any


@dataclass
class Let:
    name: str
    value: Any


@dataclass
class Loop:
    name: str
    over: Any
    body: list
    where: Any = None


@dataclass
class Branch:
    arms: list  # (condition, body); an else arm has a true literal


@dataclass
class Generation:
    body: list


def _raise(message: Any) -> None:
    raise TemplateError(_text(message))


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "title": lambda v: _text(v)[:1].upper() + _text(v)[1:],
    "length": len,
    "join": lambda v, mark="": _text(mark).join(map(_text, _list(v))),
    "default": lambda v, other="": other if v is None else v,
    "replace": lambda v, old, new: _text(v).replace(_text(old), _text(new)),
    "first": lambda v: v[0] if v else None,
    "last": lambda v: v[-1] if v else None,
    "string": lambda v: _text(v),
    "int": lambda v: int(v),
    "tojson": lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True),
}
#: Calls on texts: ``a.strip()``.
METHODS: dict[str, Callable[..., Any]] = {
    "strip": lambda v, marks=None: v.strip(marks), "lstrip": lambda v, marks=None: v.lstrip(marks), "rstrip": lambda v, marks=None: v.rstrip(marks),
    "upper": lambda v: v.upper(), "lower": lambda v: v.lower(), "split": lambda v, mark=None: v.split(mark), "replace": lambda v, old, new: v.replace(old, new),
    "startswith": lambda v, start: v.startswith(start), "endswith": lambda v, end: v.endswith(end),
}
TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda v: v is not None, "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "mapping": lambda v: isinstance(v, dict),
    "sequence": lambda v: isinstance(v, (list, tuple, str)), "iterable": lambda v: isinstance(v, (list, tuple, str, dict)), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool), "true": lambda v: v is True, "false": lambda v: v is False, "odd": lambda v: v % 2 == 1, "even": lambda v: v % 2 == 0,
}
#: No product of a text or list and a number, which could be of any size.
OPERATIONS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "~": lambda a, b: _text(a) + _text(b), "+": lambda a, b: a + b,
    "-": lambda a, b: _number(a) - _number(b), "*": lambda a, b: _number(a) * _number(b), "//": lambda a, b: _number(a) // _number(b), "%": lambda a, b: _number(a) % _number(b),
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}


def _number(value: Any) -> int:
    if not isinstance(value, int):
        raise TypeError(f"{type(value).__name__} is not a number")
    return value


def _list(value: Any) -> list | tuple:
    if not isinstance(value, (list, tuple)):
        raise TypeError(f"{type(value).__name__} is not a list")
    return value


def _safely(run: Callable, *values: Any) -> Any:
    try:
        return run(*values)
    except TemplateError:
        raise
    except (TypeError, ValueError, KeyError, IndexError, AttributeError, ArithmeticError) as e:
        raise TemplateError(str(e)) from None


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# --- parser ----------------------------------------------------------------------------------

OPEN = re.compile(r"\{\{|\{%|\{#")
CLOSE = {"{{": re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|-?\}\}""", re.S), "{%": re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|-?%\}""", re.S), "{#": re.compile(r"()-?#\}")}
TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|//|[<>+*%~|.,:()\[\]=-]))""", re.S)


def pieces(source: str) -> Iterator[tuple[str, str]]:
    """(mark, inside) of each mark, and ("", text) of what is between; strings may hold closing marks."""
    at, strip = 0, False
    while True:
        m = OPEN.search(source, at)
        text = source[at : m.start() if m else None]
        text = text.lstrip() if strip else text
        if not m:
            yield "", text
            return
        begin = m.end() + source.startswith("-", m.end())
        yield "", text.rstrip() if begin > m.end() else text
        end = CLOSE[m[0]].search(source, begin)
        while end and end[1]:
            end = CLOSE[m[0]].search(source, end.end())
        if not end:
            raise TemplateError(f"not closed: {source[m.start() : m.start() + 20]!r}")
        if m[0] != "{#":
            yield m[0], source[begin : end.start()]
        at, strip = end.end(), end[0].startswith("-")


ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while source[at:].strip():
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"not an expression: {source[at:]!r}")
        at = m.end()
        kind = m.lastgroup
        value = m[kind]
        if kind == "string":
            value = re.sub(r"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), value[1:-1], flags=re.S)
        out.append((kind, int(value) if kind == "number" else value))
    return out


class _Expression:
    """Recursive descent, loosest first: or, and, not, comparison, sum, filter, item."""

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted: str) -> str | None:
        kind, value = self.peek()
        if kind in ("mark", "name") and value in wanted:
            self.at += 1
            return value
        return None

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return value

    def end(self, tree: Any) -> Any:
        if self.peek()[0] != "end":
            raise TemplateError(f"left over: {self.peek()[1]!r}")
        return tree

    def whole(self) -> Any:
        tree = self.either()
        if self.take("if"):
            condition = self.either()
            return Choice(condition, tree, self.whole() if self.take("else") else Literal(None))
        return tree

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Binary("or", left, self.both())
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Binary("and", left, self.negated())
        return left

    def negated(self) -> Any:
        return Unary(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.summed()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                left = Binary(op, left, self.summed())
            elif self.peek() == ("name", "not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                left = Binary("not in", left, self.summed())
            elif self.take("is"):
                negated = bool(self.take("not"))
                name = self.name()
                if name not in TESTS:
                    raise TemplateError(f"no such test: {name}")
                left = Test(left, name, negated)
            else:
                return left

    def summed(self) -> Any:
        left = self.product()
        while op := self.take("+", "-", "~"):
            left = Binary(op, left, self.product())
        return left

    def product(self) -> Any:
        left = self.signed()
        while op := self.take("*", "//", "%"):
            left = Binary(op, left, self.signed())
        return left

    def signed(self) -> Any:
        return Binary("-", Literal(0), self.signed()) if self.take("-") else self.filtered()

    def filtered(self) -> Any:
        tree = self.item()
        while self.take("|"):
            tree = Filter(tree, self.name(), self.arguments() if self.take("(") else [])
        return tree

    def arguments(self, close: str = ")") -> list:
        """Expressions up to a closing bracket."""
        out: list = []
        while not self.take(close):
            if out and not self.take(","):
                raise TemplateError("a bracket is not closed")
            if self.take(close):
                break
            out.append(self.whole())
        return out

    def item(self) -> Any:
        kind, value = self.peek()
        if self.take("("):
            tree = self.whole()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
        elif self.take("["):
            tree = Several(self.arguments("]"))
        elif kind in ("string", "number"):
            self.at += 1
            tree = Literal(value)
        else:
            name = self.name()
            constant = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            if name == "raise_exception" and self.take("("):
                args = self.arguments()
                tree = Filter(args[0] if args else Literal(None), name)
            else:
                tree = Literal(constant[name]) if name in constant else Name(name)
        while op := self.take(".", "["):
            if op == ".":
                name = self.name()
                if name in METHODS and self.take("("):
                    tree = Filter(tree, "." + name, self.arguments())
                else:
                    tree = Item(tree, Literal(name))
            else:
                start = None if self.peek() == ("mark", ":") else self.whole()
                if self.take(":"):
                    tree = Slice(tree, start or Literal(None), Literal(None) if self.peek() == ("mark", "]") else self.whole())
                else:
                    tree = Item(tree, start)
                if not self.take("]"):
                    raise TemplateError("a bracket is not closed")
        return tree


def parse(source: str) -> list:
    """The syntax tree of a template."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    for mark, piece in pieces(source):
        body = stack[-1][2]
        if not mark:
            if piece:
                body.append(Text(piece))
        elif mark == "{{":
            e = _Expression(piece)
            body.append(Output(e.end(e.whole())))
        else:
            word, _, rest = piece.strip().partition(" ")
            e = _Expression(rest)
            if word == "for":
                name = e.name()
                if not e.take("in"):
                    raise TemplateError("for without in")
                over = e.either()
                stack.append(("for", Loop(name, over, [], e.end(e.either()) if e.take("if") else e.end(None)), []))
            elif word == "if":
                stack.append(("if", Branch([(e.end(e.whole()), [])]), []))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                _, branch, done = stack.pop()
                branch.arms[-1] = (branch.arms[-1][0], done)
                branch.arms.append((e.end(e.whole()) if word == "elif" else Literal(True), []))
                stack.append(("if", branch, []))
            elif word == "set":
                name = e.name()
                if not e.take("="):
                    raise TemplateError("set without =")
                body.append(Let(name, e.end(e.whole())))
            elif word == "generation":
                stack.append(("generation", Generation([]), []))
            elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
                kind, node, done = stack.pop()
                if kind == "if":
                    node.arms[-1] = (node.arms[-1][0], done)
                else:
                    node.body = done
                stack[-1][2].append(node)
            else:
                raise TemplateError(f"unknown or misplaced statement: {piece!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return stack[0][2]


# --- constant folding ------------------------------------------------------------------------


def fold(tree: Any, filters: dict[str, Callable]) -> Any:
    """The same tree with constant expressions computed, dead arms gone and neighbouring texts joined."""
    go = lambda t: fold(t, filters)
    if isinstance(tree, list):
        out: list = []
        for node in map(go, tree):
            for n in node if isinstance(node, list) else [node]:
                if isinstance(n, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + n.value)
                elif not (isinstance(n, Text) and not n.value):
                    out.append(n)
        return out
    if isinstance(tree, Item):
        return Item(go(tree.of), go(tree.key))
    if isinstance(tree, Unary):
        of = go(tree.of)
        return Literal(not of.value) if isinstance(of, Literal) else Unary(of)
    if isinstance(tree, Binary):
        left, right = go(tree.left), go(tree.right)
        if isinstance(left, Literal) and tree.op in ("and", "or"):
            return right if bool(left.value) == (tree.op == "and") else left
        if isinstance(left, Literal) and isinstance(right, Literal) and tree.op in OPERATIONS:
            return Literal(_safely(OPERATIONS[tree.op], left.value, right.value))
        return Binary(tree.op, left, right)
    if isinstance(tree, Filter):
        _filter(tree.name, filters)
        of, args = go(tree.of), [go(a) for a in tree.args]
        if tree.name != "raise_exception" and all(isinstance(t, Literal) for t in (of, *args)):
            return Literal(_safely(_filter(tree.name, filters), of.value, *(a.value for a in args)))
        return Filter(of, tree.name, args)
    if isinstance(tree, Choice):
        condition = go(tree.condition)
        return go(tree.yes if condition.value else tree.no) if isinstance(condition, Literal) else Choice(condition, go(tree.yes), go(tree.no))
    if isinstance(tree, Test):
        of = go(tree.of)
        return Literal(_safely(TESTS[tree.name], of.value) != tree.negated) if isinstance(of, Literal) else Test(of, tree.name, tree.negated)
    if isinstance(tree, Several):
        return Several([go(i) for i in tree.items])
    if isinstance(tree, Slice):
        return Slice(go(tree.of), go(tree.start), go(tree.stop))
    if isinstance(tree, Output):
        value = go(tree.value)
        return Text(_text(value.value)) if isinstance(value, Literal) else Output(value)
    if isinstance(tree, Let):
        return Let(tree.name, go(tree.value))
    if isinstance(tree, Loop):
        return Loop(tree.name, go(tree.over), go(tree.body), tree.where and go(tree.where))
    if isinstance(tree, Generation):
        return Generation(go(tree.body))
    if isinstance(tree, Branch):
        arms = []
        for condition, body in tree.arms:
            condition = go(condition)
            if isinstance(condition, Literal):
                if not condition.value:
                    continue
                arms.append((condition, go(body)))
                break
            arms.append((condition, go(body)))
        if not arms:
            return []
        return arms[0][1] if isinstance(arms[0][0], Literal) else Branch(arms)
    return tree


# --- closures --------------------------------------------------------------------------------


@dataclass
class _Run:
    names: dict[str, Any]
    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _look(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"cannot look up {key!r} in a {type(of).__name__}")


def _filter(name: str, filters: dict[str, Callable]) -> Callable:
    if name == "raise_exception":
        return _raise
    found = METHODS.get(name[1:]) if name.startswith(".") else filters.get(name)
    if not found:
        raise TemplateError(f"no such filter: {name}")
    if name.startswith("."):
        return lambda v, *args: found(v, *args) if isinstance(v, str) else _raise(f"{name[1:]} of a {type(v).__name__}")
    return found


def _value(tree: Any, filters: dict[str, Callable]) -> Callable[[_Run], Any]:
    if isinstance(tree, Literal):
        return lambda run, v=tree.value: v
    if isinstance(tree, Name):
        return lambda run, n=tree.name: run.names.get(n)
    if isinstance(tree, Item):
        of, key = _value(tree.of, filters), _value(tree.key, filters)
        return lambda run: _look(of(run), key(run))
    if isinstance(tree, Unary):
        of = _value(tree.of, filters)
        return lambda run: not of(run)
    if isinstance(tree, Filter):
        of, apply, args = _value(tree.of, filters), _filter(tree.name, filters), [_value(a, filters) for a in tree.args]
        if not args:
            return lambda run: _safely(apply, of(run))
        return lambda run: _safely(apply, of(run), *[a(run) for a in args])
    if isinstance(tree, Choice):
        condition, yes, no = (_value(t, filters) for t in (tree.condition, tree.yes, tree.no))
        return lambda run: yes(run) if condition(run) else no(run)
    if isinstance(tree, Test):
        of, test, negated = _value(tree.of, filters), TESTS[tree.name], tree.negated
        return lambda run: _safely(test, of(run)) != negated
    if isinstance(tree, Several):
        items = [_value(i, filters) for i in tree.items]
        return lambda run: [i(run) for i in items]
    if isinstance(tree, Slice):
        of, start, stop = (_value(t, filters) for t in (tree.of, tree.start, tree.stop))
        return lambda run: _safely(lambda v, a, b: v[a:b] if isinstance(v, (list, tuple, str)) else _raise("only lists and texts have slices"), of(run), start(run), stop(run))
    left, right = _value(tree.left, filters), _value(tree.right, filters)
    if tree.op == "and":
        return lambda run: left(run) and right(run)
    if tree.op == "or":
        return lambda run: left(run) or right(run)
    op = OPERATIONS[tree.op]
    return lambda run: _safely(op, left(run), right(run))


def _block(tree: list, filters: dict[str, Callable]) -> Callable[[_Run], None]:
    steps = [_step(node, filters) for node in tree]

    def block(run: _Run) -> None:
        for step in steps:
            step(run)

    return steps[0] if len(steps) == 1 else block


def _step(node: Any, filters: dict[str, Callable]) -> Callable[[_Run], None]:
    if isinstance(node, Text):
        return lambda run, t=node.value: run.put(t)
    if isinstance(node, Output):
        value = _value(node.value, filters)
        return lambda run: run.put(_text(value(run)))
    if isinstance(node, Let):
        value = _value(node.value, filters)

        def let(run: _Run, name: str = node.name) -> None:
            run.names[name] = value(run)

        return let
    if isinstance(node, Generation):
        body = _block(node.body, filters)

        def generation(run: _Run) -> None:
            start = run.size
            body(run)
            run.spans.append((start, run.size))

        return generation
    if isinstance(node, Branch):
        arms = [(_value(c, filters), _block(b, filters)) for c, b in node.arms]

        def branch(run: _Run) -> None:
            for condition, body in arms:
                if condition(run):
                    return body(run)

        return branch
    over, body, where = _value(node.over, filters), _block(node.body, filters), node.where and _value(node.where, filters)

    def loop(run: _Run, name: str = node.name) -> None:
        items = over(run) or ()
        if not isinstance(items, (list, tuple)):
            raise TemplateError("for runs over lists only")
        if where:
            kept = []
            before = run.names.get(name)
            for item in items:
                run.names[name] = item
                if where(run):
                    kept.append(item)
            run.names[name] = before
            items = kept
        outer = {k: run.names[k] for k in (name, "loop") if k in run.names}
        for k, item in enumerate(items):
            run.names[name] = item
            run.names["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(items) - 1, "length": len(items)}
            body(run)
        for k in (name, "loop"):
            run.names.pop(k, None)
        run.names.update(outer)

    return loop


class Template:
    """``render`` gives the text and the spans, in code points, that generation blocks made."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None) -> None:
        self.source = source
        known = FILTERS | (filters or {})
        self.tree = fold(parse(source), known)
        self._run = _block(self.tree, known)

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        run = _Run(dict(names))
        self._run(run)
        return "".join(run.parts), run.spans


# --- a format that can be read back -----------------------------------------------------------

TURNS = (
    "{% for m in messages %}### {{ m.role | role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
#: What escapes stand for. No escaped text holds a control string: "###" starts a turn, "</turn>" ends it, ":" ends a role.
CODES = {"b": "\\", "h": "###", "t": "</turn>"}
ROLE_CODES = CODES | {"c": ":"}
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}


def _coder(codes: dict[str, str]) -> tuple[Callable[[Any], str], Callable[[str], str]]:
    back = {v: "\\" + k for k, v in codes.items()}
    find = re.compile("|".join(map(re.escape, codes.values())))
    undo = re.compile(r"\\([a-z])")
    return (lambda v: find.sub(lambda m: back[m[0]], _text(v))), (lambda s: undo.sub(lambda m: codes[m[1]], s))


escape, unescape = _coder(CODES)
_escape_role, _unescape_role = _coder(ROLE_CODES)
TURN = re.compile(r"### (=?)([^:]*): (.*?)</turn>\n", re.S)


def _role(value: Any) -> str:
    return NAMES.get(_text(value)) or "=" + _escape_role(value)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    known = {v: k for k, v in NAMES.items()}
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn starts at {at}")
        out.append((_unescape_role(m[2]) if m[1] else known[m[2]], unescape(m[3])))
        at = m.end()
    return out


@lru_cache(maxsize=8)
def compiled(source: str) -> Template:
    return Template(source, {"escape": escape, "role": _role})


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, source: str = TURNS) -> DataFrame:
    """One row per conversation: conv_id, text, and the starts and ends of what is trained on, in code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = compiled(source)
        for batch in batches:
            made = [template.render(messages=[{"role": t["role"], "text": t["text"]} for t in turns]) for turns in batch["turns"]]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "text": [t for t, _ in made], "starts": [[a for a, _ in s] for _, s in made], "ends": [[b for _, b in s] for _, s in made]})

    return through_python(conversations(rows), run, "text string, starts array<int>, ends array<int>", "conv_id")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of trained text, read from the output of ``format_chats``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv_id, text, starts, ends in batch[["conv_id", "text", "starts", "ends"]].itertuples(index=False):
                turns = read_turns(text)
                trained = "".join(unescape(text[a:b]) for a, b in zip(starts, ends))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv_id, len(turns), _sha(whole), len(trained), _sha(trained), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return through_python(formatted, run, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", "conv_id")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
