"""Text templates compiled to one Column each.

``{{ path | filter:arg }}`` (escaped for HTML unless the last filter is ``safe``), ``{% if %}``, ``{% else %}``,
``{% for x in path %}`` and ``{# comment #}``. Conditions are a path, or ``==`` / ``!=`` between paths and literals. In a loop
``loop.index`` counts from 0, ``loop.index1`` from 1, and ``loop.first`` and ``loop.last`` are flags. Missing and null values
are empty text and false; blocks must be closed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)


class TemplateError(ValueError):
    """The template cannot be read."""


class Value:
    """A Column with its type, which lengths, truth and text depend on; type None means missing."""

    def __init__(self, column: Column | None, kind: T.DataType | None, safe: bool = False) -> None:
        self.column, self.kind, self.safe = column, kind, safe

    def text(self) -> Column:
        if self.column is None:
            return F.lit("")
        if isinstance(self.kind, T.BooleanType):
            return F.coalesce(F.when(self.column, "True").otherwise("False"), F.lit(""))
        if isinstance(self.kind, T.ArrayType):
            return F.coalesce(F.array_join(self.column.cast("array<string>"), ", "), F.lit(""))
        return F.coalesce(self.column.cast("string"), F.lit(""))

    def truth(self) -> Column:
        if self.column is None:
            return F.lit(False)
        if isinstance(self.kind, T.StringType):
            test = self.column != ""
        elif isinstance(self.kind, T.BooleanType):
            test = self.column
        elif isinstance(self.kind, (T.ArrayType, T.MapType)):
            test = F.size(self.column) > 0
        elif isinstance(self.kind, T.NumericType):
            test = self.column != 0
        else:
            test = self.column.isNotNull()
        return F.coalesce(test, F.lit(False))


def _title(v: Value) -> Value:
    # a word starts after any character that is not a letter, also after an apostrophe or a hyphen
    marked = F.regexp_replace(F.lower(v.text()), r"(?U)(?<!\p{L})(\p{L})", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return Value(F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))), ""), T.StringType())


def _length(v: Value) -> Value:
    return Value(F.lit(0) if v.column is None else F.size(v.column) if isinstance(v.kind, (T.ArrayType, T.MapType)) else F.length(v.text()), T.IntegerType())


def _default(v: Value, fallback: Value | None = None) -> Value:
    other = (fallback or Value(F.lit(""), T.StringType())).text()
    if v.column is None:
        return Value(other, T.StringType())
    blank = v.column.isNull()
    if isinstance(v.kind, T.StringType):
        blank = blank | (v.column == "")
    if isinstance(v.kind, T.ArrayType):
        blank = blank | (F.size(v.column) == 0)
    return Value(F.when(blank, other).otherwise(v.text()), T.StringType())


def _join(v: Value, separator: Value | None = None) -> Value:
    if not isinstance(v.kind, T.ArrayType):
        return Value(v.text(), T.StringType())
    glue = (separator or Value(F.lit(", "), T.StringType())).text()
    # array_join wants a literal separator: join by folding instead
    items = F.transform(v.column, lambda x: F.coalesce(x.cast("string"), F.lit("None")))
    folded = F.aggregate(items, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, glue, x)))
    return Value(F.coalesce(folded, F.lit("")), T.StringType())


FILTERS: dict[str, Callable[..., Value]] = {
    "upper": lambda v: Value(F.upper(v.text()), T.StringType()),
    "lower": lambda v: Value(F.lower(v.text()), T.StringType()),
    "title": _title,
    "len": _length,
    "default": _default,
    "safe": lambda v: Value(v.text(), T.StringType(), safe=True),
    "join": _join,
}


def register_filter(name: str, function: Callable[..., Column]) -> None:
    """Add a filter from a function of Columns (the value's text and, if given, the argument's text)."""
    FILTERS[name] = lambda v, *a: Value(function(v.text(), *(x.text() for x in a)), T.StringType())


def escape_html(c: Column) -> Column:
    # The five characters that HTML text escapes, the ampersand first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


Scope = Mapping[str, Value]


def _path(path: str, scope: Scope) -> Value:
    name, *fields = path.strip().split(".")
    value = scope.get(name, Value(None, None))
    for f in fields:
        if isinstance(value.kind, T.StructType) and f in value.kind.names:
            value = Value(value.column[f], value.kind[f].dataType)
        elif isinstance(value.kind, T.MapType):
            value = Value(F.try_element_at(value.column, F.lit(f)), value.kind.valueType)
        else:
            return Value(None, None)
    return value


def _literal(text: str, scope: Scope) -> Value:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return Value(F.lit(text[1:-1]), T.StringType())
    for number, kind in ((int, T.LongType()), (float, T.DoubleType())):
        try:
            return Value(F.lit(number(text)), kind)
        except ValueError:
            continue
    return _path(text, scope)


def _expression(raw: str, scope: Scope) -> Value:
    first, *filters = raw.split("|")
    value = _path(first, scope)
    for f in filters:
        name, colon, argument = f.partition(":")
        if name.strip() not in FILTERS:
            raise TemplateError(f"unknown filter {name.strip()!r}")
        value = FILTERS[name.strip()](value, *([_literal(argument, scope)] if colon else []))
    return value


def _condition(raw: str, scope: Scope) -> Column:
    for op in ("==", "!="):
        left, found, right = raw.partition(op)
        if found:
            a, b = _literal(left, scope), _literal(right, scope)
            numbers = [isinstance(v.kind, T.NumericType) for v in (a, b)]
            if a.column is None or b.column is None:
                same = F.lit(a.column is None and b.column is None)
            elif all(numbers):
                same = a.column.cast("double").eqNullSafe(b.column.cast("double"))
            elif any(numbers):
                same = F.lit(False)
            else:
                same = a.column.cast("string").eqNullSafe(b.column.cast("string"))
            return same if op == "==" else ~same
    return _path(raw, scope).truth()


class _Compiler:
    def __init__(self, source: str) -> None:
        self.pieces = [p for p in _PIECE.split(source) if p]
        self.at = 0

    def body(self, scope: Scope, ends: tuple[str, ...]) -> tuple[Column, str]:
        """The text up to a block of one of the names ``ends``, and that name."""
        out: list[Column] = []
        while self.at < len(self.pieces):
            piece = self.pieces[self.at]
            self.at += 1
            if piece.startswith("{{"):
                v = _expression(piece[2:-2], scope)
                out.append(v.text() if v.safe else escape_html(v.text()))
            elif piece.startswith("{%"):
                head, _, rest = piece[2:-2].strip().partition(" ")
                if head in ends:
                    return self.joined(out), head
                out.append(self.block(head, rest.strip(), scope))
            elif not piece.startswith("{#"):
                out.append(F.lit(piece))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return self.joined(out), ""

    @staticmethod
    def joined(parts: list[Column]) -> Column:
        return F.concat(*parts) if parts else F.lit("")

    def block(self, head: str, rest: str, scope: Scope) -> Column:
        if head == "if":
            then, end = self.body(scope, ("else", "endif"))
            other = self.body(scope, ("endif",))[0] if end == "else" else F.lit("")
            return F.when(_condition(rest, scope), then).otherwise(other)
        m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S) if head == "for" else None
        if not m:
            raise TemplateError(f"unknown block {head!r}" if head != "for" else f"cannot read for {rest!r}")
        items, start = _path(m[2], scope), self.at
        if not isinstance(items.kind, T.ArrayType):
            self.body({**scope, m[1]: Value(None, None)}, ("endfor",))
            return F.lit("")
        size, stop = F.size(items.column), []

        def one(x: Column, i: Column) -> Column:
            self.at = start
            loop = {"index": (i, T.IntegerType()), "index1": (i + 1, T.IntegerType()), "first": (i == 0, T.BooleanType()), "last": (i == size - 1, T.BooleanType())}
            kind = T.StructType([T.StructField(k, t) for k, (_, t) in loop.items()])
            inside = {**scope, m[1]: Value(x, items.kind.elementType), "loop": Value(F.struct(*(c.alias(k) for k, (c, _) in loop.items())), kind)}
            text = self.body(inside, ("endfor",))[0]
            stop.append(self.at)
            return text

        out = F.coalesce(F.array_join(F.transform(items.column, one), ""), F.lit(""))
        self.at = stop[-1]
        return out


def render_template(source: str, df: DataFrame) -> Column:
    """The template as a Column over the columns of ``df``."""
    scope = {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    return _Compiler(source).body(scope, ())[0]
