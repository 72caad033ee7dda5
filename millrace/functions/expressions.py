"""Arithmetic expressions compiled to Columns, so they run inside generated code.

Grammar, loosest first: ``+ -``; ``* / %``; ``**`` (to the right); unary minus, which binds tighter than ``**`` (``-3 ** 2``
is 9); numbers, names, calls and parentheses. ``/`` is true division; ``%`` takes the divisor's sign; ``round`` rounds half
to even. There is no unary plus and no scientific notation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|[-+*/%(),]))")


class ExpressionError(ValueError):
    """The text is no expression, or uses a name or function that is unknown."""


def _modulo(a: Column, b: Column) -> Column:
    return a - b * F.floor(a / b)


# name -> (least and most number of arguments, function)
FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "max": (1, None, lambda *a: F.greatest(*a) if len(a) > 1 else a[0]),
    "min": (1, None, lambda *a: F.least(*a) if len(a) > 1 else a[0]),
    "abs": (1, 1, F.abs),
    "sqrt": (1, 1, F.sqrt),
    "pow": (2, 2, F.pow),
    "round": (1, 2, lambda x, n=0: F.bround(x, n)),
}
_BINARY = {"+": (1, lambda a, b: a + b), "-": (1, lambda a, b: a - b), "*": (2, lambda a, b: a * b), "/": (2, lambda a, b: a / b), "%": (2, _modulo)}


def register_function(name: str, function: Callable[..., Column], least: int = 1, most: int | None = None) -> None:
    FUNCTIONS[name] = (least, most, function)


class _Parser:
    def __init__(self, text: str, names: Mapping[str, Column] | None) -> None:
        self.names, self.at, self.tokens = names, 0, []
        text, place = text.rstrip(), 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise ExpressionError(f"unexpected {text[place:].strip()[:1]!r} at {place}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            place = m.end()
        self.tokens.append(("end", ""))

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] == "op" else ""

    def take(self, expected: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if expected is not None and token != ("op", expected):
            raise ExpressionError(f"expected {expected!r}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def whole(self) -> Column:
        out = self.binary(1)
        if self.tokens[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def binary(self, level: int) -> Column:
        if level > 2:
            return self.power()
        left = self.binary(level + 1)
        while _BINARY.get(self.peek(), (0,))[0] == level:
            operator = _BINARY[self.take()[1]][1]
            left = operator(left, self.binary(level + 1))
        return left

    def power(self) -> Column:
        base = self.negated()
        if self.peek() == "**":
            self.take()
            return F.pow(base, self.power())
        return base

    def negated(self) -> Column:
        if self.peek() == "-":
            self.take()
            return -self.negated()
        return self.single()

    def single(self) -> Column:
        kind, text = self.take()
        if kind == "number":
            self.number = text
            return F.lit(float(text) if "." in text else int(text))
        if kind == "name":
            return self.call(text) if self.peek() == "(" else self.variable(text)
        if (kind, text) == ("op", "("):
            inner = self.binary(1)
            self.take(")")
            return inner
        raise ExpressionError(f"unexpected {text or 'the end'!r}")

    def variable(self, name: str) -> Column:
        if self.names is None:
            return F.col(name)
        if name not in self.names:
            raise ExpressionError(f"unknown name {name!r}")
        value = self.names[name]
        return value if isinstance(value, Column) else F.lit(value)

    def call(self, name: str) -> Column:
        if name not in FUNCTIONS:
            raise ExpressionError(f"unknown function {name!r}")
        self.take("(")
        arguments: list = []
        if self.peek() != ")":
            arguments.append(self.binary(1))
            while self.peek() == ",":
                self.take()
                before = self.at
                arguments.append(self.binary(1))
                if name == "round":  # the number of places is part of the plan, not data
                    if self.at != before + 1 or self.tokens[before][0] != "number" or "." in self.tokens[before][1]:
                        raise ExpressionError("round takes a whole number of places")
                    arguments[-1] = int(self.tokens[before][1])
        self.take(")")
        least, most, function = FUNCTIONS[name]
        if len(arguments) < least or most is not None and len(arguments) > most:
            raise ExpressionError(f"{name} does not take {len(arguments)} arguments")
        return function(*arguments)


def evaluate(expression: str, context: Mapping[str, object] | None = None) -> Column:
    """The expression as a Column; names are columns, or what ``context`` gives for them."""
    return _Parser(expression, context).whole()
