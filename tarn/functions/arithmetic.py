"""Arithmetic expressions over columns: numbers, names, + - * / and parentheses, in doubles.

An expression becomes one Spark column, so it runs inside generated code.  Null
operands give null; division follows IEEE 754: x/0 is an infinity, 0/0 NaN.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|([-+*/()]))")


class ExpressionError(ValueError):
    """The text is not an arithmetic expression over the columns at hand."""


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; kinds: number, name, mark."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:1]!r} in {text!r}")
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("mark", m[3]))
        at = m.end()
    return out


def divide(a: Column, b: Column) -> Column:
    """Division of doubles that never fails."""
    # a zero shows its sign as text alone
    sign = F.when(b.cast("string").startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf")) * sign).otherwise(F.lit(float("-inf")) * sign)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


class _Parser:
    """Precedence climbing over a token list."""

    STRENGTH = {"+": 1, "-": 1, "*": 2, "/": 2}

    def __init__(self, text: str, columns: list[str]) -> None:
        self.left, self.columns, self.text = tokens(text)[::-1], set(columns), text

    def _next(self) -> tuple[str, str]:
        if not self.left:
            raise ExpressionError(f"{self.text!r} ends early")
        return self.left.pop()

    def operand(self) -> Column:
        kind, value = self._next()
        if kind == "number":
            return F.lit(float(value))
        if kind == "name":
            if value not in self.columns:
                raise ExpressionError(f"no column {value!r}")
            return F.col(f"`{value}`").cast("double")
        if value != "(":
            raise ExpressionError(f"unexpected {value!r} in {self.text!r}")
        inside = self.climb(1)
        if self._next() != ("mark", ")"):
            raise ExpressionError(f"missing ')' in {self.text!r}")
        return inside

    def climb(self, least: int) -> Column:
        a = self.operand()
        while self.left and self.STRENGTH.get(self.left[-1][1], 0) >= least:
            sign = self.left.pop()[1]
            b = self.climb(self.STRENGTH[sign] + 1)
            a = a + b if sign == "+" else a - b if sign == "-" else a * b if sign == "*" else divide(a, b)
        return a


def compile_expression(text: str, columns: list[str]) -> Column:
    """The expression as a column; ExpressionError for anything else than arithmetic over the columns."""
    parser = _Parser(text, columns)
    out = parser.climb(1)
    if parser.left:
        raise ExpressionError(f"unexpected {parser.left[-1][1]!r} in {text!r}")
    return out


def evaluate(df: DataFrame, text: str, name: str = "result") -> DataFrame:
    """One column of doubles: the expression for each row."""
    return df.select(compile_expression(text, df.columns).alias(name))
