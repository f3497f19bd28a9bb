"""Form expressions as columns: + - * /, unary minus, parentheses, min and max of two, names with dots."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormError(ValueError):
    """A malformed expression, rule set or range."""


TOKEN = re.compile(r"\s*(?:([0-9.]+)|([A-Za-z_][A-Za-z0-9_.]*)|([-+*/(),]))")


def _tokens(text: str) -> list[str]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = TOKEN.match(text, at)
        if not m or m[1] and not re.fullmatch(r"[0-9]+(\.[0-9]+)?", m[1]):
            raise FormError(f"malformed expression: {text!r}")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


def expression(text: str, fields: dict[str, Column]) -> Column:
    """A column that evaluates text over fields: an unknown name is 0, and so are division by zero and what isn't finite.

    Digits with at most one point are numbers; a name begins with a letter or underscore. Anything but the forms above
    is refused.
    """
    left = _tokens(text)[::-1]

    def take(want: str | None = None) -> str:
        token = left.pop() if left else ""
        if not token or want and token != want:
            raise FormError(f"malformed expression: {text!r}, at {token or 'its end'}")
        return token

    def primary() -> Column:
        token = take()
        if token == "-":
            return -primary()
        if token == "(":
            inner = total()
            take(")")
            return inner
        if token in ("min", "max"):
            take("(")
            a = total()
            take(",")
            b = total()
            take(")")
            return (F.least if token == "min" else F.greatest)(a, b)
        if token[0].isdigit():
            return F.lit(float(token))
        if token in ")+*/,":
            raise FormError(f"malformed expression: {text!r}, at {token}")
        return F.coalesce(fields[token].cast("double"), F.lit(0.0)) if token in fields else F.lit(0.0)

    def product() -> Column:
        made = primary()
        while left and left[-1] in "*/":
            made = made * primary() if take() == "*" else F.coalesce(F.try_divide(made, primary()), F.lit(0.0))
        return made

    def total() -> Column:
        made = product()
        while left and left[-1] in "+-":
            made = made + product() if take() == "+" else made - product()
        return made

    made = total()
    if left:
        raise FormError(f"malformed expression: {text!r}, at {left[-1]}")
    return F.when(F.isnan(made) | (F.abs(made) == float("inf")), 0.0).otherwise(made)
