"""Column functions over text: case folding, search, words, escapes and snippets."""

from __future__ import annotations

from collections.abc import Callable

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 32
# Characters that a replacement may not hold (controls, zero-width, bidi marks, soft hyphen).
FORBIDDEN = r"[\x00-\x08\x0b-\x1f\x7f-\x9f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]"
# White space as scripts trim it (Unicode's, with the line ends and the byte order mark), and what stands
# between the words of a line.
BLANK = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
GAP = r"[ \t\r\n\f\u00a0]"
# Letters written from right to left.
RIGHT_TO_LEFT = r"[\u0590-\u08ff\ufb1d-\ufdff\ufe70-\ufeff]"


def fold(text: Column) -> Column:
    """Case folding a character at a time: dotted capital i and long s first, final sigma last."""
    return F.translate(F.lower(F.translate(text, "İſ", "is")), "ς", "σ")


def needle_pattern(needle: str) -> str:
    """A pattern over unfolded text that finds a needle in any case.

    Capital I equals i and dotless i, though those two differ, so no folding can stand for it; dotted capital I equals
    i and capital I.
    """
    classes = {"I": "[Iiıİ]", "i": "[iIİ]", "İ": "[iIİ]", "ı": "[ıI]", "s": "[sSſ]", "S": "[sSſ]", "σ": "[σςΣ]", "ς": "[σςΣ]", "Σ": "[σςΣ]"}
    out = []
    for c in needle:
        other = c.upper() if c.islower() else c.lower()
        out.append(classes.get(c) or (f"[{re.escape(c)}{re.escape(other)}]" if len(other) == 1 and other != c else re.escape(c)))
    return "".join(out)


def match_starts(text: Column, pattern: str, length: int) -> Column:
    """Code-point starts of the non-overlapping matches, left to right, of a pattern that matches `length` characters."""

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.length(piece)
        return F.struct((at + length).alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    ends = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.slice(ends, F.lit(1), F.size(pieces) - 1)


def snippet(text: Column, start: Column, length: int) -> Column:
    """Up to SNIPPET characters on either side of a match, with an ellipsis where the text goes on."""
    first = F.greatest(start - SNIPPET, F.lit(0))
    last = F.least(start + length + SNIPPET, F.length(text))
    body = F.substring(text, first + 1, last - first)
    return F.concat(F.when(first > 0, "…").otherwise(""), body, F.when(last < F.length(text), "…").otherwise(""))


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def is_forbidden(text: Column) -> Column:
    return text.rlike(FORBIDDEN)


def whole_word_count(text: Column, word: str) -> Column:
    """Occurrences of a word between characters that are no letter, digit, mark or underscore; case doesn't matter."""
    edge = r"[\p{L}\p{N}\p{M}_]"
    return F.regexp_count(text, F.lit(rf"(?<!{edge}){needle_pattern(word)}(?!{edge})"))


def markdown_escape(paragraph: Column) -> Column:
    """A paragraph so that Markdown shows it as written: marks that count anywhere, the start of an entity, and at the
    very start what opens a heading, a quote, a list or (after up to nine digits) a numbered item. The three expressions
    hold fixed values: what Markdown reads as syntax."""
    inline = F.regexp_replace(paragraph, r"([\\`*_\[<~]|&(?=#?\w+;))", r"\\$1")
    opened = F.regexp_replace(inline, r"^([#>+-])", r"\\$1")
    return F.regexp_replace(opened, rf"^(\d{{1,9}})([.)])(?={BLANK}|\z)", r"$1\\$2")


def filled_template(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {name} of values replaced; other braces stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def html_escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def safe_suffix(title: Column, longest: int = 60) -> Column:
    """A title as the end of a file name: reserved and control characters go, white space folds, at most 60 characters,
    no dots or spaces at its edges, after a hyphen; nothing where none is left."""
    bare = F.regexp_replace(title, r'[\x00-\x1f\x7f\\/:*?"<>|]+', " ")
    cut = F.left(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), F.lit(longest))
    name = F.regexp_replace(cut, r"^[. ]+|[. ]+$", "")
    return F.when(name == "", "").otherwise(F.concat(F.lit("-"), name))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once: what stands in an expression several times is otherwise worked out as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
