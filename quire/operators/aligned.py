"""Find and replace on text as it is set: ligatures, accents of their own, soft hyphens, words broken at line ends.

A block's text is read as units: a character, or the gap between two words or two lines. A unit stands for the tokens that
a search compares: its compatibility form in folded case, one token a code point. A ligature has several; a soft hyphen,
an accent that makes one letter with the one before it, and a hyphen that only breaks a word have none. So the text that
is searched carries, token by token, the unit it comes from, and a unit the stretch of the source it stands for.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple
from unicodedata import category, normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions import text as tx
from quire.functions.expressions import FormError
from quire.operators.groups import slices

# What parts the words of a line, and the hyphens (ASCII, true, soft) that may break a word at a line's end.
WORD = re.compile("[^ \t\r\f\xa0\n]+")
HYPHENS = "-\u2010\u00ad"
SOFT = "\u00ad"
KEPT_CASE = {ord(c): ord(c) + 32 for c in "ABCDEFGHJKLMNOPQRSTUVWXYZ"}  # I is either i, so it stays
KEPT_WORD = 64
EITHER = {"I": "[Iiı]", "i": "[iI]", "ı": "[ıI]"}


@lru_cache(1 << 14)
def folded(piece: str, match_case: bool) -> str:
    """The tokens of a piece of text."""
    whole = normalize("NFKC", piece)
    if match_case:
        return whole
    return "".join("I" if c == "I" else "i" if c == "İ" else "σ" if c == "ς" else "s" if c == "ſ" else c.lower() for c in whole)


@lru_cache(1 << 14)
def is_mark(c: str) -> bool:
    return category(c)[0] == "M"


class Units(NamedTuple):
    """Units by number: their tokens, their source (start, and end exclusive, in code points), and how they read."""

    tokens: list[str]
    starts: list[int]
    ends: list[int]
    reads: list[str]


@lru_cache(1 << 14)
def _character(c: str, match_case: bool) -> tuple[str, bool, str]:
    """The tokens of a character by itself, whether it is a mark, and its composed form."""
    return "" if c == SOFT else folded(c, match_case), is_mark(c), normalize("NFC", c)


@lru_cache(1 << 14)
def _spelled(word: str, match_case: bool) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The tokens of each character of a word, and how it reads."""
    made, reads = [], []
    base, letter = -1, ""  # the unit that an accent may join, and what it spells so far
    for c in word:
        tokens, mark, own = _character(c, match_case)
        if not mark:
            base, letter = (-1, "") if c == SOFT else (len(made), own)
        elif base >= 0 and len(joined := normalize("NFC", letter + c)) == len(letter):
            letter, tokens = joined, ""
            made[base] = folded(joined, match_case)
        made.append(tokens)
        reads.append("" if c == SOFT else c)
    return tuple(made), tuple(reads)


def _spell(units: Units, text: str, at: int, stop: int, match_case: bool) -> None:
    """Add the characters of one word. What a short word spells is kept, as words come again."""
    word = text[at:stop]
    if word.isascii():
        units.tokens.extend(word if match_case else word.translate(KEPT_CASE))
        units.reads.extend(word)
    else:
        tokens, reads = (_spelled if len(word) <= KEPT_WORD else _spelled.__wrapped__)(word, match_case)
        units.tokens.extend(tokens)
        units.reads.extend(reads)
    units.starts.extend(range(at, stop))
    units.ends.extend(range(at + 1, stop + 1))


def units_of(text: str, match_case: bool = False) -> Units:
    """The units of a block: its lines parted by line feeds, their words by white space. Lines without a word don't count."""
    units, before = Units([], [], [], []), 0
    for word in WORD.finditer(text):
        at, stop = word.span()
        if units.tokens:
            breaks = "\n" in text[before:at]
            if breaks and text[before - 1] in HYPHENS:
                if category(text[at]) == "Ll":
                    units.tokens[-1] = units.reads[-1] = ""
            else:
                units.tokens.append(" ")
                units.starts.append(before)
                units.ends.append(at)
                units.reads.append(" ")
        _spell(units, text, at, stop, match_case)
        before = stop
    return units


def search_tokens(needle: str, match_case: bool = False) -> str:
    """What a search looks for: compatibility form, trimmed, white space folded, in folded case."""
    return folded(" ".join(normalize("NFKC", needle).split()), match_case)


def _in_word(token: str) -> bool:
    return token != "" and (token == "_" or category(token)[0] in "LNM")


class Match(NamedTuple):
    start: int
    end: int
    aligned: bool
    reads: str


def matches(text: str, needle: str, match_case: bool = False, whole_word: bool = False) -> Iterator[Match]:
    """Matches from left to right. An aligned one begins and ends with whole units, takes the accents that follow it, and
    the next begins after it; one that cuts a unit is reported as not aligned, and the search goes on a token further."""
    tokens = search_tokens(needle, match_case)
    if tokens:
        yield from _found(text, Line.of(text, match_case), tokens, match_case, whole_word)


class Line(NamedTuple):
    """A block as it is searched: its units, their tokens in one, and where each unit's begin."""

    units: Units
    tokens: str
    first: list[int]

    @classmethod
    def of(cls, text: str, match_case: bool) -> Line:
        units = units_of(text, match_case)
        return cls(units, "".join(units.tokens), list(accumulate(map(len, units.tokens), initial=0)))


def _found(text: str, line: Line, tokens: str, match_case: bool, whole_word: bool) -> Iterator[Match]:
    pattern = re.compile(re.escape(tokens) if match_case else "".join(EITHER.get(c) or re.escape(c) for c in tokens))
    units, whole, first = line
    owner = lambda token: bisect_right(first, token) - 1
    opens = lambda token: token == len(whole) or first[owner(token)] == token
    at = 0
    while found := pattern.search(whole, at):
        a, b = found.span()
        if whole_word and (_in_word(whole[a - 1 : a]) or _in_word(whole[b : b + 1])):
            at = a + 1
            continue
        aligned, head, tail = opens(a) and opens(b), owner(a), owner(b - 1)
        while aligned and tail + 1 < len(units.reads) and is_mark(text[units.starts[tail + 1]]):
            tail += 1
        yield Match(units.starts[head], units.ends[tail], aligned, "".join(units.reads[head : tail + 1]))
        at = b if aligned else a + 1


def _per_text(blocks: DataFrame, key: list[str], made: str, rows) -> DataFrame:
    """key and the columns of `made` for each tuple that rows gives for a block's text (null: empty)."""
    narrow = blocks.select(*key, F.coalesce("text", F.lit("")).alias("__text"))
    schema = StructType([*narrow.drop("__text").schema.fields, *StructType.fromDDL(made).fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            at, out = [], []
            for k, text in enumerate(batch.column("__text").to_pylist()):
                found = list(rows(text))
                at += [k] * len(found)
                out += found
            if out:
                kept = batch.drop_columns(["__text"]).take(pa.array(at))
                own = [pa.array(c, types.field(len(key) + k).type) for k, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, types, strict=False)] + own, schema=types)

    return narrow.mapInArrow(run, schema)


def folded_blocks(blocks: DataFrame, key: list[str], match_case: bool = False) -> DataFrame:
    """key, folded and sources of each block (key, text): what a search compares, and the code point in the source at which
    the unit of each of its tokens starts."""

    def rows(text: str):
        units = units_of(text, match_case)
        yield "".join(units.tokens), [at for at, t in zip(units.starts, units.tokens, strict=True) for _ in t]

    return _per_text(blocks, key, "folded string, sources array<int>", rows)


def aligned_matches(blocks: DataFrame, key: list[str], needle: str, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """key, start, stop, aligned and reads of all matches in blocks (key, text); offsets are code points of the text."""

    def rows(text: str):
        return matches(text, needle, match_case, whole_word)

    return _per_text(blocks, key, "start int, stop int, aligned boolean, reads string", rows)


def searched(blocks: DataFrame, key: list[str], searches: list[tuple[str, bool]], match_case: bool = False) -> DataFrame:
    """key, needle, start, stop, aligned and reads of all matches of each (needle, whole word) in blocks (key, text), as
    aligned_matches gives them. A text is read once for all of them."""
    wanted = [(needle, tokens, whole) for needle, whole in searches if (tokens := search_tokens(needle, match_case))]

    def rows(text: str):
        line = Line.of(text, match_case)
        return ((needle, *m) for needle, tokens, whole in wanted for m in _found(text, line, tokens, match_case, whole))

    return _per_text(blocks, key, "needle string, start int, stop int, aligned boolean, reads string", rows)


def replace_report(blocks: DataFrame, key: list[str], needle: str, replacement: str, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """key (of documents), found, replaced, skipped, unchanged, changed_pages and skipped_pages, of blocks (key, page, text,
    editable) that hold a match.

    A match that isn't aligned, or stands in a block that isn't editable, is skipped; of the others one that already reads
    as the replacement is unchanged, the rest is replaced.
    """
    if tx.re.search(tx.FORBIDDEN, replacement):
        raise FormError("the replacement holds a character that text can't show")
    found = aligned_matches(blocks, [*key, "page", "editable"], needle, match_case, whole_word)
    same = F.regexp_replace("reads", r"\s+", " ") == F.lit(replacement)
    able = F.col("aligned") & F.col("editable")
    pages: Column = lambda kept: F.array_sort(F.collect_set(F.when(kept, F.col("page"))))
    counted = lambda kept: F.count(F.when(kept, 1))
    return found.groupBy(*key).agg(
        F.count("*").alias("found"), counted(able & ~same).alias("replaced"), counted(~able).alias("skipped"), counted(able & same).alias("unchanged"),
        pages(able & ~same).alias("changed_pages"), pages(~able).alias("skipped_pages"),
    )
