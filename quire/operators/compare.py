"""Comparison of documents: lines, words, multisets and grey pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, _parse_datatype_string

from quire.functions.text import BLANK, words

TRAILING = re.compile(rf"{BLANK}+\Z")
CELLS, WORD_CELLS = 250_000, 4096  # of the table of a common subsequence, for lines and for words
SMALL = 4096  # cells of a table that is kept whole


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """The edit script of two lists as ('same' | 'removed' | 'added', i, j); on a tie a removal comes first."""
    n, m = len(a), len(b)
    if (n + 1) * (m + 1) > SMALL:
        return _long_subsequence(a, b)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = table[i], table[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(("same", i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            out.append(("removed", i, j))
            i += 1
        else:
            out.append(("added", i, j))
            j += 1
    return out + [("removed", k, j) for k in range(i, n)] + [("added", n, k) for k in range(j, m)]


def _long_subsequence(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """common_subsequence() of long lists: each root-n-th row of the table is kept, and those between are made again when
    the script gets there, so no more than about two root-n rows are held."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(v, len(number)) for v in side], np.int64) for side in (a, b))
    n, m = len(a), len(b)
    step = max(1, int(n**0.5))

    def above(i: int, below: np.ndarray) -> np.ndarray:
        best = np.where(y == x[i], below[1:] + 1, below[:-1])  # a match is never worse than what stands right of it
        return np.append(np.maximum.accumulate(best[::-1])[::-1], 0).astype(np.int32)

    row = np.zeros(m + 1, np.int32)
    kept = {n: row}
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            kept[i] = row
    out, i, j, block = [], 0, 0, {}
    while i < n and j < m:
        if i not in block or i + 1 not in block:
            top = min(n, (i // step + 1) * step)
            block = {top: kept[top]}
            for k in range(top - 1, i - 1, -1):
                block[k] = above(k, block[k + 1])
        if x[i] == y[j]:
            out.append(("same", i, j))
            i, j = i + 1, j + 1
        elif block[i + 1][j] >= block[i][j + 1]:
            out.append(("removed", i, j))
            i += 1
        else:
            out.append(("added", i, j))
            j += 1
    return out + [("removed", k, j) for k in range(i, n)] + [("added", n, k) for k in range(j, m)]


def word_changes(before: str, after: str, cells: int | None = WORD_CELLS) -> list[tuple[str, str]] | None:
    """(kind, word) of the words that differ, in order; None beyond `cells`, where that is given."""
    a, b = before.split(), after.split()
    if cells is not None and (len(a) + 1) * (len(b) + 1) > cells:
        return None
    return [("removed", a[i]) if kind == "removed" else ("added", b[j]) for kind, i, j in common_subsequence(a, b) if kind != "same"]


def line_changes(left: str, right: str, cells: int | None = CELLS, word_cells: int | None = WORD_CELLS) -> list[tuple]:
    """(kind, left line, right line, text, text before, words, reason) with lines from 1: lines are right-trimmed and
    empty ones dropped; a run of removals meets the run of additions beside it one to one as `changed`, with its
    word_changes(). Beyond `cells` the middle counts as replaced, which is the reason `line-matrix` of its rows;
    `word-matrix` is that of changes without words. None stands for no bound."""
    a, b = ([x for x in (TRAILING.sub("", line) for line in side.split("\n")) if x] for side in (left, right))
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    whole = cells is not None and (len(x) + 1) * (len(y) + 1) > cells
    script = [("removed", k, 0) for k in range(len(x))] + [("added", 0, k) for k in range(len(y))] if whole else common_subsequence(x, y)
    reason = "line-matrix" if whole else None
    out, gone, new = [], [], []

    def close() -> None:
        for i, j in zip(gone, new):  # noqa: B905
            words = word_changes(x[i], y[j], word_cells)
            out.append(("changed", i + start + 1, j + start + 1, y[j], x[i], words, reason or ("word-matrix" if words is None else None)))
        out.extend(("removed", i + start + 1, None, x[i], None, None, reason) for i in gone[len(new) :])
        out.extend(("added", None, j + start + 1, y[j], None, None, reason) for j in new[len(gone) :])
        gone.clear()
        new.clear()

    for kind, i, j in script:
        if kind == "same":
            close()
        elif kind == "removed":
            gone.append(i)
        else:
            new.append(j)
    close()
    return out


def compare_pages(left: DataFrame, right: DataFrame, cells: int | None = CELLS, word_cells: int | None = WORD_CELLS) -> DataFrame:
    """(pair, page, kind, left_line, right_line, text, previous, words, reason) of two tables (pair, page, text), met by a
    full join; see line_changes().

    A page's lines are compared in its own row, so no pair of documents is gathered.
    """
    both = left.select("pair", "page", F.col("text").alias("l")).join(right.select("pair", "page", F.col("text").alias("r")), ["pair", "page"], "full")
    words = "words array<struct<kind:string,word:string>>"
    schema = f"pair {dict(left.dtypes)['pair']}, page int, kind string, left_line int, right_line int, text string, previous string, {words}, reason string"
    made = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(4)]
            rows = [(p, g, *c) for p, g, x, y in zip(*columns, strict=True) for c in line_changes(x or "", y or "", cells, word_cells)]
            if rows:
                yield pa.RecordBatch.from_arrays([_arrow(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)

    return both.mapInArrow(run, schema)


def _arrow(column: tuple, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind):
        column = [c if c is None else [{"kind": k, "word": w} for k, w in c] for c in column]
    return pa.array(column, kind)


def summary(changes: DataFrame, status: DataFrame) -> DataFrame:
    """(pair, added_lines, removed_lines, changed_lines, identical, changed, added, removed, truncated, reasons) of what
    compare_pages() and page_status() found: exact counters, and why any page is not compared in full."""
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_lines")
    lines = changes.groupBy("pair").agg(kind("added"), kind("removed"), kind("changed"), F.sort_array(F.collect_set("reason")).alias("reasons"))
    pages = status.groupBy("pair").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("identical", "changed", "added", "removed")])
    both = pages.join(lines, "pair", "left").fillna(0, ["added_lines", "removed_lines", "changed_lines"])
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    return both.select("pair", "added_lines", "removed_lines", "changed_lines", "identical", "changed", "added", "removed", (F.size(reasons) > 0).alias("truncated"), reasons.alias("reasons"))


def page_status(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair, page, status): identical, changed, added or removed, by right-trimmed non-empty lines, trimmed as line_changes
    trims them."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, rf"{BLANK}+\z", "")), lambda x: x != "")
    both = left.select("pair", "page", lines("text").alias("l")).join(right.select("pair", "page", lines("text").alias("r")), ["pair", "page"], "full")
    status = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.col("l") == F.col("r"), "identical").otherwise("changed")
    return both.select("pair", "page", status.alias("status"))


def word_recall(source: DataFrame, result: DataFrame) -> DataFrame:
    """(pair, words, kept, recall): how many of the source's words, as a multiset, the result still has.

    Recall is null for a source without words. Words are 64-bit hashes, made in the text's own row; a text's hashes go to the
    place of its pair once, and are counted and compared there.
    """

    def hashed(rows: DataFrame, own: int) -> DataFrame:
        # sorted, as equal ones side by side take less room on the way
        return rows.select("pair", F.sort_array(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("hashes"), F.lit(own).alias("own"))

    both = hashed(source, 1).unionByName(hashed(result, 0)).repartition("pair")
    each = both.select("pair", F.explode("hashes").alias("h"), "own").groupBy("pair", "h").agg(F.sum("own").alias("n"), F.sum(1 - F.col("own")).alias("m"))
    sums = each.groupBy("pair").agg(F.sum("n").alias("words"), F.sum(F.least("n", "m")).alias("kept"))
    every = source.select("pair").distinct().join(sums, "pair", "left").fillna(0, ["words", "kept"])
    return every.withColumn("recall", F.when(F.col("words") > 0, F.col("kept") / F.col("words")))


def tiles_that_differ(pixels: DataFrame, tile: int = 16, tolerance: int = 16) -> DataFrame:
    """(page, tx, ty, pixels, differing) of two greys a pixel: (page, x, y, a, b)."""
    off = F.when(F.abs(F.col("a") - F.col("b")) > tolerance, 1).otherwise(0)
    return pixels.groupBy("page", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(F.count("*").alias("pixels"), F.sum(off).alias("differing"))


def grey_difference(pixels: DataFrame, key: list[str], tile: int = 16, most_off: float = 0.01) -> DataFrame:
    """key, mean, worst and shape_differs of two greys a pixel (x, y, a, b, and the pages' sizes aw, ah, bw, bh): the mean
    absolute difference, 0 to 1, that of the worst tile, and whether the pages' aspect ratios differ by over 1 %."""
    tiles = pixels.groupBy(*key, F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(
        F.sum(F.abs(F.col("a") - F.col("b"))).alias("d"), F.count("*").alias("n"), F.first(F.col("aw") / F.col("ah")).alias("l"), F.first(F.col("bw") / F.col("bh")).alias("r")
    )
    off = F.abs(F.first("l") - F.first("r")) > most_off * F.greatest(F.first("l"), F.first("r"))
    return tiles.groupBy(*key).agg((F.sum("d") / F.sum("n") / 255).alias("mean"), F.max(F.col("d") / F.col("n") / 255).alias("worst"), off.alias("shape_differs"))


def best_match(scores: DataFrame, key: list[str], name: str, score: str) -> DataFrame:
    """key, best, score and second: the candidate with the highest median score, and the next; the first by name of
    equals."""
    middle = scores.groupBy(*key, name).agg(F.median(score).alias("s"))
    listed = middle.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), F.col(name).alias("f")))).alias("l"))
    return listed.select(*key, F.col("l")[0]["f"].alias("best"), (-F.col("l")[0]["s"]).alias("score"), F.get("l", F.lit(1))["f"].alias("second"))


def _word_edits(a: list[str], b: list[str]) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@F.pandas_udf(IntegerType())
def word_edits(want: pd.Series, got: pd.Series) -> pd.Series:
    """The edit distance in words."""
    return pd.Series([_word_edits(a.split(), b.split()) for a, b in zip(want.fillna(""), got.fillna(""), strict=True)])


def error_rates(rows: DataFrame, key: list[str], want: str, got: str) -> DataFrame:
    """key, cer and wer of got against want: edits in characters and in words over all rows of a key, by their number in
    want, so long rows count for more. Null where want has none."""
    count = F.size(F.filter(F.split(F.col(want), r"(?U)\s+"), lambda w: w != ""))
    sums = rows.select(*key, F.levenshtein(F.col(want), F.col(got)).alias("e"), F.length(want).alias("n"), word_edits(F.col(want), F.col(got)).alias("we"), count.alias("wn"))
    over = lambda e, n: F.when(F.sum(n) > 0, F.sum(e) / F.sum(n))
    return sums.groupBy(*key).agg(over("e", "n").alias("cer"), over("we", "wn").alias("wer"))


def kind_counts(rows: DataFrame, kind: str, hidden: list[str]) -> DataFrame:
    """How many annotations there are of each kind but the hidden ones."""
    return rows.where(~F.col(kind).isin(*hidden)).groupBy(kind).agg(F.count("*").alias("n"))
