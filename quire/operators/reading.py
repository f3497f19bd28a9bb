"""Reading order, block text, reflow, tables without rules, and edits of a structure tree."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from quire.functions.text import fold
from quire.operators.groups import slices, walk_groups


@F.pandas_udf(StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    """Unicode's NFKC, which Spark has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def find_tokens(needle: Column) -> Column:
    """What a search looks for: normalised, trimmed, white space folded, in folded case."""
    return fold(F.trim(F.regexp_replace(compatibility_form(needle), r"\s+", " ")))


def block_units(text: Column) -> Column:
    """A block's lines as running text: a line's last hyphen goes before a small letter, other line ends are spaces."""
    joined = F.regexp_replace(text, r"[-\u2010\u00ad]\n(?=\p{Ll})", "")
    return F.regexp_replace(joined, r"[ \n]+", " ")


def reading_places(units: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Add place, from 0, to units (direction: rtl, ltr or null; rtl_base) that stand from left to right.

    A unit without a direction takes that of both strong neighbours, or else the base. In a line of rtl base runs are
    read from the right, and ltr runs keep their inner order; otherwise runs are read from the left, rtl ones backwards.
    """
    w = Window.partitionBy(*key).orderBy(order)
    base = F.when(F.col("rtl_base"), "rtl").otherwise("ltr")
    before = F.coalesce(F.last("direction", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), base)
    # from the other end: a frame that ends with the line would be gone through anew for each unit
    turned_round = Window.partitionBy(*key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.last("direction", ignorenulls=True).over(turned_round), base)
    own = units.withColumn("__d", F.coalesce("direction", F.when(before == after, before).otherwise(base)))
    turned = F.when(F.col("__d") != F.lag("__d", 1, "").over(w), 1).otherwise(0)
    runs = own.withColumn("__turn", turned).withColumn("__run", F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    outer = F.when(F.col("rtl_base"), -F.col("__run")).otherwise(F.col("__run"))
    inner = F.when(F.col("__d") == "rtl", -F.col(order)).otherwise(F.col(order))
    placed = Window.partitionBy(*key).orderBy(outer, inner)
    return runs.withColumn("place", F.row_number().over(placed) - 1).drop("__d", "__turn", "__run")


def reflowed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, lines): the words of each text in lines as long as fit the width; a longer word stands alone."""

    def wrap(text: str) -> list[str]:
        out: list[str] = []
        used = width + 1
        for word in text.split():
            if used + 1 + len(word) <= width:
                out[-1].append(word)
                used += 1 + len(word)
            else:
                out.append([word])
                used = len(word)
        return [" ".join(x) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            lines = [wrap(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lines, pa.list_(pa.string()))], names=["doc_id", "lines"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lines array<string>")


def text_columns(pieces: DataFrame, near: float = 8, reach: float = 4) -> DataFrame:
    """(page, row, column, text) of (page, row, x, text): left edges further than 8 from the last anchor start a column;
    a piece takes the last anchor up to 4 beyond its edge, or the place after the piece before it in the row."""

    def walk(page):
        own = sorted(page, key=lambda p: (p.row, p.x))
        anchors: list[float] = []
        for x in sorted(p.x for p in own):
            if not anchors or x - anchors[-1] > near:
                anchors.append(x)
        row, column = None, -1
        for p in own:
            at = max((k for k, a in enumerate(anchors) if a <= p.x + reach), default=0)
            column = at if p.row != row else max(at, column + 1)
            row = p.row
            yield p.page, p.row, column, p.text

    return walk_groups(pieces, "page", ["row", "x"], walk, "page long, row int, column int, text string")


# How long a line of prose is at the median, and the share of its column that a wrapped one fills.
PROSE_LINE, PROSE_FILL = 20, 0.92


def stream_tables(pieces: DataFrame, longest: float = 30, slack: float = 2, dealt_out: bool = False) -> DataFrame:
    """(page, table, row, column, text) of tables without rules, from (page, row, top, bottom, x0, x1, text).

    Rows of two pieces or more, no further apart than one and a half of their height, make a run; its columns are the
    stretches that its pieces cover, merged where they come within the slack. A run is a table if cells are short on
    average, columns are 2 to 20, fewer than two of them hold prose, and two rows or more fill two columns. Where there is
    a column `block`, three or more pieces of one block in a column, long at the median, are prose if the block stands in
    no other column, or if each but the last holds words and fills the column's width.
    """
    blocks = "block" in pieces.columns

    def prose(own: list, column_of) -> int:
        groups, places = {}, {}
        for p in own:
            groups.setdefault((column_of(p), p.block), []).append(p)
            places.setdefault(p.block, set()).add(column_of(p))
        found = set()
        for (column, block), lines in groups.items():
            if len(lines) < 3 or sorted(len(p.text) for p in lines)[len(lines) // 2] < PROSE_LINE:
                continue
            inside = [p for p in own if column_of(p) == column]
            width = max(p.x1 for p in inside) - min(p.x0 for p in inside)
            if places[block] == {column} or all(" " in p.text and p.x1 - p.x0 >= PROSE_FILL * width for p in lines[:-1]):
                found.add(column)
        return len(found)

    def table_of(run: list[list]) -> list[tuple[int, int, str]]:
        own = [p for row in run for p in row]
        if len(run) < 2 or sum(len(p.text) for p in own) / len(own) > longest:
            return []
        spans: list[list[float]] = []
        for p in sorted(own, key=lambda p: p.x0):
            if spans and p.x0 <= spans[-1][1] + slack:
                spans[-1][1] = max(spans[-1][1], p.x1)
            else:
                spans.append([p.x0, p.x1])
        if not 2 <= len(spans) <= 20:
            return []
        column_of = lambda p: next(c for c, (a, b) in enumerate(spans) if a <= p.x0 and p.x1 <= b)
        if blocks and prose(own, column_of) >= 2:
            return []
        cells: dict[tuple[int, int], list[str]] = {}
        for k, row in enumerate(run):
            for p in row:
                cells.setdefault((k, column_of(p)), []).append(p.text)
        full = sum(sum(r == k for r, _ in cells) >= 2 for k in range(len(run)))
        return [(r, c, " ".join(t)) for (r, c), t in sorted(cells.items())] if full >= 2 else []

    def walk(page):
        rows: list[list] = []
        for p in page:
            if rows and rows[-1][0].row == p.row:
                rows[-1].append(p)
            else:
                rows.append([p])
        number, run = 0, []
        for row in [*rows, []]:
            gap = row and run and min(p.top for p in row) - max(p.bottom for p in run[-1]) > 1.5 * (row[0].bottom - row[0].top)
            if run and (len(row) < 2 or gap):
                cells = table_of(run)
                yield from ((run[0][0].page, number, r, c, t) for r, c, t in cells)
                number, run = number + bool(cells), []
            if len(row) >= 2:
                run.append(row)

    return walk_groups(pieces, "page", ["row", "x0"], walk, "page long, table int, row int, column int, text string", dealt_out)


def edited(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, parent, role) after edits (key, action, value), one a node: `role` renames, `move` hangs a node elsewhere,
    `unwrap` takes it out and hands its children to its parent, `drop` makes it and all directly in it loose (no parent)."""
    e = edits.select("key", F.col("action").alias("a"), F.col("value").alias("v"))
    own = nodes.join(e, "key", "left")
    up = own.where("a in ('unwrap', 'drop')").select(F.col("key").alias("parent"), F.when(F.col("a") == "unwrap", F.col("parent")).alias("to"), F.lit(True).alias("gone"))
    out = own.where("coalesce(a, '') not in ('unwrap', 'drop')").join(up, "parent", "left")
    parent = F.when(F.col("a") == "move", F.col("v")).when(F.col("gone"), F.col("to")).otherwise(F.col("parent"))
    return out.select("key", parent.alias("parent"), F.when(F.col("a") == "role", F.col("v")).otherwise(F.col("role")).alias("role"))
