"""Text of pages from pieces laid out on them: lines, reading order, paragraphs, and one file a document.

The line a piece joins depends on the pieces before it, so a page's pieces are walked together, and a task holds one page of
them; lines leave as their texts. All else (lines written from the right, paragraphs, the file) is windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import RIGHT_TO_LEFT, markdown_escape, utf16_length
from quire.operators.groups import sort_keys, whole_groups
from quire.operators.reading import reading_places

# Fixed values, as shares of the larger size: what parts paragraphs, and what is a space.
PARAGRAPH_GAP, WORD_GAP = 1.6, 0.15
# What a line holds of its pieces, in the order by which they stand from left to right.
PIECE = ["x", "ord", "width", "size", "text"]
# White space as Unicode has it, and letters written from the right.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
FROM_RIGHT = rf"[{RIGHT_TO_LEFT}&&\p{{L}}]"
BOM = "﻿"
# Classes of characters for the order of display; letters are told by their script.
CLASSES = (
    ("EN", r"[0-9۰-۹]"), ("AN", r"[٠-٩٫٬]"), ("ES", r"[+\-−]"), ("ET", r"[#$%¢-¥°٪‰‱₠-⃏]"),
    ("CS", r"[,./: ]"), ("AL", r"(?=\p{L})[؀-޿ࡠ-ࣿﭐ-﷿ﹰ-﻿]"), ("R", rf"(?=\p{{L}}){RIGHT_TO_LEFT}"), ("L", r"\p{L}"),
)


def letters(text: Column, rtl: bool) -> Column:
    """How many letters of the text are written from the right, or from the left."""
    right = rf"(?=\p{{L}}){RIGHT_TO_LEFT}"
    return F.regexp_count(text, F.lit(right if rtl else rf"(?!{RIGHT_TO_LEFT})\p{{L}}"))


def direction_of(text: Column) -> Column:
    """rtl for a text with a letter written from the right, ltr for one with other letters alone, else null."""
    return F.when(letters(text, True) > 0, "rtl").when(letters(text, False) > 0, "ltr")


def _lines_of(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The lines, as in placed_lines, of the pieces of whole pages."""
    places = [rows.column(c).to_numpy(zero_copy_only=False) for c in ("page", "y", "size")]
    starts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in places])) + 1])
    run_pages, ys, sizes = (rows.column(c).take(pa.array(starts)).to_pylist() for c in ("page", "y", "size"))
    page, number, lines, known, found = None, -1, [], {}, []
    for own, y, size in zip(run_pages, ys, sizes, strict=True):
        if own != page or number < 0:
            page, number, lines, known = own, number + 1, [], {}
        line = known.get((y, size))
        if line is None:
            near = max(1.0, size * 0.5)
            line = known[y, size] = next((k for k, other in enumerate(lines) if abs(other - y) <= near), len(lines))
            if line == len(lines):
                lines.append(y)
        found.append((number, line, lines[line]))
    number, line, line_y = (np.repeat(np.array(c), np.diff([*starts, rows.num_rows])) for c in zip(*found, strict=True))
    x, order = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("x", "ord"))
    same = (number[1:] == number[:-1]) & (line[1:] == line[:-1])
    later = (number[1:] > number[:-1]) | ((number[1:] == number[:-1]) & (line[1:] > line[:-1])) | (same & ((x[1:] > x[:-1]) | ((x[1:] == x[:-1]) & (order[1:] > order[:-1]))))
    at = np.arange(rows.num_rows)
    if any(rows.column(c).null_count for c in PIECE) or not later.all():
        at = np.lexsort([*(k for c in reversed(PIECE) for k in sort_keys(rows.column(c))), line, number])
        rows, number, line, line_y = rows.take(pa.array(at)), number[at], line[at], line_y[at]
    first = np.concatenate([[0], np.flatnonzero((number[1:] != number[:-1]) | (line[1:] != line[:-1])) + 1])
    size = pa.array(np.maximum.reduceat(places[2][at], first)).cast(rows.column("size").type)
    pieces = pa.ListArray.from_arrays(pa.array([*first, rows.num_rows], pa.int32()), pa.StructArray.from_arrays([rows.column(c) for c in PIECE], PIECE))
    columns = [rows.column("page").take(pa.array(first)), pa.array(line[first], pa.int32()), pa.array(line_y[first], pa.float64()), size, pieces]
    return pa.RecordBatch.from_arrays(columns, names=["page", "line", "y", "size", "pieces"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of pieces that come a page after the other."""
    yield from map(_lines_of, whole_groups(batches, "page"))


def _spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, line, y, size, text) of lines with their pieces as they are read, but for blank ones: a gap between near edges
    is a space, and so is all white space."""
    for batch in batches:
        own = batch.column("pieces")
        piece = own.flatten()
        x, width, size = (pc.struct_field(piece, c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "width", "size"))
        gap = np.fmax(x[1:] - (x[:-1] + width[:-1]), x[:-1] - (x[1:] + width[1:]))
        count = pc.list_value_length(own).to_numpy()
        ends = np.cumsum(count)
        apart = np.concatenate([[False], gap > WORD_GAP * np.fmax(size[1:], size[:-1])])[: len(x)]
        apart[(ends - count)[count > 0]] = False
        spaced = pc.fill_null(pc.binary_join_element_wise(pc.if_else(pa.array(apart), " ", ""), pc.struct_field(piece, "text"), ""), "")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), spaced), "")
        text = pc.utf8_trim(pc.replace_substring_regex(text, f"[{SPACE}]+", " "), " ")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page", "line", "y", "size")), text], names=["page", "line", "y", "size", "text"]).filter(pc.not_equal(text, ""))


def _together(pieces: DataFrame, together: bool) -> DataFrame:
    return pieces if together else pieces.repartition("page").sortWithinPartitions("page", "ord")


def placed_lines(pieces: DataFrame, together: bool = False) -> DataFrame:
    """(page, line, y, size, pieces) of pieces (page, ord, text, x, y, size, width), y upwards: each joins the first line of
    its page within half its size (1 at least) of that line's first piece, or starts one.

    A line is one row, its pieces from left to right; y is its first piece's. Only places are looked at, and a place's line
    never changes once it is known, since lines are only added. Where pieces come together already, a page after the
    other and each page's in order, they stay where they are.
    """
    kinds = dict(pieces.dtypes)
    schema = f"page {kinds['page']}, line int, y double, size {kinds['size']}, pieces array<struct<{', '.join(f'{c}: {kinds[c]}' for c in PIECE)}>>"
    return _together(pieces, together).mapInArrow(_placed, schema)


def line_texts(pieces: DataFrame, together: bool = False, turned: bool = True) -> DataFrame:
    """(page, line, y, size, text) of the lines of pieces that aren't blank; together as in placed_lines. Pieces stand from
    left to right; in a line with a piece of right-to-left letters they are read as its letters' majority runs. A gap
    between near edges is a space.

    Only lines with right-to-left letters are taken apart again for their order. Where there are none for certain (turned is
    False), pieces become texts in one look.
    """
    kinds = dict(pieces.dtypes)
    schema = f"page {kinds['page']}, line int, y double, size {kinds['size']}, text string"
    if not turned:
        return _together(pieces, together).mapInArrow(lambda batches: _spaced(_placed(batches)), schema)
    lines = placed_lines(pieces, together)
    letter = F.array_join("pieces.text", "")
    right = letter.rlike(FROM_RIGHT)
    units = lines.where(right).select("page", "line", "y", "size", (letters(letter, True) > letters(letter, False)).alias("rtl_base"), F.posexplode("pieces").alias("at", "piece"))
    read = reading_places(units.withColumn("direction", direction_of(F.col("piece.text"))), ["page", "line"], "at")
    ordered = read.groupBy("page", "line").agg(F.first("y").alias("y"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("l"))
    both = lines.where(~right).union(ordered.select("page", "line", "y", "size", F.col("l.piece").alias("pieces")))
    return both.mapInArrow(_spaced, schema)


def page_texts(pieces: DataFrame, markdown: bool = False) -> DataFrame:
    """(page, text) of the pages of pieces that hold text, as in texts_of_lines."""
    return texts_of_lines(line_texts(pieces), ["page"], markdown)


def texts_of_lines(lines: DataFrame, key: list[str], markdown: bool = False) -> DataFrame:
    """key and text of pages that hold lines (key, line, y, size, text): lines from the top, parted into paragraphs where
    they lie further apart than PARAGRAPH_GAP; in Markdown a paragraph is one escaped line. Lines that were dealt out by a
    part of the key stay where they are."""
    w = Window.partitionBy(*key).orderBy(F.col("y").desc(), "line")
    fresh = F.when(F.lag("y").over(w) - F.col("y") > PARAGRAPH_GAP * F.greatest("size", F.lag("size").over(w)), 1).otherwise(0)
    numbered = lines.withColumns({"fresh": fresh, "at": F.row_number().over(w)}).withColumn("paragraph", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = lambda mark: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), mark)
    text = markdown_escape(whole(" ")) if markdown else whole("\n")
    paragraphs = numbered.groupBy(*key, "paragraph").agg(text.alias("text")).withColumnRenamed("paragraph", "at")
    return paragraphs.groupBy(*key).agg(whole("\n\n").alias("text"))


def text_files(pages: DataFrame, markdown: bool = False) -> DataFrame:
    """(doc_id, content, empty_pages, characters) of pages (doc_id, page, text; null or empty: none), numbered from 0.

    Pages are parted by a rule, in plain text with the number of the page that follows; plain text begins with a byte
    order mark, and both end with a line feed. Characters are UTF-16 units of the pages' own texts.
    """
    text = F.coalesce("text", F.lit(""))
    each = pages.withColumns({"t": text, "number": (F.col("page") + 1).cast("string")})
    listed = each.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("page", "number", "t"))).alias("l"), F.array_sort(F.collect_list(F.when(F.col("t") == "", F.col("page")))).alias("empty_pages"),
        F.sum(utf16_length(F.col("t"))).cast("long").alias("characters"),
    )
    rule = lambda p: F.lit("\n\n---\n\n") if markdown else F.concat(F.lit("\n\n----- "), p["number"], F.lit(" -----\n\n"))
    body = F.array_join(F.transform("l", lambda p, k: F.concat(F.when(k == 0, "").otherwise(rule(p)), p["t"])), "")
    return listed.select("doc_id", F.concat(F.lit("" if markdown else BOM), body, F.lit("\n")).alias("content"), "empty_pages", "characters")


def display_class(unit: Column) -> Column:
    """The class of a unit for the order of display, by its first character; ON for what has none."""
    first, found = F.substring(unit, 1, 1), F.lit("ON")
    for name, pattern in reversed(CLASSES):
        found = F.when(first.rlike(f"^{pattern}"), name).otherwise(found)
    return found


def display_places(units: DataFrame, key: list[str], order: str = "ord", kind: str = "class") -> DataFrame:
    """Add place, from 0: where the units of a right-to-left paragraph, given in reading order with their classes (L, R, AL,
    EN, AN, ES, ET, CS, ON), stand from left to right.

    Each rule of the algorithm is a look at the nearest units on one side or both: digits after Arabic letters, separators
    between digits, signs beside them, digits after Latin letters, then neutrals between Latin letters. What is left stands
    a level above right-to-left letters; the whole line is turned, and runs of that level keep their order.
    """
    w = Window.partitionBy(*key).orderBy(order)
    # what is ahead is looked at from the other end: a frame that ends with the line would be gone through anew for each unit
    past, ahead = (o.rowsBetween(Window.unboundedPreceding, -1) for o in (w, Window.partitionBy(*key).orderBy(F.col(order).desc())))
    c = F.col("__c")
    last = lambda kept, over=past: F.last(F.when(kept, c), ignorenulls=True).over(over)
    nearest = lambda kept: F.last(F.when(kept, c), ignorenulls=True).over(ahead)
    own = units.withColumn("__c", F.col(kind))
    own = own.withColumn("__c", F.when((c == "EN") & (last(c.isin("L", "R", "AL")) == "AL"), "AN").otherwise(c))
    own = own.withColumn("__c", F.when(c == "AL", "R").otherwise(c))
    before, after = F.lag("__c").over(w), F.lead("__c").over(w)
    between = (before == after) & (((c == "ES") & (before == "EN")) | ((c == "CS") & before.isin("EN", "AN")))
    own = own.withColumn("__c", F.when(between, before).otherwise(c))
    own = own.withColumn("__c", F.when((c == "ET") & ((last(c != "ET") == "EN") | (nearest(c != "ET") == "EN")), "EN").otherwise(c))
    own = own.withColumn("__c", F.when(c.isin("ES", "ET", "CS"), "ON").when((c == "EN") & (last(c.isin("L", "R")) == "L"), "L").otherwise(c))
    inside = (last(c != "ON") == "L") & (nearest(c != "ON") == "L")
    own = own.withColumn("__c", F.when(c != "ON", c).when(inside, "L").otherwise("R"))
    turned = F.when((c != "R") & (F.lag("__c", 1, "R").over(w) != "R"), 0).otherwise(1)
    own = own.withColumn("__turn", turned).withColumn("__run", F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = Window.partitionBy(*key).orderBy(F.col("__run").desc(), order)
    return own.withColumn("place", F.row_number().over(placed) - 1).drop("__c", "__turn", "__run")
