"""A page from its glyphs: words, lines, blocks and paragraphs, with their style and alignment.

One pass of windows over the glyphs makes words and lines; blocks are aggregates over lines. Only which blocks make a
paragraph depends on all before it on the page, and is walked over one narrow row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import GAP
from quire.operators.layout import block_style, line_alignment, line_orientation
from quire.operators.sequential import LEADING, merged_paragraphs

WORD_GAP = 0.15  # of the larger size of two glyphs, along the line
BLOCK = ["page", "block"]
LINE = [*BLOCK, "line"]
BOX = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}


def _text(order: str, value: str, mark: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]), mark)


def page_words(glyphs: DataFrame) -> DataFrame:
    """The visible glyphs of (page, block, line, ord, ch, x0, y0, x1, y1, ox, oy, size, ...) with word, from 0 in a line.

    A word starts after white space, and after a gap along the line's direction (from its first glyph's origin to its
    last's) of over WORD_GAP of the larger of two sizes. Corners of a box may stand in any order.
    """
    line = Window.partitionBy(*LINE)
    w = line.orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    space = F.col("ch").rlike(rf"^{GAP}\z")
    marked = glyphs.withColumn("gaps", F.sum(space.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(~space)
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    own = marked.withColumns({"x0": low("x0", "x1"), "x1": high("x0", "x1"), "y0": low("y0", "y1"), "y1": high("y0", "y1")})
    dx, dy = (F.last(c).over(whole) - F.first(c).over(whole) for c in ("ox", "oy"))
    way = own.withColumns({"dx": dx, "dy": dy}).withColumn("length", F.hypot("dx", "dy"))
    way = way.withColumns({"dx": F.when(F.col("length") > 0, F.col("dx") / F.col("length")).otherwise(1.0), "dy": F.when(F.col("length") > 0, F.col("dy") / F.col("length")).otherwise(0.0)})
    extent = F.abs("dx") * (F.col("x1") - F.col("x0")) + F.abs("dy") * (F.col("y1") - F.col("y0"))
    centre = (F.col("x0") + F.col("x1")) / 2 * F.col("dx") + (F.col("y0") + F.col("y1")) / 2 * F.col("dy")
    set_ = way.withColumns({"extent": extent, "centre": centre})
    before = {c: F.lag(c).over(w) for c in ("gaps", "centre", "extent", "size")}
    gap = F.col("centre") - before["centre"] - (before["extent"] + F.col("extent")) / 2
    fresh = (F.col("gaps") > before["gaps"]) | (gap > WORD_GAP * F.greatest("size", before["size"]))
    numbered = set_.withColumn("fresh", F.coalesce(fresh, F.lit(False)).cast("int"))
    return numbered.withColumn("word", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).select(*glyphs.columns, "word")


def page_lines(words: DataFrame) -> DataFrame:
    """(page, block, line, text, x0, y0, x1, y1, baseline, orientation) of glyphs with words, and baseline."""
    each = words.groupBy(*LINE, "word").agg(
        _text("ord", "ch", "").alias("t"), *[f(c).alias(c) for c, f in BOX.items()], F.first("baseline").alias("baseline"),
        F.min_by(F.struct("x0", "y0", "x1", "y1"), "ord").alias("head"), F.max_by(F.struct("x0", "y0", "x1", "y1"), "ord").alias("tail"),
    )
    lines = each.groupBy(*LINE).agg(_text("word", "t", " ").alias("text"), *[f(c).alias(c) for c, f in BOX.items()], F.first("baseline").alias("baseline"), F.min_by("head", "word").alias("a"), F.max_by("tail", "word").alias("b"))
    dx, dy = ((F.col(f"b.{p}0") + F.col(f"b.{p}1") - F.col(f"a.{p}0") - F.col(f"a.{p}1")) / 2 for p in "xy")
    still = (dx == 0) & (dy == 0)
    return lines.withColumn("orientation", F.when(still, "horizontal").otherwise(line_orientation(F.atan2(dy, dx)))).drop("a", "b")


def _in_order(lines: DataFrame, key: list[str], level: Column) -> DataFrame:
    """Add at, from 1: lines by their baselines and left edges where all of a key are level, else as they came."""
    w = Window.partitionBy(*key)
    flat = F.bool_and(level).over(w)
    by = Window.partitionBy(*key).orderBy(F.when(F.col("flat"), F.col("baseline")).otherwise(0.0), F.when(F.col("flat"), F.col("x0")).otherwise(0.0), "block", "line")
    return lines.withColumn("flat", flat).withColumn("at", F.row_number().over(by)).drop("flat")


def _leading(lines: DataFrame, key: list[str]) -> DataFrame:
    """key and rhythm: the median distance of the baselines of a key's lines, one after another; null for one line."""
    gap = F.abs(F.col("baseline") - F.lag("baseline").over(Window.partitionBy(*key).orderBy("at")))
    return lines.withColumn("gap", gap).groupBy(*key).agg(F.median("gap").alias("rhythm"))


def text_page(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, paragraph, x0, y0, x1, y1, text, lines, font, size, leading, align, orientation) of the paragraphs of pages.

    glyphs: page, block, line, ord, ch, x0, y0, x1, y1, ox, oy, size, font, baseline; pages: page, width. Blocks are made
    of lines, and paragraphs of blocks that follow each other (see merged_paragraphs). A paragraph has the font and size of
    its first block; its leading is the median distance of its baselines, or LEADING of the size; a single block is aligned
    against the page, a merged one against itself. Blocks without a visible glyph that has a size are left out.
    """
    words = page_words(glyphs)
    ranked = words.withColumn("ord", F.row_number().over(Window.partitionBy(*BLOCK).orderBy("line", "ord")))
    style = block_style(ranked, BLOCK)
    lines = page_lines(words).join(style.select(*BLOCK), BLOCK, "left_semi")
    placed = _in_order(lines, BLOCK, F.col("orientation") == "horizontal")
    turned = F.min_by("orientation", F.when(F.col("orientation").isin("vertical", "reversed"), F.col("at")))
    orientation = F.coalesce(turned, F.when(F.bool_or(F.col("orientation") == "skewed"), "skewed").otherwise("horizontal"))
    baselines = F.transform(F.sort_array(F.collect_list(F.struct("at", "baseline"))), lambda x: x["baseline"])
    blocks = placed.groupBy(*BLOCK).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), orientation.alias("orientation"), baselines.alias("baselines")).join(style, BLOCK)
    joined = merged_paragraphs(blocks.select(*BLOCK, "x0", "x1", "size", F.coalesce("font", F.lit("")).alias("font"), "orientation", "baselines"))
    key = ["page", "paragraph"]
    heads = joined.groupBy(*key).agg(F.min("block").alias("block"), F.count("*").alias("blocks")).join(blocks.select(*BLOCK, "font", "size", "orientation"), BLOCK).drop("block")
    whole = _in_order(lines.join(joined, BLOCK), key, F.col("orientation") == "horizontal")
    boxes = whole.groupBy(*key).agg(*[f(c).alias(c) for c, f in BOX.items()], _text("at", "text", "\n").alias("text"), F.count("*").alias("lines"))
    wide = boxes.join(heads, key).join(pages, "page").withColumn("room", F.when(F.col("blocks") > 1, F.col("x1") - F.col("x0")).otherwise(F.col("width")))
    against = whole.select(*key, "at", "x0", "x1").join(wide.select(*key, F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("room").alias("width")), key).withColumnRenamed("at", "ord")
    made = wide.join(_leading(whole, key), key).join(line_alignment(against, key), key)
    leading = F.when(F.col("rhythm") > 0, F.col("rhythm")).otherwise(F.col("size") * LEADING)
    return made.select(*key, *BOX, "text", "lines", "font", "size", leading.alias("leading"), "align", "orientation")
