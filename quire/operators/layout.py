"""Words, lines and blocks from placed pieces of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import GAP


def word_runs(glyphs: DataFrame, key: list[str], gap: float = 0.15) -> DataFrame:
    """Add word, from 0, to (key, ord, ch, x0, x1, size): a new one after white space or a gap of over 0.15 em; white
    space itself is left out."""
    w = Window.partitionBy(*key).orderBy("ord")
    space = F.col("ch").rlike(rf"^{GAP}\z")
    apart = F.coalesce(F.lag(space).over(w), F.lit(True)) | ((F.col("x0") - F.lag("x1").over(w)) > gap * F.col("size"))
    flagged = glyphs.withColumns({"__space": space, "__new": (apart & ~space).cast("int")})
    numbered = flagged.withColumn("word", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return numbered.where("not __space").drop("__space", "__new")


def line_alignment(lines: DataFrame, key: list[str], tolerance: float = 1.0) -> DataFrame:
    """key and align of (key, ord, x0, x1) lines in a block from b0 to b1 on a page of a width: justify, right, center or
    left. A single line is centred where its block's middle is the page's."""
    w = Window.partitionBy(*key).orderBy(F.desc("ord"))
    near = lambda a, b: F.abs(a - b) <= tolerance
    middle = (F.col("b0") + F.col("b1")) / 2
    placed = lines.withColumns(
        {
            "l": near(F.col("x0"), F.col("b0")),
            "r": near(F.col("x1"), F.col("b1")),
            "c": near((F.col("x0") + F.col("x1")) / 2, middle),
            "one": near(middle, F.col("width") / 2),
            "tail": F.row_number().over(w) == 1,
        }
    )
    every = placed.groupBy(*key).agg(
        F.count("*").alias("n"), F.bool_and("l").alias("l"), F.bool_and("r").alias("r"), F.bool_and("c").alias("c"), F.bool_and("one").alias("one"), F.bool_and(F.col("r") | F.col("tail")).alias("body"),
    )
    some = F.col("n") >= 2
    kind = F.when(some & F.col("l") & F.col("body") & ~F.col("r"), "justify").when(some & F.col("r") & ~F.col("l"), "right")
    kind = kind.when(some & ~F.col("l") & F.col("c"), "center").when(~some & F.col("one"), "center").otherwise("left")
    return every.select(*key, kind.alias("align"))


def block_style(glyphs: DataFrame, key: list[str]) -> DataFrame:
    """key, size and font: the median size of visible glyphs, and the commonest font; of equals the one that came to that
    number first. Blocks without a glyph that has a size are left out."""
    seen = glyphs.where(~F.col("ch").rlike(rf"^{GAP}\z"))
    sizes = seen.where("size > 0").groupBy(*key).agg(F.median("size").alias("size"))
    fonts = seen.where("font <> ''").groupBy(*key, "font").agg(F.count("*").alias("n"), (-F.max("ord")).alias("reached"))
    best = fonts.groupBy(*key).agg(F.max(F.struct("n", "reached", "font")).alias("m")).select(*key, F.col("m.font").alias("font"))
    return sizes.join(best, key, "left")


def line_orientation(angle: Column, near: float = 0.98) -> Column:
    """horizontal, reversed, vertical or skewed, from a line's angle in radians."""
    c, s = F.cos(angle), F.sin(angle)
    return F.when(c >= near, "horizontal").when(c <= -near, "reversed").when(F.abs(s) >= near, "vertical").otherwise("skewed")


def block_orientation(lines: DataFrame, key: list[str], order: str, orientation: str) -> DataFrame:
    """key and block: the first vertical or reversed line's orientation, else skewed if any line is, else horizontal."""
    first = F.min(F.when(F.col(orientation).isin("vertical", "reversed"), F.struct(order, orientation)))
    return lines.groupBy(*key).agg(F.coalesce(first[orientation], F.when(F.bool_or(F.col(orientation) == "skewed"), "skewed").otherwise("horizontal")).alias("block"))


def line_widths(glyphs: DataFrame, advances: DataFrame, key: list[str]) -> DataFrame:
    """key and width: the sum of glyph advances (ch, advance in thousandths of the size); glyphs without one count 0."""
    return glyphs.join(advances, "ch", "left").groupBy(*key).agg(F.sum(F.coalesce("advance", F.lit(0)) * F.col("size") / 1000).alias("width"))
