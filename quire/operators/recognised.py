"""Recognised words put together again: lines cut at gutters, paragraphs, and the order in which a page is read.

Words meet in lines by windows; a page's lines are then walked once, as a line joins the nearest paragraph above it, and the
blocks of a page are ordered by cutting it again and again at its widest gap. A task holds one page's lines at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.groups import walk_groups

# Fixed values, as shares of a line's size where they are lengths: what cuts a line; how far apart baselines of a paragraph
# are; how sizes may differ; how far edges or centres are apart; how far columns overlap in height; how a row gap weighs
# against a column gap; and the row gap that is more than a blank line.
GUTTER, LEAST_LEADING, MOST_LEADING, SMALLER, LARGER, ALIGN = 1.5, 0.7, 2.0, 0.75, 1.33, 0.8
COLUMN_OVERLAP, ROW_PREFERENCE, ROW_GAP = 0.33, 0.6, 2.5


def cut_lines(words: DataFrame) -> DataFrame:
    """(page, region, line, part, x0, y0, x1, y1, baseline, size, n_words, text) from words (page, line, word, text, x0, y0,
    x1, y1, baseline, size, region), y downwards: a line is cut where the region changes, or where a word starts further
    right of all before it than GUTTER of the line's size (the median of its words')."""
    line = Window.partitionBy("page", "line")
    order = line.orderBy("x0", "word")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = words.withColumn("reach", GUTTER * F.percentile("size", 0.5).over(line)).withColumns({"was": F.lag("region").over(order), "at": F.row_number().over(order)})
    turned = sized.withColumn("turn", F.when((F.col("at") > 1) & ~F.col("was").eqNullSafe(F.col("region")), 1).otherwise(0)).withColumn("run", F.sum("turn").over(upto))
    # words stand by their left edges, so one beyond a gap also ends beyond all before it: the edge needs no reset there
    right = F.max("x1").over(Window.partitionBy("page", "line", "run").orderBy("x0", "word").rowsBetween(Window.unboundedPreceding, -1))
    parts = turned.withColumn("fresh", F.when((F.col("turn") == 1) | (F.col("x0") - right > F.col("reach")), 1).otherwise(0)).withColumn("part", F.sum("fresh").over(upto))
    listed = F.sort_array(F.collect_list(F.struct("at", "text")))
    return parts.groupBy("page", "line", "part").agg(
        F.first("region").alias("region"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.percentile("baseline", 0.5).alias("baseline"),
        F.percentile("size", 0.5).alias("size"), F.count("*").alias("n_words"), F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"),
    )


def _continues(last, line) -> bool:
    high, leading = max(last.size, line.size), line.baseline - last.baseline
    near = min(abs(line.x0 - last.x0), abs(line.x0 + line.x1 - last.x0 - last.x1) / 2)
    return last.region == line.region and LEAST_LEADING * high <= leading <= MOST_LEADING * high and SMALLER <= line.size / last.size <= LARGER and near <= ALIGN * high


def _widest(boxes: np.ndarray, axis: int) -> tuple[float, np.ndarray, int] | None:
    """The widest gap of boxes (x0, y0, x1, y1) along an axis: its width, the order of the boxes, and how many stand before
    it; the first of equals. Boxes beside a gap across must overlap in height, as columns do."""
    order = np.argsort(boxes[:, axis], kind="stable")
    own = boxes[order]
    gaps = own[1:, axis] - np.maximum.accumulate(own[:, axis + 2])[:-1]
    if axis == 0:
        top, foot = np.minimum.accumulate(own[:, 1])[:-1], np.maximum.accumulate(own[:, 3])[:-1]
        top_after, foot_after = np.minimum.accumulate(own[::-1, 1])[::-1][1:], np.maximum.accumulate(own[::-1, 3])[::-1][1:]
        beside = np.minimum(foot, foot_after) - np.maximum(top, top_after) >= COLUMN_OVERLAP * np.minimum(foot - top, foot_after - top_after)
        gaps = np.where(beside, gaps, -1.0)
    at = int(np.argmax(gaps)) if len(gaps) else -1
    return (float(gaps[at]), order, at + 1) if at >= 0 and gaps[at] > 0 else None


def _in_rows(boxes: np.ndarray, at: np.ndarray) -> list[int]:
    """Boxes that no gap parts: rows from the top, each from the left. A box joins the first row with a member that it
    overlaps by half the smaller height."""
    rows: list[list[int]] = []
    for k in sorted(at.tolist(), key=lambda k: (boxes[k, 1], boxes[k, 0])):
        def meets(j: int, k: int = k) -> bool:
            shared = min(boxes[k, 3], boxes[j, 3]) - max(boxes[k, 1], boxes[j, 1])
            return shared >= 0.5 * min(boxes[k, 3] - boxes[k, 1], boxes[j, 3] - boxes[j, 1])

        row = next((r for r in rows if any(map(meets, r))), None)
        if row is None:
            rows.append([k])
        else:
            row.append(k)
    return [k for row in rows for k in sorted(row, key=lambda k: boxes[k, 0])]


def cut_order(boxes: np.ndarray, lines: np.ndarray, size: float) -> list[int]:
    """The order in which boxes (x0, y0, x1, y1) of so many lines each are read, where lines are typically of this size.

    The page is cut at its widest gap from side to side, or from top to bottom, and each part again. A gap between rows is
    taken if it is at least ROW_PREFERENCE of that between columns, and either more than the blank line between paragraphs,
    or the columns are no columns of text: no further apart than words, or a side of them has no paragraph of two lines.
    """
    out: list[int] = []
    rest = [np.arange(len(boxes))]
    while rest:
        at = rest.pop()
        rows = _widest(boxes[at], 1) if len(at) > 1 else None
        columns = _widest(boxes[at], 0) if len(at) > 1 else None
        cut = columns
        if rows and columns:
            sides = lines[at][columns[1]] > 1
            texts = sides[: columns[2]].any() and sides[columns[2] :].any()
            if rows[0] >= ROW_PREFERENCE * columns[0] and (rows[0] >= ROW_GAP * size or columns[0] < GUTTER * size or not texts):
                cut = rows
        cut = cut or rows
        if cut:
            ordered = at[cut[1]]
            rest += [ordered[cut[2] :], ordered[: cut[2]]]
        else:
            out += _in_rows(boxes, at) if len(at) > 1 else at.tolist()
    return out


def paragraphs(lines: DataFrame) -> DataFrame:
    """(page, paragraph, place, line, part, text) of lines as cut_lines gives them: from the top, a line joins the paragraph
    above whose last line is nearest and which it continues, and paragraphs are numbered in the order they are read; place
    numbers the lines of each."""
    kind = dict(lines.dtypes)

    def walk(page: Iterator) -> Iterator[tuple]:
        found: list[list] = []
        sizes = []
        for line in page:
            sizes.append(line.size)
            own = [p for p in found if _continues(p[-1], line)]
            if own:
                min(own, key=lambda p: line.baseline - p[-1].baseline).append(line)
            else:
                found.append([line])
        boxes = np.array([[min(x.x0 for x in p), min(x.y0 for x in p), max(x.x1 for x in p), max(x.y1 for x in p)] for p in found])
        for number, k in enumerate(cut_order(boxes, np.array([len(p) for p in found]), float(np.median(sizes)))):
            for place, line in enumerate(found[k]):
                yield line.page, number, place, line.line, line.part, line.text

    return walk_groups(lines, "page", ["baseline", "x0"], walk, f"page {kind['page']}, paragraph int, place int, line {kind['line']}, part long, text string")
