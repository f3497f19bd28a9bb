"""The page in a photograph: edges, straight lines, the four sides, and the map that sets the page upright.

Gradients are made in tiles and votes for lines are aggregations, so a page may have any number of pixels. A page's strongest lines
and its edges then meet in one task, where the four sides are chosen, fitted to the edges along them, and intersected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import cos, hypot, pi, sin

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from quire.operators.groups import parts_by_rows

# Of the strongest gradient, what is an edge; directions in half a turn, and how many a pixel votes for on either side of its
# own; how many lines are kept, and how far apart two lines are, in directions and pixels.
EDGE, TURN, AROUND, LINES, NEAR_TURN, NEAR_PIXELS = 0.25, 180, 2, 12, 8, 12
# Angles in radians between sides that are opposite (at most) and that meet (at least); corners in degrees; the share of the
# picture that a page covers; how far beyond it a corner may lie; the share of a side that edges must support.
OPPOSITE, MEET, CORNERS, COVERS, BEYOND, SUPPORT = 0.7, 0.6, (45.0, 135.0), (0.12, 1.3), 0.15, 0.35
TILE = 64  # pixels along the side of a tile
ORDERS = ((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2))


def edges(pixels: DataFrame, parts: int | None = None) -> DataFrame:
    """(page, x, y, theta) of the edge pixels of (page, x, y, grey): those inside whose Sobel gradient is at least EDGE of the
    page's strongest; theta is the gradient's direction in [0, TURN).

    Pixels meet their neighbours in tiles of TILE by TILE, to which those around its rim come too, so a picture of any size
    is no more than a tile in a task; what is below EDGE of a tile's strongest stays there. They come dealt out by page, into
    `parts` (by the count of pixels, where not given).
    """
    kinds = dict(pixels.dtypes)
    near = lambda c: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - 1) / TILE), F.floor((F.col(c) + 1) / TILE))))
    tiled = pixels.select("page", "x", "y", F.coalesce(F.col("grey").cast("double"), F.lit(0.0)).alias("grey"), near("x").alias("tx")).select("*", near("y").alias("ty"))
    schema = f"page {kinds['page']}, x {kinds['x']}, y {kinds['y']}, gx double, gy double, g double"
    made = to_arrow_schema(_parse_datatype_string(schema))

    def gradients(page: pa.Scalar, left: int, top: int, x: np.ndarray, y: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        grey, there = np.zeros((TILE + 2, TILE + 2)), np.zeros((TILE + 2, TILE + 2), bool)
        grey[y - top, x - left], there[y - top, x - left] = values, True
        gx, gy, whole = np.zeros((TILE, TILE)), np.zeros((TILE, TILE)), np.ones((TILE, TILE), bool)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                if dx or dy:
                    part = slice(1 + dy, 1 + dy + TILE), slice(1 + dx, 1 + dx + TILE)
                    gx, gy, whole = gx + dx * (2 - abs(dy)) * grey[part], gy + dy * (2 - abs(dx)) * grey[part], whole & there[part]
        g = np.where(whole, np.hypot(gx, gy), 0.0)  # a pixel at the picture's rim has fewer neighbours
        y, x = np.nonzero((g > 0) & (g >= EDGE * g.max()))
        columns = [pa.repeat(page, len(x)), x + left + 1, y + top + 1, gx[y, x], gy[y, x], g[y, x]]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: pa.Table, start: int, stop: int) -> Iterator[pa.RecordBatch]:
            x, y, grey = (rows[c][start:stop].to_numpy() for c in ("x", "y", "grey"))
            if len(x) >= 8 and np.ptp(x) > 1 and np.ptp(y) > 1:
                yield gradients(rows["page"][start], *(rows[c][start].as_py() * TILE - 1 for c in ("tx", "ty")), x.astype(int), y.astype(int), grey)

        rest = None
        for b in batches:
            rows = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            rows = rows.combine_chunks()
            turns = np.zeros(max(0, rows.num_rows - 1), bool)
            for c in ("page", "tx", "ty"):
                turns |= pc.not_equal(rows[c][1:], rows[c][:-1]).to_numpy()
            cuts = [0, *(np.flatnonzero(turns) + 1).tolist()]
            for start, stop in zip(cuts, cuts[1:]):  # noqa: B905
                yield from close(rows, start, stop)
            rest = rows[cuts[-1] :]
        if rest is not None and rest.num_rows:
            yield from close(rest, 0, rest.num_rows)

    # a page's strongest is found where its edges are dealt to: a join would have to guess how many there are
    parts = parts or parts_by_rows(pixels)
    strong = tiled.where("page is not null").repartition(parts, "page", "tx", "ty").sortWithinPartitions("page", "tx", "ty").mapInArrow(run, schema)
    own = strong.repartition(parts, "page").withColumn("most", F.max("g").over(Window.partitionBy("page")))
    turn = F.pmod(F.round(F.degrees(F.atan2("gy", "gx")) * TURN / 180).cast("int"), F.lit(TURN))
    return own.where(F.col("g") >= EDGE * F.col("most")).select("page", "x", "y", turn.alias("theta"))


def line_votes(found: DataFrame) -> DataFrame:
    """(page, theta, rho, votes): lines by the direction of their normal and their distance from the origin; an edge pixel
    votes for the directions around its own."""
    each = found.select("page", "x", "y", F.explode(F.sequence(F.col("theta") - AROUND, F.col("theta") + AROUND)).alias("t"))
    wrapped = F.pmod("t", F.lit(TURN))
    angle = wrapped * np.pi / TURN
    rho = F.round(F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)).cast("int")
    return each.select("page", wrapped.alias("theta"), rho.alias("rho")).groupBy("page", "theta", "rho").agg(F.count("*").alias("votes"))


def strongest_lines(votes: DataFrame, most: int = 400) -> DataFrame:
    """The `most` lines of each page with most votes; of equals those of smaller direction and distance."""
    w = Window.partitionBy("page").orderBy(F.desc("votes"), "theta", "rho")
    return votes.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most).drop("at")


def _apart(lines: np.ndarray) -> list[tuple[float, float]]:
    """(angle, distance) of lines (theta, rho), strongest first, less those next to a stronger one; LINES at most."""
    kept: list[tuple[int, int]] = []
    for theta, rho in lines:
        near = False
        for t, r in kept:
            turn = abs(theta - t)
            turn, other = (TURN - turn, -r) if turn > TURN / 2 else (turn, r)  # beyond half a turn a normal points back
            near |= turn <= NEAR_TURN and abs(rho - other) <= NEAR_PIXELS
        if not near:
            kept.append((theta, rho))
        if len(kept) == LINES:
            break
    return [(t * np.pi / TURN, float(r)) for t, r in kept]


def _meet(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float] | None:
    (ca, sa), (cb, sb) = (cos(a[0]), sin(a[0])), (cos(b[0]), sin(b[0]))
    det = ca * sb - sa * cb
    return ((a[1] * sb - sa * b[1]) / det, (ca * b[1] - a[1] * cb) / det) if abs(det) > 1e-3 else None


def _between(a: float, b: float) -> float:
    d = abs(a - b) % pi
    return min(d, pi - d)


def _along(points: np.ndarray, a: np.ndarray, b: np.ndarray, reach: float = 2.5) -> np.ndarray:
    """Which points lie within reach of the stretch from a to b."""
    length = np.hypot(*(b - a))
    way = (b - a) / length
    off = points - a
    return (np.abs(off @ np.array([-way[1], way[0]])) <= reach) & (off @ way >= 0) & (off @ way <= length)


def _shapes(corners: np.ndarray, width: float, height: float) -> np.ndarray:
    """The areas of fours of corners (n, 4, 2) that can be a page's in a picture of this size; 0 where they can't."""
    after = np.roll(corners, -1, axis=1)
    way = after - corners
    before = np.roll(way, 1, axis=1)
    side = np.hypot(way[..., 0], way[..., 1])
    cross = before[..., 0] * way[..., 1] - before[..., 1] * way[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = -(before * way).sum(axis=2) / np.roll(side, 1, axis=1) / side
        area = np.abs((corners[..., 0] * after[..., 1] - after[..., 0] * corners[..., 1]).sum(axis=1)) / 2
        turned = np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0)))
        size = np.array([width, height])
        fits = ((corners >= -BEYOND * size) & (corners <= (1 + BEYOND) * size)).all(axis=(1, 2)) & (side.min(axis=1) >= 0.15 * min(width, height))
        fits &= (cross > 0).all(axis=1) | (cross < 0).all(axis=1)
        fits &= ((turned >= CORNERS[0]) & (turned <= CORNERS[1])).all(axis=1) & (area / (width * height) >= COVERS[0]) & (area / (width * height) <= COVERS[1])
    return np.where(fits, area, 0.0)


def _fitted(points: np.ndarray, line: tuple[float, float]) -> tuple[float, float]:
    """The line through points that lie along one, by their main direction."""
    if len(points) < 8:
        return line
    middle = points.mean(axis=0)
    normal = np.linalg.svd(points - middle, full_matrices=False)[2][1]
    return float(np.arctan2(normal[1], normal[0])), float(normal @ middle)


def best_corners(points: np.ndarray, lines: np.ndarray, width: int, height: int) -> tuple[np.ndarray, float] | None:
    """Corners, clockwise from the top left, and score of the page whose edges are points and whose strongest lines (theta,
    rho) are given; None where there is none. Up to two sides may be the picture's own. Of all that can be a page's sides the
    ones win that edges support best, weighed by the root of their area; they are then fitted to their edges."""
    frame = [(0.0, 0.0), (0.0, width - 1.0), (np.pi / 2, 0.0), (np.pi / 2, height - 1.0)]
    known = _apart(lines)
    every, best = known + frame, None
    count = len(every)
    turns = np.array([[_between(p[0], q[0]) for q in every] for p in every])
    crossing = np.array([[_meet(p, q) or (np.nan, np.nan) for q in every] for p in every]).reshape(count, count, 2)
    fours = np.array([four for four in combinations(range(count), 4) if four[1] < len(known)], int).reshape(-1, 4)  # over two sides would be the picture's own
    a, b, c, d = fours[:, np.array(ORDERS)].reshape(-1, 4).T
    may = (turns[a, b] <= OPPOSITE) & (turns[c, d] <= OPPOSITE) & (turns[a, c] >= MEET)
    a, b, c, d = (x[may] for x in (a, b, c, d))
    met = np.stack([crossing[a, c], crossing[a, d], crossing[b, d], crossing[b, c]], axis=1)
    areas = _shapes(met, width, height)
    shares: dict[tuple, float] = {}  # by side: a stretch of a line between two others is met in many fours
    for n in np.flatnonzero(areas > 0):
        area, sides, corners = float(areas[n]), (int(a[n]), int(d[n]), int(b[n]), int(c[n])), [tuple(x) for x in met[n].tolist()]
        if best is None or (area / (width * height)) ** 0.5 > best[0]:  # support is 1 at most
            support = 1.0
            for side, index in enumerate(sides):
                share = 0.5 if index >= len(known) else None
                if share is None:
                    p, q = corners[side], corners[(side + 1) % 4]
                    if (p, q) not in shares:
                        shares[p, q] = min(1.0, _along(points, np.array(p), np.array(q), 1.5).sum() / (2 * hypot(q[0] - p[0], q[1] - p[1])))
                    share = shares[p, q]
                support *= share if share >= SUPPORT / 2 else 0.0
                if not support:
                    break
            score = support**0.5 * (area / (width * height)) ** 0.5
            if score and (best is None or score > best[0]):
                best = score, np.array(corners), tuple(every[x] for x in sides), [x >= len(known) for x in sides]
    if best is None:
        return None
    score, corners, sides, framed = best
    for _ in range(2):
        ends = [(corners[n], corners[(n + 1) % 4]) for n in range(4)]
        inner = [(0.9 * a + 0.1 * b, 0.1 * a + 0.9 * b) for a, b in ends]  # near a corner edges of the next side lie close by
        fits = [s if f else _fitted(points[_along(points, *inner[n])], s) for n, (s, f) in enumerate(zip(sides, framed, strict=True))]
        met = [_meet(fits[n - 1], fits[n]) for n in range(4)]
        corners = np.array([m if m is not None else c for m, c in zip(met, corners, strict=True)])
        sides = tuple(fits)
    middle = corners.mean(axis=0)
    around = corners[np.argsort(np.arctan2(*(corners - middle).T[::-1]))]  # clockwise, as y grows downwards
    return np.roll(around, -int(np.argmin(around.sum(axis=1))), axis=0), float(score)


def upright(corners: np.ndarray, width: float, height: float) -> np.ndarray | None:
    """The map (3 by 3) that takes corners, clockwise from the top left, to those of a rectangle: eight unknowns from two
    equations a corner. None where three of them lie on a line."""
    rows, right = [], []
    for (x, y), (u, v) in zip(corners, ((0, 0), (width, 0), (width, height), (0, height)), strict=True):
        rows += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v]]
        right += [u, v]
    matrix = np.array(rows, float)
    if np.linalg.cond(matrix) > 1e12:
        return None
    return np.append(np.linalg.solve(matrix, np.array(right, float)), 1.0).reshape(3, 3)


def page_corners(pixels: DataFrame) -> DataFrame:
    """(page, corners, score, map) of the page found in each picture (page, x, y, grey): its corners, clockwise from the top
    left, and the map to an upright rectangle as long as its sides, row by row. Pictures without one are left out."""
    parts = parts_by_rows(pixels)
    found = edges(pixels, parts)
    size = pixels.groupBy("page").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    lines = strongest_lines(line_votes(found)).unionByName(size, allowMissingColumns=True).withColumnRenamed("page", "of")
    kind = dict(pixels.dtypes)["page"]

    def solve(own: pd.DataFrame, votes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(votes):
            ordered = votes[votes["w"].isna()].sort_values(["votes", "theta", "rho"], ascending=[False, True, True])
            made = best_corners(own[["x", "y"]].to_numpy(float), ordered[["theta", "rho"]].to_numpy(int), int(votes["w"].max()), int(votes["h"].max()))
            if made:
                corners, score = made
                side = np.hypot(*(np.roll(corners, -1, axis=0) - corners).T)
                change = upright(corners, (side[0] + side[2]) / 2, (side[1] + side[3]) / 2)
                out.append((own["page"].iloc[0], corners.tolist(), score, None if change is None else change.ravel().tolist()))
        return pd.DataFrame(out, columns=["page", "corners", "score", "map"])

    return found.groupBy("page").cogroup(lines.repartition(parts, "of").groupBy("of")).applyInPandas(solve, f"page {kind}, corners array<array<double>>, score double, map array<double>")
