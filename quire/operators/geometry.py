"""Measurement, rectangles, intervals and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


MOST_POINTS = 128  # of a chain whose boundary is tested; longer ones are refused


def _xy(point: Column) -> tuple[Column, Column]:
    return point["x"], point["y"]


def _side(a: Column, b: Column, c: Column) -> Column:
    (ax, ay), (bx, by), (cx, cy) = _xy(a), _xy(b), _xy(c)
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments share a point: they cross, touch, or overlap."""
    parts = F.struct(_side(a, b, c).alias("abc"), _side(a, b, d).alias("abd"), _side(c, d, a).alias("cda"), _side(c, d, b).alias("cdb"))
    on = lambda p, q, r: r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    def of(s: Column) -> Column:
        cross = (F.signum(s["abc"]) * F.signum(s["abd"]) < 0) & (F.signum(s["cda"]) * F.signum(s["cdb"]) < 0)
        touch = ((s["abc"] == 0) & on(a, b, c)) | ((s["abd"] == 0) & on(a, b, d)) | ((s["cda"] == 0) & on(c, d, a)) | ((s["cdb"] == 0) & on(c, d, b))
        return cross | touch

    return F.get(F.transform(F.array(parts), of), F.lit(0))


def crosses_itself(points: DataFrame, key: list[str], order: str = "ord", x: str = "x", y: str = "y", most: int = MOST_POINTS) -> DataFrame:
    """key and crosses: whether the closed ring through the points of a key crosses or touches itself.

    Repeated points count once, and a last point that repeats the first closes the ring only. Edges that are neighbours
    share just their point. A key of more than `most` points raises an error, so no group is gathered beyond that.
    """
    w = Window.partitionBy(*key).orderBy(order)
    numbered = points.select(*key, F.row_number().over(w).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    listed = numbered.where(F.col("i") <= most + 1).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    listed = listed.withColumn("p", F.when(F.size("p") <= most, F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))).otherwise(F.raise_error(F.lit(f"a chain has more than {most} points")).cast("array<struct<x:double,y:double>>")))
    ring = F.filter("p", lambda q, i: (i == 0) | (q != F.get("p", i - 1)))
    listed = listed.withColumn("r", ring)
    listed = listed.withColumn("r", F.when((F.size("r") > 1) & (F.get("r", F.lit(0)) == F.element_at("r", -1)), F.slice("r", F.lit(1), F.size("r") - 1)).otherwise(F.col("r")))
    n = F.size("r")
    at = lambda k: F.get("r", k % n)
    far = lambda i, j: (j >= i + 2) & ~((i == 0) & (j == n - 1))
    places = F.sequence(F.lit(0), n - 1)
    crosses = F.exists(places, lambda i: F.exists(places, lambda j: far(i, j) & _meet(at(i), at(i + 1), at(j), at(j + 1))))
    return listed.select(*key, crosses.alias("crosses"))


def chains(points: DataFrame, key: list[str], order: str = "ord", x: str = "x", y: str = "y", mode: str = "area") -> DataFrame:
    """key, n, length, perimeter, area and bearing of each chain of two points or more.

    mode `area`: the ring closes; two points span a rectangle, whose length runs along three of its sides; a ring that
    crosses itself has no area (NaN). mode `perimeter`: an open chain, its perimeter is its length and its area 0. mode
    `distance`: the same of two points; other chains raise an error. The bearing is that of the first segment, in [0, 360).
    """
    w = Window.partitionBy(*key).orderBy(order)
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumns({"i": F.row_number().over(w), "nx": F.lead(x).over(w), "ny": F.lead(y).over(w), "fx": F.first(x).over(all_of), "fy": F.first(y).over(all_of)})
    cx, cy = F.coalesce("nx", "fx"), F.coalesce("ny", "fy")
    made = p.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.sum(F.hypot(F.col("nx") - F.col(x), F.col("ny") - F.col(y))).alias("open"),
        F.sum(F.hypot(cx - F.col(x), cy - F.col(y))).alias("ring"),
        (F.abs(F.sum(F.col(x) * cy - cx * F.col(y))) / 2).alias("shoelace"),
        (F.max(x) - F.min(x)).alias("w"),
        (F.max(y) - F.min(y)).alias("h"),
        F.max(F.when(F.col("i") == 1, F.degrees(F.atan2(F.col("ny") - F.col(y), F.col("nx") - F.col(x))))).alias("b"),
    )
    made = made.where("n >= 2")
    bearing = ((F.col("b") + 360) % 360).alias("bearing")
    if mode != "area":
        n = F.when(F.col("n") == 2, F.col("n")).otherwise(F.raise_error(F.lit("a distance is two points")).cast("long")) if mode == "distance" else F.col("n")
        return made.select(*key, n.alias("n"), F.col("open").alias("length"), F.col("open").alias("perimeter"), F.lit(0.0).alias("area"), bearing)
    both = made.join(crosses_itself(points, key, order, x, y), key)
    two = F.col("n") == 2
    area = F.when(two, F.col("w") * F.col("h")).when(F.col("crosses"), float("nan")).otherwise(F.col("shoelace"))
    length = F.when(two, 2 * F.col("w") + F.col("h")).otherwise(F.col("open"))
    return both.select(*key, "n", length.alias("length"), F.when(two, 2 * (F.col("w") + F.col("h"))).otherwise(F.col("ring")).alias("perimeter"), area.alias("area"), bearing)


LEAST_LEVEL = -10  # of the grids that rectangles meet in: cells of 2 ** level


def overlaps(rects: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    """The rects (x0, y0, x1, y1) of a key that share an area with a mark of it; touching edges don't count. Corners may
    stand in any order. Rects of the kind Redact, where there is such a column, are left out.

    A rect or mark lies in at most four cells of a grid as wide as itself, rounded up to a power of two. Two meet in the
    cells of the wider one's grid, where the other is entered too; so neither a key with very many of either is paired
    throughout, nor does a wide one take part in very many cells.
    """
    def placed(rows: DataFrame, prefix: str) -> DataFrame:
        low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
        sides = {"l": low("x0", "x1"), "r": high("x0", "x1"), "b": low("y0", "y1"), "t": high("y0", "y1")}
        made = rows.withColumns({f"{prefix}{k}": v.cast("double") for k, v in sides.items()})
        wide = F.greatest(F.col(f"{prefix}r") - F.col(f"{prefix}l"), F.col(f"{prefix}t") - F.col(f"{prefix}b"))
        level = F.when(wide > 0, F.greatest(F.ceil(F.log2(wide)).cast("int"), F.lit(LEAST_LEVEL))).otherwise(LEAST_LEVEL)
        return made.withColumn(f"{prefix}level", level)

    def cells(rows: DataFrame, p: str, levels: list[int]) -> DataFrame:
        """A row for each cell, in its own grid and in the wider ones of what it may meet."""
        wider = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > F.col(f"{p}level"))
        each = rows.withColumn("__level", F.explode(F.concat(F.array(f"{p}level"), wider)))
        of = F.pow(F.lit(2.0), F.col("__level"))
        span = lambda a, b: F.sequence(F.floor(F.col(a) / of), F.floor(F.col(b) / of))
        return each.withColumn("__cx", F.explode(span(f"{p}l", f"{p}r"))).withColumn("__cy", F.explode(span(f"{p}b", f"{p}t")))

    own = placed(rects.where("kind <> 'Redact' or kind is null") if "kind" in rects.columns else rects, "__")
    m = placed(marks, "__m").select(*key, "__ml", "__mr", "__mb", "__mt", "__mlevel")
    levels = lambda rows, c: sorted(r[0] for r in rows.select(c).distinct().collect())  # noqa: E731  # some dozens at most
    hit = (F.col("__l") < F.col("__mr")) & (F.col("__r") > F.col("__ml")) & (F.col("__b") < F.col("__mt")) & (F.col("__t") > F.col("__mb"))
    named = own.withColumn("__id", F.monotonically_increasing_id())
    at = cells(named.select(*key, "__id", "__l", "__r", "__b", "__t", "__level").withColumnRenamed("__level", "__olevel").withColumns({"__o" + k: F.col("__" + k) for k in "lrbt"}), "__o", levels(m, "__mlevel"))
    met = at.join(cells(m, "__m", levels(own, "__level")), [*key, "__level", "__cx", "__cy"])
    found = met.where((F.col("__level") == F.greatest("__olevel", "__mlevel")) & hit).select("__id").distinct()
    return named.join(found, "__id", "left_semi").drop("__id", "__l", "__r", "__b", "__t", "__level")


def text_in_boxes(glyphs: DataFrame, key: list[str], cell_w: float, cell_h: float, x: float = 0.0, y: float = 0.0) -> DataFrame:
    """key, column, row and text of the glyphs (ord, ch, x0, x1, y0, y1) whose centres lie in the boxes of a grid that
    begins at (x, y), in order; white space is left out."""
    column = F.floor(((F.col("x0") + F.col("x1")) / 2 - x) / cell_w)
    row = F.floor(((F.col("y0") + F.col("y1")) / 2 - y) / cell_h)
    boxed = glyphs.where(~F.col("ch").rlike(r"^\s$")).withColumns({"column": column, "row": row}).where("column >= 0 and row >= 0")
    listed = boxed.groupBy(*key, "column", "row").agg(F.sort_array(F.collect_list(F.struct("ord", "ch"))).alias("l"))
    return listed.select(*key, "column", "row", F.array_join(F.transform("l", lambda g: g["ch"]), "").alias("text"))


def merged(intervals: DataFrame, key: list[str], slack: float = 0) -> DataFrame:
    """key, start, stop and parts: intervals of a key that overlap, or lie no further apart than slack, become one."""
    w = Window.partitionBy(*key).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = intervals.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach + slack), 1).otherwise(0))
    island = flagged.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*key, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("parts")).drop("__island")


def clusters(values: DataFrame, key: list[str], value: str, gap: float) -> DataFrame:
    """key, cluster, size and mean: sorted values fall apart where two neighbours lie further apart than gap.

    Values of one stretch as wide as the gap never fall apart, so each stretch is one row before clusters are numbered:
    a key has as many rows there as its range holds gaps, however many values it has.
    """
    stretch = F.floor(F.col(value) / gap)
    parts = values.groupBy(*key, stretch.alias("__s")).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count("*").alias("n"), F.sum(value).alias("t"))
    w = Window.partitionBy(*key).orderBy("__s")
    new = F.when(F.col("__lo") - F.lag("__hi").over(w) > gap, 1).otherwise(0)
    numbered = parts.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*key, "cluster").agg(F.sum("n").alias("size"), (F.sum("t") / F.sum("n")).alias("mean"))


def crossing_rules(flat: DataFrame, tall: DataFrame, key: list[str], cell: float) -> DataFrame:
    """(key, a, b) of horizontal rules (a, x0, x1, y) and vertical ones (b, x, y0, y1) that cross or touch. They meet by
    the cells of a grid: a pair has one in common, so a page isn't compared throughout."""
    at = lambda c: F.floor(F.col(c) / cell)
    f = flat.select(*key, "a", "x0", "x1", "y", F.explode(F.sequence(at("x0"), at("x1"))).alias("__cx"), at("y").alias("__cy"))
    t = tall.select(*key, "b", "x", "y0", "y1", at("x").alias("__cx"), F.explode(F.sequence(at("y0"), at("y1"))).alias("__cy"))
    return f.join(t, [*key, "__cx", "__cy"]).where("x between x0 and x1 and y between y0 and y1").select(*key, "a", "b")


def otsu(greys: DataFrame, key: list[str]) -> DataFrame:
    """key, threshold: the grey level (0 to 255) that parts (key, grey) best, the first of equals; null for one level."""
    bins = greys.groupBy(*key, "grey").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy("grey")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*key)
    s = bins.withColumns({"w0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("grey")).over(upto), "t": F.sum("n").over(whole), "st": F.sum(F.col("n") * F.col("grey")).over(whole)})
    w1 = F.col("t") - F.col("w0")
    spread = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("st") - F.col("s0")) / w1, 2))
    return s.withColumn("b", F.round(spread, 4)).groupBy(*key).agg(F.max(F.when(F.col("b").isNotNull(), F.struct(F.col("b"), (-F.col("grey")).alias("g")))).alias("m")).select(*key, (-F.col("m.g")).alias("threshold"))


def skew(points: DataFrame, key: list[str], angles: list[float]) -> DataFrame:
    """key, angle and score of the tilt whose row profile changes most: the sum of squared differences of neighbours."""
    each = points.select(*key, "x", "y", F.explode(F.array(*[F.lit(float(a)) for a in angles])).alias("angle"))
    row = F.floor(F.col("y") * F.cos(F.radians("angle")) - F.col("x") * F.sin(F.radians("angle")) + 0.5).cast("long")
    bins = each.groupBy(*key, "angle", row.alias("b")).agg(F.count("*").alias("n"))
    edges = bins.select(*key, "angle", F.explode(F.array(F.struct(F.col("b").alias("b"), F.col("n").alias("d")), F.struct((F.col("b") - 1).alias("b"), (-F.col("n")).alias("d")))).alias("e"))
    steps = edges.groupBy(*key, "angle", "e.b").agg(F.sum("e.d").alias("d"))
    scores = steps.groupBy(*key, "angle").agg(F.sum(F.col("d") * F.col("d")).alias("score"))
    best = scores.groupBy(*key).agg(F.max(F.struct("score", (-F.col("angle")).alias("a"))).alias("m"))
    return best.select(*key, (-F.col("m.a")).alias("angle"), F.col("m.score").alias("score"))
