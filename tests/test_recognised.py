"""Recognised words put together again, against plain versions and hand-built pages."""

import random
import statistics

import numpy as np
from quire.operators import recognised as rc

LINE = "page long, line int, part long, x0 double, y0 double, x1 double, y1 double, baseline double, size double, region int, text string"


def made(spark, boxes):
    """Paragraphs of lines (x0, top, x1, text) ten high, as lists of texts in the order they are read."""
    rows = [(1, k, 0, float(x0), float(y), float(x1), float(y) + 10, float(y) + 8, 10.0, 0, t) for k, (x0, y, x1, t) in enumerate(boxes)]
    out = {}
    for r in rc.paragraphs(spark.createDataFrame(rows, LINE)).orderBy("paragraph", "place").collect():
        out.setdefault(r.paragraph, []).append(r.text)
    return list(out.values())


def test_two_columns_and_a_heading(spark):
    lines = [(0, 0, 400, "heading")] + [(0, 60 + 14 * k, 180, f"left {k}") for k in range(4)] + [(220, 60 + 14 * k, 400, f"right {k}") for k in range(4)]
    lines += [(0, 130 + 14 * k, 180, f"left more {k}") for k in range(2)] + [(220, 130 + 14 * k, 400, f"right more {k}") for k in range(2)]
    assert made(spark, lines) == [["heading"], [f"left {k}" for k in range(4)], ["left more 0", "left more 1"], [f"right {k}" for k in range(4)], ["right more 0", "right more 1"]]


def test_cards_are_read_row_by_row(spark):
    lines = [(x, y + 14 * k, x + 80, f"{n}{k}") for n, (x, y) in zip("abcd", ((0, 0), (120, 0), (0, 100), (120, 100)), strict=True) for k in range(2)]
    assert made(spark, lines) == [[f"{n}0", f"{n}1"] for n in "abcd"]
    wide = [(x * 3, y, x * 3 + 80, t) for x, y, _, t in lines]  # a gutter much wider than the gap between rows
    assert made(spark, wide) == [[f"{n}0", f"{n}1"] for n in "acbd"]


def plain_order(items, size):
    """Recursive cuts over (box, lines, name)."""

    def widest(axis):
        own, best = sorted(items, key=lambda i: i[0][axis]), None
        for k in range(1, len(own)):
            gap = own[k][0][axis] - max(i[0][axis + 2] for i in own[:k])
            extent = lambda part: (min(i[0][1] for i in part), max(i[0][3] for i in part))
            (a, b), (c, d) = extent(own[:k]), extent(own[k:])
            beside = axis == 1 or min(b, d) - max(a, c) >= 0.33 * min(b - a, d - c)
            if gap > 0 and beside and (best is None or gap > best[0]):
                best = gap, own, k
        return best

    if len(items) < 2:
        return [i[2] for i in items]
    rows, columns = widest(1), widest(0)
    cut = rows or columns
    if rows and columns:
        text = all(any(i[1] > 1 for i in side) for side in (columns[1][: columns[2]], columns[1][columns[2] :]))
        cut = rows if rows[0] >= 0.6 * columns[0] and (rows[0] >= 2.5 * size or columns[0] < 1.5 * size or not text) else columns
    if cut:
        return plain_order(cut[1][: cut[2]], size) + plain_order(cut[1][cut[2] :], size)
    lines = []
    for item in sorted(items, key=lambda i: (i[0][1], i[0][0])):
        b = item[0]
        row = next((r for r in lines if any(min(b[3], o[0][3]) - max(b[1], o[0][1]) >= 0.5 * min(b[3] - b[1], o[0][3] - o[0][1]) for o in r)), None)
        lines.append([item]) if row is None else row.append(item)
    return [i[2] for row in lines for i in sorted(row, key=lambda i: i[0][0])]


def test_order_equals_a_plain_recursion():
    rng = random.Random(12)
    for _ in range(600):
        items = []
        for k in range(rng.randrange(1, 14)):
            x, y = rng.randrange(0, 400, 7), rng.randrange(0, 400, 5)
            items.append(((x, y, x + rng.randrange(5, 120), y + rng.randrange(5, 90)), rng.randrange(1, 4), k))
        size = rng.choice([3.0, 10.0, 30.0])
        got = rc.cut_order(np.array([i[0] for i in items], float), np.array([i[1] for i in items]), size)
        assert got == plain_order(items, size)


def test_lines_are_cut_as_a_plain_walk_cuts_them(spark):
    rng = random.Random(13)
    words = []
    for line in range(80):
        for k in range(rng.randrange(1, 12)):
            x = float(rng.randrange(0, 300))
            words.append((1, line, k, f"w{k}", x, 10.0, x + rng.randrange(1, 60), 20.0, 18.0, float(rng.choice([8, 10, 14])), rng.choice([0, 0, 0, 1, None])))
    df = spark.createDataFrame(words, "page long, line int, word int, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double, region int")
    want = set()
    for line in range(80):
        own = sorted((w for w in words if w[1] == line), key=lambda w: (w[4], w[2]))
        reach, pieces, right = 1.5 * statistics.median(w[9] for w in own), [], 0.0
        for w in own:
            if pieces and w[4] - right <= reach and w[10] == pieces[-1][0][10]:
                pieces[-1].append(w)
                right = max(right, w[6])
            else:
                pieces.append([w])
                right = w[6]
        want |= {(line, n, " ".join(w[3] for w in p), min(w[4] for w in p), max(w[6] for w in p)) for n, p in enumerate(pieces)}
    assert {(r.line, r.part, r.text, r.x0, r.x1) for r in rc.cut_lines(df).collect()} == want
