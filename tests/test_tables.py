"""Ruled tables: cells against sets of grid squares, hand-built pages, edges that no rule draws."""

import random

import numpy as np
import pyarrow as pa
from quire.operators import tables

RULE = "page long, x0 double, y0 double, x1 double, y1 double"
CHAR = "page long, line int, ord int, ch string, x0 double, y0 double, x1 double, y1 double"


def page_chars(page, texts):
    """Characters five wide and ten high of (text, x, y)."""
    return [(page, n, k, c, x + 5.0 * k, float(y), x + 5.0 * k + 5, y + 10.0) for n, (t, x, y) in enumerate(texts) for k, c in enumerate(t)]


def found(spark, rules, texts, page=1):
    df = tables.ruled_tables(spark.createDataFrame([(page, *map(float, r)) for r in rules], RULE), spark.createDataFrame(page_chars(page, texts), CHAR))
    return sorted((r.table, r.row, r.column, r.row_span, r.column_span, r.text) for r in df.collect())


XS, YS = (50.0, 150.0, 250.0, 350.0), (100.0, 130.0, 160.0, 190.0)
GRID = [(XS[0], y, XS[3], y) for y in YS] + [(x, YS[0], x, YS[3]) for x in XS]
NINE = [(f"t{r}{c}", XS[c] + 8, YS[r] + 8) for r in range(3) for c in range(3)]


def test_a_plain_table(spark):
    assert found(spark, GRID, NINE) == [(0, r, c, 1, 1, f"t{r}{c}") for r in range(3) for c in range(3)]


def test_rules_in_pieces_and_out_of_line(spark):
    pieces = [(XS[0] - 1, y - d, 200.0, y - d) for y, d in zip(YS, (0, 1.0, 0.5, 0), strict=True)] + [(201.0, y, XS[3] + 1, y) for y in YS] + GRID[4:]
    assert found(spark, pieces, NINE) == found(spark, GRID, NINE)


def test_a_cell_over_two_columns(spark):
    rules = [*GRID[:5], (XS[1], YS[1], XS[1], YS[3]), *GRID[6:]]
    got = found(spark, rules, [("total", 58, 108), ("price", 258, 108), ("A", 58, 138), ("B", 158, 138)])
    assert (0, 0, 0, 1, 2, "total") in got and (0, 1, 1, 1, 1, "B") in got and len(got) == 8


def test_two_tables_a_frame_and_an_underline(spark):
    lower = [(x0, y0 + 300, x1, y1 + 300) for x0, y0, x1, y1 in GRID]
    frame = [(400, 100, 500, 100), (400, 200, 500, 200), (400, 100, 400, 200), (500, 100, 500, 200)]
    texts = NINE + [("low", 60, 405), ("er", 160, 405), ("framed", 410, 150), ("head", 420, 20)]
    got = found(spark, lower + GRID + frame + [(420, 35, 460, 35)], texts)
    assert {r[0] for r in got} == {0, 1} and [r[5] for r in got if r[0] == 1 and r[5]] == ["low", "er"] and "framed" not in {r[5] for r in got}
    assert found(spark, GRID, [("one", 60, 105)]) == []  # one cell with text is no table
    assert found(spark, [(0, 5, 100, 5)], NINE) == []


def test_an_edge_that_no_rule_draws(spark):
    # no outer upright on the left, and a header without a rule above it
    rules = [(XS[0], y, XS[3], y) for y in YS[1:]] + [(x, YS[0], x, YS[3]) for x in XS[1:]]
    got = found(spark, rules, NINE)
    assert got == [(0, r, c, 1, 1, f"t{r}{c}") for r in range(3) for c in range(3)]
    # two rows of text stand in the strip above the rules, far enough apart to be rows
    rules = [(XS[0], y, XS[3], y) for y in YS[2:]] + [(x, YS[0], x, YS[3]) for x in XS]
    assert found(spark, rules, NINE) == got
    near = [(t, x, y if t[1] != "1" else YS[0] + 19) for t, x, y in NINE]  # the second line directly below the first
    assert [r for r in found(spark, rules, near) if r[1:3] == (0, 0)] == [(0, 0, 0, 1, 1, "t00\nt10")]


def test_a_page_is_dealt_out_once(spark):
    """Many pages and two tables on some: one shuffle, and nothing of the way is written before."""
    lower = [(x0, y0 + 300, x1, y1 + 300) for x0, y0, x1, y1 in GRID]
    rules = [(p, *map(float, r)) for p in range(40) for r in (GRID + lower if p % 2 else GRID)]
    chars = [c for p in range(40) for c in page_chars(p, NINE + [(t, x, y + 300) for t, x, y in NINE] * (p % 2))]
    made = tables.ruled_tables(spark.createDataFrame(rules, RULE), spark.createDataFrame(chars, CHAR))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.page, r.table, r.row, r.column): r.text for r in made.collect()}
    assert got == {(p, t, r, c): f"t{r}{c}" for p in range(40) for t in range(1 + p % 2) for r in range(3) for c in range(3)}


def test_cells_equal_sets_of_squares():
    rng = random.Random(6)
    spans = set()
    for _ in range(400):
        rows, columns = rng.randrange(1, 6), rng.randrange(1, 6)
        right_of = [[rng.random() < 0.6 for _ in range(columns - 1)] for _ in range(rows)]
        below = [[rng.random() < 0.6 for _ in range(columns)] for _ in range(rows - 1)]
        xs, ys = [30.0 * k for k in range(columns + 1)], [20.0 * k for k in range(rows + 1)]
        tall = [(xs[c + 1], ys[r], ys[r + 1]) for r in range(rows) for c in range(columns - 1) if right_of[r][c]]
        flat = []
        for r in range(rows - 1):  # neighbours make one rule, as merged rules are
            c = 0
            while c < columns:
                start = c
                while c < columns and below[r][c]:
                    c += 1
                if c > start:
                    flat.append((ys[r + 1], xs[start], xs[c]))
                c += 1
        got = list(tables.grid_cells(np.array(flat).reshape(-1, 3), np.array(tall).reshape(-1, 3), xs, ys, set()))

        def joined(r, c, w):  # the longest run of rules below the squares, as one rule must cover the share
            best = run = 0
            for k in range(c, c + w):
                run = run + 1 if below[r][k] else 0
                best = max(best, run)
            return best >= 0.6 * w

        want, taken = [], set()
        for r, c in np.ndindex(rows, columns):
            if (r, c) in taken:
                continue
            w = next((k for k in range(1, columns - c) if right_of[r][c + k - 1]), columns - c)
            h = next((k for k in range(1, rows - r) if joined(r + k - 1, c, w)), rows - r)
            squares = {(i, j) for i in range(r, r + h) for j in range(c, c + w)}
            if squares & taken:
                squares, w, h = {(r, c)}, 1, 1
            taken |= squares
            want.append((r, c, h, w))
        assert [g[:4] for g in got] == want
        assert sorted(s for r, c, h, w in want for s in ((i, j) for i in range(r, r + h) for j in range(c, c + w))) == sorted(np.ndindex(rows, columns))
        spans |= {g[2:4] for g in got}
    assert (2, 2) in spans and (1, 3) in spans


def _random_page(rng, page):
    """A grid with some rules left out, doubled, in pieces or out of line, and words in and beside it."""
    xs, ys = [sorted(rng.sample(range(0, 400, 20), rng.randrange(2, 5))) for _ in range(2)]
    plain = rng.random() < 0.7
    rules = [(page, x, y0, x, y1) for x in xs for y0, y1 in zip(ys, ys[1:]) if rng.random() < 0.9] + [(page, x0, y, x1, y) for y in ys for x0, x1 in zip(xs, xs[1:]) if rng.random() < 0.9]
    if not plain:
        rules += [rng.choice([(page, xs[0] - 30, ys[0], xs[-1], ys[0]), (page, xs[0] + 1, ys[0], xs[0] + 1, ys[-1]), (page, 900, 10, 950, 10), (page, 5, 5, 5, 5)])]
    words = [("".join(rng.choice("ab \u2003") for _ in range(rng.randrange(1, 5))), rng.randrange(0, 420) + (0.5 if plain else 0), rng.randrange(0, 400) + 0.25) for _ in range(14)]
    rng.shuffle(rules)
    return [(p, *map(float, r)) for p, *r in rules], [(p, None if n == 9 else n, k, c, *box) for p, n, k, c, *box in page_chars(page, words)]


def test_pages_together_equal_single_ones(spark):
    rng = random.Random(8)
    pages = {p: _random_page(rng, p) for p in range(600)}
    rules, chars = ([r for own in pages.values() for r in own[k]] for k in (0, 1))
    rng.shuffle(chars)
    want = []
    for p, (own, letters) in pages.items():
        sides = sorted((r[2], r[1], r[3]) for r in own if r[2] == r[4]), sorted((r[1], r[2], r[4]) for r in own if r[1] == r[3])
        ordered = sorted((c[1:] for c in letters), key=lambda c: (c[0] is not None, c[0] or 0, *c[1:]))
        want += [(p, *t) for t in tables.page_tables(sides, ordered)] if all(sides) else []
    seen, real = [], tables.page_tables
    df, text = spark.createDataFrame(rules, RULE), spark.createDataFrame(chars, CHAR)
    assert sorted(map(tuple, tables.ruled_tables(df, text).collect())) == sorted(want) and len({w[0] for w in want}) > 100
    schema = pa.schema([(f.name, t) for f, t in zip(tables.ruled_tables(df, text).schema, [pa.int64()] + [pa.int32()] * 5 + [pa.float64()] * 4 + [pa.bool_()] * 4 + [pa.string()], strict=True)])
    corner = ("x0", "y0", "x1", "y1")
    packed = [{"page": p, "rules": [None, *(dict(zip(corner, r[1:], strict=True)) for r in own)], "chars": [dict(zip(("line", "ord", "ch", *corner), c[1:], strict=True)) for c in letters]} for p, (own, letters) in pages.items()]
    tables.page_tables = lambda *a: (seen.append(a), real(*a))[1]
    try:
        made = [tuple(r.values()) for b in tables._tables_of(pa.RecordBatch.from_pylist(packed), schema) for r in b.to_pylist()]
    finally:
        tables.page_tables = real
    assert sorted(made) == sorted(want)
    assert 0 < len(seen) < 400  # most are looked at together


def test_rows_of_a_page_that_are_together_are_not_shuffled(spark, sf):
    from test_scale import plan

    from quire.plans.table_queries import k3_ruled_cells

    text = plan(k3_ruled_cells(spark, sf))
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1 and "Generate" not in text
