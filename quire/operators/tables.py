"""Tables drawn with rules: merged rules, the groups that cross, their grid, its cells and their text.

Spark deals out rules and characters by page, where they aren't dealt out so already, and sorts them once. A page's rules are merged, those that cross linked, their
places clustered to cuts, the cells read off the grid, and characters brought to cells. Plain pages (one table whose rules
stand in line, with all its edges drawn) go through these steps together, some thousands at once and by the shape of their
grids; other pages are walked one by one. A task holds that many rules and characters, or a page.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from quire.operators.groups import sort_keys, whole_groups

# Fixed values, in points: how near is the same line; the share of a cell's side that a rule must run along to part two
# cells, and to count as drawn; how far an outer edge lies from the outermost rule to be an edge of its own.
SNAP, PARTS, DRAWN, OUTER = 1.5, 0.6, 0.75, 6.0
SQUARE = 64.0
# How many rules and characters are looked at together; of how many pairs of rules, squares and upright cuts a plain page is at most, and how
# many plain pages of a shape make it worth while to look at them together.
TOGETHER, PAIRS, SQUARES, COLUMNS, FEW = 1 << 18, 4096, 96, 17, 4
# White space as Unicode has it, which is what Spark's (?U)\s takes.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = "".join(chr(k) for k in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
TRIMMED, SHOWN = re.compile(f"^[{SPACE}]+|[{SPACE}]+\\Z"), re.compile(f"[^{SPACE}]")


def merged_rules(rules: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Rules (at, start, stop) of one direction, collinear ones that touch made one.

    In order of place and start, a rule joins the one before it where both lie within SNAP and it starts no more than SNAP
    beyond its end; the place stays that of the first.
    """
    made: list[tuple[float, float, float]] = []
    for at, start, stop in rules:
        if made and abs(made[-1][0] - at) <= SNAP and start <= made[-1][2] + SNAP:
            made[-1] = made[-1][0], made[-1][1], max(made[-1][2], stop)
        else:
            made.append((at, start, stop))
    return made


def rule_groups(flat: list[tuple], tall: list[tuple]) -> list[tuple[list[tuple], list[tuple]]]:
    """The groups of merged rules that cross others, directly or through more of them, by their first flat rule."""
    up = list(range(len(flat) + len(tall)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    places = [t[0] for t in tall]
    for k, (at, start, stop) in enumerate(flat):
        for n in range(bisect_left(places, start - 2 * SNAP), bisect_right(places, stop + 2 * SNAP)):
            if tall[n][1] - 2 * SNAP <= at <= tall[n][2] + 2 * SNAP:
                one, two = sorted((top(k), top(len(flat) + n)))
                up[two] = one
    groups: dict[int, tuple[list, list]] = {}
    for n, rule in enumerate(flat + tall):
        groups.setdefault(top(n), ([], []))[n >= len(flat)].append(rule)
    return [g for g in groups.values() if g[0] and g[1]]


def cuts_of(rules: list[tuple]) -> list[float]:
    """The means of the rules' places, which fall apart where two neighbours lie over 2 * SNAP apart."""
    parts: list[list[float]] = []
    for at in sorted(r[0] for r in rules):
        if parts and at - parts[-1][-1] <= 2 * SNAP:
            parts[-1].append(at)
        else:
            parts.append([at])
    return [sum(p) / len(p) for p in parts]


def _completed(flat: np.ndarray, tall: np.ndarray, xs: list[float], ys: list[float], lines: np.ndarray) -> tuple[list[float], list[float], set[float]]:
    """Cuts (xs, ys) with the outer edges that no rule draws, and the row cuts that part although no rule is drawn there.

    An axis that has two cuts gets one at the end of the rules that cross it where at least two end there, beyond OUTER of
    the outermost cut. The strip added must be half as wide as its neighbour, or a quarter if it holds a line of text. Lines
    one below the other in a strip above or below, a quarter of a line apart, are rows of their own.
    """
    low = [min(flat[:, 1].min(), tall[:, 0].min()), min(tall[:, 1].min(), flat[:, 0].min())]
    high = [max(flat[:, 2].max(), tall[:, 0].max()), max(tall[:, 2].max(), flat[:, 0].max())]
    out, loose = [list(xs), list(ys)], set()
    for axis, (cuts, across) in enumerate(((xs, flat), (ys, tall))):
        if len(cuts) < 2:
            continue
        for first in (True, False):
            edge, cut, near = (low[axis], cuts[0], cuts[1]) if first else (high[axis], cuts[-1], cuts[-2])
            width = abs(cut - edge)
            if width <= OUTER:
                continue
            ends = (across[:, 1] <= edge + SNAP) if first else (across[:, 2] >= edge - SNAP)
            if ends.sum() < 2:
                continue
            box = [*low, *high]
            box[axis], box[axis + 2] = sorted((edge, cut))
            inside = lines[(lines[:, :2] >= np.array(box[:2]) - 1).all(axis=1) & (lines[:, 2:] <= np.array(box[2:]) + 1).all(axis=1)]
            if width < abs(cut - near) / (4 if len(inside) else 2):
                continue
            out[axis].append(edge)
            if axis == 1 and len(inside) > 1:
                inside = inside[np.argsort(inside[:, 1], kind="stable")]
                foot = np.maximum.accumulate(inside[:, 3])[:-1]
                apart = inside[1:, 1] - foot >= (inside[1:, 3] - inside[1:, 1]) / 4
                rows = ((foot + inside[1:, 1]) / 2)[apart].tolist()
                loose.update(rows)
                out[axis] += rows
    return sorted(out[0]), sorted(out[1]), loose


def grid_cells(flat: np.ndarray, tall: np.ndarray, xs: list[float], ys: list[float], loose: set[float]) -> Iterator[tuple]:
    """(row, column, row span, column span, x0, y0, x1, y1, top, right, bottom, left) of a grid's cells.

    A cell grows right while no upright rule runs along the cut, then down while no rule runs along all its width; where it
    would run into a cell that is there already it stays single. The last four tell which of its sides are drawn.
    """

    def near(rules: np.ndarray, cuts: list[float]) -> dict[float, list[tuple[float, float]]]:
        """The stretches of the rules at each cut."""
        ordered = sorted(rules.tolist())
        places = [r[0] for r in ordered]
        return {c: [(r[1], r[2]) for r in ordered[bisect_left(places, c - 2 * SNAP) : bisect_right(places, c + 2 * SNAP)]] for c in cuts}

    def along(rules: dict[float, list[tuple[float, float]]], at: float, start: float, stop: float, share: float) -> bool:
        least = (stop - start) * share
        return any(min(b, stop) - max(a, start) >= least for a, b in rules[at])

    flat, tall = near(flat, ys), near(tall, xs)
    free = [[True] * (len(xs) - 1) for _ in ys[1:]]
    for row, column in product(range(len(ys) - 1), range(len(xs) - 1)):
        if not free[row][column]:
            continue
        right = next((c for c in range(column + 1, len(xs) - 1) if along(tall, xs[c], ys[row], ys[row + 1], PARTS)), len(xs) - 1)
        below = next((r for r in range(row + 1, len(ys) - 1) if ys[r] in loose or along(flat, ys[r], xs[column], xs[right], PARTS)), len(ys) - 1)
        if not all(all(own[column:right]) for own in free[row:below]):
            right, below = column + 1, row + 1
        for own in free[row:below]:
            own[column:right] = [False] * (right - column)
        x0, y0, x1, y1 = xs[column], ys[row], xs[right], ys[below]
        drawn = [along(r, at, a, b, DRAWN) for r, at, a, b in ((flat, y0, x0, x1), (tall, x1, y0, y1), (flat, y1, x0, x1), (tall, x0, y0, y1))]
        yield row, column, below - row, right - column, x0, y0, x1, y1, *drawn


def table_cells(flat: list[tuple], tall: list[tuple], lines: np.ndarray) -> list[tuple]:
    """The cells, as in grid_cells, of a group of rules that has three upright cuts and two others; lines (x0, y0, x1, y1)
    are those of the page's text."""
    f, t = np.array(flat), np.array(tall)
    xs, ys, loose = _completed(f, t, cuts_of(tall), cuts_of(flat), lines)
    return list(grid_cells(f, t, xs, ys, loose)) if len(xs) >= 3 and len(ys) >= 2 else []


def text_of_cells(cells: list[tuple], chars: list[tuple]) -> list[str]:
    """The text of each cell: the characters (line, ord, ch, x0, y0, x1, y1), in order, whose centres it holds, edges
    included; a line's are trimmed, and lines without any left out. Cells are found by the squares of a grid."""
    squares: dict[tuple[int, int], list[int]] = {}
    for n, c in enumerate(cells):
        for gx in range(int(c[4] // SQUARE), int(c[6] // SQUARE) + 1):
            for gy in range(int(c[5] // SQUARE), int(c[7] // SQUARE) + 1):
                squares.setdefault((gx, gy), []).append(n)
    held: list[dict] = [{} for _ in cells]
    for line, _, ch, x0, y0, x1, y1 in chars:
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        for n in squares.get((int(cx // SQUARE), int(cy // SQUARE)), ()):
            c = cells[n]
            if c[4] <= cx <= c[6] and c[5] <= cy <= c[7]:
                held[n].setdefault(line, []).append(ch)
    return ["\n".join(t for own in h.values() if (t := TRIMMED.sub("", "".join(own)))) for h in held]


def page_tables(rules: tuple[list[tuple], list[tuple]], chars: list[tuple]) -> Iterator[tuple]:
    """table, the cell as in grid_cells, and its text, of a page's flat and tall rules and characters, both in order."""
    boxes: dict = {}
    for line, _, ch, x0, y0, x1, y1 in chars:
        b = boxes.get(line)
        boxes[line] = (min(b[0], x0), min(b[1], y0), max(b[2], x1), max(b[3], y1), b[4] or bool(SHOWN.search(ch))) if b else (x0, y0, x1, y1, bool(SHOWN.search(ch)))
    lines = np.array([b[:4] for b in boxes.values() if b[4]], float).reshape(-1, 4)
    found = []
    for group in rule_groups(*map(merged_rules, rules)):
        cells = table_cells(*group, lines)
        texts = text_of_cells(cells, chars) if len(cells) >= 4 else []
        if sum(t != "" for t in texts) >= 2:
            found.append((min(c[5] for c in cells), min(c[4] for c in cells), cells, texts))
    for n, (_, _, cells, texts) in enumerate(sorted(found, key=lambda g: g[:2])):
        yield from ((n, *c, t) for c, t in zip(cells, texts, strict=True))


def _turns(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns; the first does."""
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])[: len(columns[0])]


def _rising(*columns: np.ndarray) -> bool:
    """Whether each row comes after the one before it, by the first column that differs."""
    after, same = np.zeros(max(0, len(columns[0]) - 1), bool), True
    for c in columns:
        after, same = after | (same & (c[1:] > c[:-1])), same & (c[1:] == c[:-1])
    return bool(after.all())


def _joined(page: np.ndarray, kind: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rules in order of all these, those of one place that touch made one, as merged_rules does where places are the same or
    lie far apart."""
    place = np.cumsum(_turns(page, kind, at))
    reach, step = stop.copy(), 1
    while step < len(reach) and (place[step:] == place[:-step]).any():  # the greatest so far at the place
        reach[step:] = np.where(place[step:] == place[:-step], np.maximum(reach[step:], reach[:-step]), reach[step:])
        step *= 2
    fresh = _turns(place)
    fresh[1:] |= start[1:] > reach[:-1] + SNAP
    first = np.flatnonzero(fresh)
    return page[first], kind[first], at[first], start[first], np.maximum.reduceat(stop, first) if len(first) else stop


def _one_group(n: int, page: np.ndarray, kind: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of n pages, which have flat and upright rules that hang together, all of them, in few steps."""
    flat, tall = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    flats, talls = np.bincount(page[flat], minlength=n), np.bincount(page[tall], minlength=n)
    good = (flats > 0) & (talls > 0) & (flats * talls <= PAIRS)
    flat = flat[good[page[flat]]]
    count = talls[page[flat]]
    one = np.repeat(flat, count)
    first = np.cumsum(talls) - talls
    two = tall[np.repeat(first[page[flat]], count) + np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count)]
    cross = (at[two] >= start[one] - 2 * SNAP) & (at[two] <= stop[one] + 2 * SNAP) & (at[one] >= start[two] - 2 * SNAP) & (at[one] <= stop[two] + 2 * SNAP)
    one, two = one[cross], two[cross]
    label = np.arange(len(page))
    for _ in range(4):
        np.minimum.at(label, two, label[one])
        np.minimum.at(label, one, label[two])
    lowest, highest = np.full(n, len(page)), np.full(n, -1)
    np.minimum.at(lowest, page, label)
    np.maximum.at(highest, page, label)
    return good & (lowest == highest)


def _grown(upright: np.ndarray, across: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """(pages, row, column, below, right) of the cells of grids of one shape, as in grid_cells, and the square where the cell
    of each square begins. upright (page, cut, row) and across (column, right, page, cut) tell where rules part cells."""
    pages, rows, columns = len(upright), upright.shape[2], upright.shape[1] - 1
    free, owner, cells = np.ones((pages, rows, columns), bool), np.zeros((pages, rows, columns), int), []
    down, along = np.arange(rows)[:, None], np.arange(columns)
    for row, column in product(range(rows), range(columns)):
        own = np.flatnonzero(free[:, row, column])
        end = np.ones((len(own), 1), bool)
        right = column + 1 + np.hstack([upright[own, column + 1 : columns, row], end]).argmax(axis=1)
        below = row + 1 + np.hstack([across[column, right, own][:, row + 1 : rows], end]).argmax(axis=1)
        held = lambda below, right: (down >= row) & (down < below[:, None, None]) & (along >= column) & (along < right[:, None, None])  # noqa: B023, E731
        taken = (held(below, right) & ~free[own]).any(axis=(1, 2))
        right, below = np.where(taken, column + 1, right), np.where(taken, row + 1, below)
        inside = held(below, right)
        free[own] &= ~inside
        owner[own] = np.where(inside, row * columns + column, owner[own])
        cells.append((own, row, column, below, right))
    return cells, owner


def _same_shape(xs: np.ndarray, ys: np.ndarray, flat: tuple, tall: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The cells of pages whose cuts are xs and ys (a row a page), in order, and the cell of each square. flat and tall: the
    places, by page and cut, of the rules, their starts and stops."""

    def covered(rules: tuple, a: np.ndarray, b: np.ndarray, share: float, at: np.ndarray) -> np.ndarray:
        """Whether a rule of the place `at` runs along the share of a to b."""
        first, start, stop = rules
        number, hit = np.diff(first)[at], np.zeros(len(at), bool)
        for k in range(number.max(initial=0)):
            n = first[at] + np.minimum(k, number - 1)
            hit |= np.minimum(stop[n], b) - np.maximum(start[n], a) >= (b - a) * share
        return hit

    pages, nx, ny = len(xs), xs.shape[1], ys.shape[1]
    page = np.arange(pages)
    at_x, at_y = ((page[:, None] * k + np.arange(k)).ravel() for k in (nx, ny))
    upright = np.stack([covered(tall, np.repeat(ys[:, r], nx), np.repeat(ys[:, r + 1], nx), PARTS, at_x).reshape(pages, nx) for r in range(ny - 1)], axis=2)
    across = np.zeros((nx, nx, pages, ny), bool)
    for a in range(nx):
        for b in range(a + 1, nx):
            across[a, b] = covered(flat, np.repeat(xs[:, a], ny), np.repeat(xs[:, b], ny), PARTS, at_y).reshape(pages, ny)
    cells, owner = _grown(upright, across)
    p, row, column, below, right = (np.concatenate([np.broadcast_to(c[k], len(c[0])) for c in cells]) for k in range(5))
    order = np.lexsort([column, row, p])
    p, row, column, below, right = (c[order] for c in (p, row, column, below, right))
    x0, y0, x1, y1 = xs[p, column], ys[p, row], xs[p, right], ys[p, below]
    sides = {"top": covered(flat, x0, x1, DRAWN, p * ny + row), "right": covered(tall, y0, y1, DRAWN, p * nx + right), "bottom": covered(flat, x0, x1, DRAWN, p * ny + below), "left": covered(tall, y0, y1, DRAWN, p * nx + column)}
    number = np.zeros((pages, (nx - 1) * (ny - 1)), int)
    number[p, row * (nx - 1) + column] = np.arange(len(p))
    return {"p": p, "row": row, "column": column, "row_span": below - row, "column_span": right - column, "x0": x0, "y0": y0, "x1": x1, "y1": y1, **sides}, number[page[:, None, None], owner]


def _plain_pages(n: int, rules: tuple[np.ndarray, ...], chars: tuple[np.ndarray, ...]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Which of n pages are plain, their cells, and the cell of each character (-1: none).

    rules: page, kind, place, start and stop in this order; chars: page and centre. A plain page has no two places nearer than
    two cuts can be, one group of rules, rules that end near the outermost cuts, and no character on a cut.
    """
    plain, empty = np.ones(n, bool), np.full(len(chars[0]), -1)
    page, _, at, start, stop = rules
    plain[page[~((start <= stop) & np.isfinite(at))]] = False
    page, kind, at, start, stop = _joined(*rules)
    fresh = _turns(page, kind, at)
    cut = np.flatnonzero(fresh)
    near = (page[cut][1:] == page[cut][:-1]) & (kind[cut][1:] == kind[cut][:-1]) & ~(at[cut][1:] - at[cut][:-1] > 2 * SNAP)
    plain[page[cut][1:][near]] = False
    plain &= _one_group(n, page, kind, at, start, stop)
    for k in (0, 1):  # rules of one kind end near the outermost cuts of the other
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        other = kind != k
        np.minimum.at(low, page[other], at[other])
        np.maximum.at(high, page[other], at[other])
        own = kind == k
        plain[page[own][(low[page[own]] - start[own] > OUTER) | (stop[own] - high[page[own]] > OUTER)]] = False
    cut_page, cut_kind, cut_at = page[cut], kind[cut], at[cut]
    ny, nx = (np.bincount(cut_page[cut_kind == k], minlength=n) for k in (0, 1))
    plain &= ((nx - 1) * (ny - 1) <= SQUARES) & (nx <= COLUMNS)
    wanted = plain & (nx >= 3) & (ny >= 2)
    shape = np.where(wanted, nx * (SQUARES + 2) + ny, -1)
    made, cell, count = [], empty, 0
    cut_ends = np.append(cut, len(page))
    for s in np.unique(shape[wanted]):
        own = np.flatnonzero(shape == s)
        local = np.full(n, -1)
        local[own] = np.arange(len(own))
        cuts = [cut_at[(cut_kind == k) & (local[cut_page] >= 0)].reshape(len(own), -1) for k in (1, 0)]
        mine = np.flatnonzero(local[chars[0]] >= 0)
        p = local[chars[0][mine]]
        squares, on = [], np.zeros(len(mine), bool)
        for centre, places in zip((chars[1][mine], chars[2][mine]), cuts, strict=True):
            squares.append((centre[:, None] > places[p]).sum(axis=1) - 1)
            on |= (centre[:, None] == places[p]).any(axis=1)
        good = np.ones(len(own), bool)
        good[p[on]] = False
        if good.sum() < FEW:
            plain[own] = False
            continue
        plain[own[~good]] = False
        kept = np.cumsum(good) - 1
        sides = []
        for k in (0, 1):
            places = np.flatnonzero((cut_kind == k) & (local[cut_page] >= 0) & np.append(good, False)[local[cut_page]])
            number = cut_ends[places + 1] - cut_ends[places]
            rule = np.repeat(cut_ends[places] - (np.cumsum(number) - number), number) + np.arange(number.sum())
            sides.append((np.append(0, np.cumsum(number)), start[rule], stop[rule]))
        cells, of = _same_shape(cuts[0][good], cuts[1][good], *sides)
        cells["p"] = own[good][cells["p"]]
        inside = good[p] & (squares[0] >= 0) & (squares[0] < of.shape[2]) & (squares[1] >= 0) & (squares[1] < of.shape[1])
        cell[mine[inside]] = count + of[kept[p[inside]], squares[1][inside], squares[0][inside]]
        count += len(cells["p"])
        made.append(cells)
    return plain, {c: np.concatenate([m[c] for m in made]) for c in made[0]} if made else {}, cell


def _texts(cells: int, cell: np.ndarray, line: np.ndarray, ch: pa.Array) -> pa.Array:
    """The text of each cell, as in text_of_cells, of the cell, line and letter of characters in order."""
    order = np.argsort(cell, kind="stable")
    order = order[cell[order] >= 0]
    cell, line = cell[order], line[order]
    first = np.flatnonzero(_turns(cell, line)) if len(order) else np.zeros(0, int)
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    texts = pc.utf8_trim(pc.binary_join(lists([*first, len(order)], ch.take(pa.array(order))), ""), SPACES)
    shown = pc.not_equal(texts, "")
    number = np.bincount(cell[first][shown.to_numpy(zero_copy_only=False)], minlength=cells)
    return pc.binary_join(lists(np.append(0, np.cumsum(number)), texts.filter(shown)), "\n")


def _parts(rows: pa.RecordBatch, column: str, page: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The pages and fields of what the rows' lists hold, but for nulls."""
    lists = rows.column(column)
    page, own = np.repeat(page, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()
    if own.null_count:
        page, own = page[own.is_valid().to_numpy(zero_copy_only=False)], own.drop_null()
    return page, {f.name: pc.struct_field(own, f.name) for f in own.type}


def _tables_of(rows: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The tables, as in tables_on, of whole pages."""
    fresh = _turns(rows.column("page").to_numpy(zero_copy_only=False))
    number, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    page, sides = _parts(rows, "rules", number)
    x0, y0, x1, y1 = (sides[c].to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))
    flat, tall = np.flatnonzero(y0 == y1), np.flatnonzero(x0 == x1)
    both = lambda a, b: np.concatenate([a[flat], b[tall]])
    rules = both(page, page), np.repeat([0, 1], [len(flat), len(tall)]), both(y0, x0), both(x0, y0), both(x1, y1)
    order = np.lexsort(rules[3::-1])
    rules = tuple(c[order] for c in rules)
    page, own = _parts(rows, "chars", number)
    if not _rising(page, *reversed(sort_keys(own["line"])), *reversed(sort_keys(own["ord"]))):
        order = np.lexsort([*sort_keys(own["ch"]), *sort_keys(own["ord"]), *sort_keys(own["line"]), page])
        page, own = page[order], {k: v.take(pa.array(order)) for k, v in own.items()}
    line, ch = np.cumsum(_turns(page, *sort_keys(own["line"]))), pc.fill_null(own["ch"], "")
    x0, y0, x1, y1 = corners = [own[c].to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")]
    plain, cells, cell = _plain_pages(len(first), rules, (page, (x0 + x1) / 2, (y0 + y1) / 2))
    if cells:
        texts = _texts(len(cells["p"]), cell, line, ch)
        full = np.bincount(cells["p"][pc.not_equal(texts, "").to_numpy(zero_copy_only=False)], minlength=len(first)) >= 2
        kept = np.flatnonzero((full & (np.bincount(cells["p"], minlength=len(first)) >= 4))[cells["p"]])
        columns = [rows.column("page").take(pa.array(first[cells["p"][kept]])), pa.array(np.zeros(len(kept), int)), *(pa.array(cells[f.name][kept]) for f in list(schema)[2:-1]), texts.take(pa.array(kept))]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    out: list[tuple] = []
    rule_ends, char_ends = (np.searchsorted(c, np.arange(len(first) + 1)) for c in (rules[0], page))
    for n in np.flatnonzero(~plain):
        a, b = rule_ends[n : n + 2]
        found = tuple([r[1:] for r in zip(*(c[a:b].tolist() for c in rules[1:]), strict=True) if r[0] == k] for k in (0, 1))
        if all(found):
            a, b = char_ends[n : n + 2]
            letters = list(zip(*(c.slice(a, b - a).to_pylist() for c in (own["line"], own["ord"], ch)), *(c[a:b].tolist() for c in corners), strict=True))
            out += ((rows.column("page")[first[n]].as_py(), *t) for t in page_tables(found, letters))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def ruled_tables(rules: DataFrame, chars: DataFrame) -> DataFrame:
    """(page, table, row, column, row_span, column_span, x0, y0, x1, y1, top, right, bottom, left, text) of the tables that
    axis-parallel rules (page, x0, y0, x1, y1) draw around characters (page, line, ord, ch, x0, y0, x1, y1); y grows
    downwards.

    A table has four cells and two that aren't empty, at least; tables of a page are numbered from top to bottom. Pages
    without rules that cross have none.
    """
    corner = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    own = rules.select("page", F.array(F.struct(*corner)).alias("rules"))
    return tables_on(own.unionByName(chars.select("page", F.array(F.struct("line", "ord", "ch", *corner)).alias("chars")), allowMissingColumns=True))


def tables_on(rows: DataFrame) -> DataFrame:
    """The same of rows (page, rules, chars), lists of what ruled_tables takes; a page may come in several. Nulls are left out."""
    made = f"page {dict(rows.dtypes)['page']}, `table` int, row int, column int, row_span int, column_span int, x0 double, y0 double, x1 double, y1 double, top boolean, right boolean, bottom boolean, left boolean, text string"
    schema = to_arrow_schema(_parse_datatype_string(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "page", TOGETHER, lambda b: len(b.column("rules").flatten()) + len(b.column("chars").flatten())):
            yield from _tables_of(whole, schema)

    # a window brings a page's rows together, which shuffles them only where they aren't yet
    together = rows.select("page", "rules", "chars", F.count("*").over(Window.partitionBy("page")).alias("n"))
    return together.mapInArrow(run, made)
