"""Operators whose next step depends on all before: each walks one page or block, which has few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.operators.groups import walk_groups


LEADING = 1.2  # of the size, where a block has a single line


def merged_paragraphs(blocks: DataFrame, dealt_out: bool = False) -> DataFrame:
    """(page, block, paragraph) of (page, block, x0, x1, size, font, orientation, baselines), in reading order: a block
    joins the one before, as merged so far, if both are horizontal, the font is the same, sizes differ by at most 0.5,
    the gap from its last baseline is above 0 and at most 1.6 of the larger leading, and they overlap by half the
    narrower. A leading is the median distance of baselines; a merged block has that of all its lines."""

    def leading(lines: list[float], size: float) -> float:
        gaps = sorted(abs(b - a) for a, b in zip(lines, lines[1:]))  # noqa: B905
        middle = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2 if gaps else 0.0
        return middle if middle > 0 else size * LEADING

    def walk(page):
        last, lines, number = None, [], -1
        for b in page:
            own, joins = list(b.baselines), False
            if last is not None and last.orientation == b.orientation == "horizontal" and b.font == last.font and abs(b.size - last.size) <= 0.5:
                gap, narrower = own[0] - lines[-1], min(b.x1 - b.x0, last.x1 - last.x0)
                shared = min(b.x1, last.x1) - max(b.x0, last.x0)
                joins = 0 < gap <= 1.6 * max(leading(lines, last.size), leading(own, b.size)) and narrower > 0 and shared >= 0.5 * narrower
            if joins:
                last, lines = last._replace(x0=min(last.x0, b.x0), x1=max(last.x1, b.x1)), sorted(lines + own)
            else:
                number, last, lines = number + 1, b, own
            yield b.page, b.block, number

    return walk_groups(blocks, "page", ["block"], walk, "page long, block int, paragraph int", dealt_out)


def export_lines(pieces: DataFrame) -> DataFrame:
    """(page, paragraph, line, text) of (page, ord, text, x, y, size, width), left to right: a piece joins the first line
    within half its size (1 at least); lines run from the top. A gap between near edges of over 0.15 of the larger size is
    a space; white space folds, and blank lines go. Lines further apart than 1.6 of the larger size part paragraphs."""

    def joined(line: list) -> str:
        text, last = "", None
        for p in sorted(line, key=lambda p: p.x):
            if last is not None and max(p.x - (last.x + last.width), last.x - (p.x + p.width)) > 0.15 * max(last.size, p.size):
                text += " "
            text, last = text + p.text, p
        return " ".join(text.split())

    def walk(page):
        lines: list[list] = []
        for p in page:
            own = next((x for x in lines if abs(x[0].y - p.y) <= max(1.0, p.size * 0.5)), None)
            if own is None:
                lines.append([p])
            else:
                own.append(p)
        paragraph, number, last = 0, 0, None
        for line in sorted(lines, key=lambda x: -x[0].y):
            text, y, size = joined(line), line[0].y, max(p.size for p in line)
            if not text:
                continue
            if last is not None and last[0] - y > 1.6 * max(last[1], size):
                paragraph += 1
            yield line[0].page, paragraph, number, text
            number, last = number + 1, (y, size)

    return walk_groups(pieces, "page", ["ord"], walk, "page long, paragraph int, line int, text string")


def suppressed(words: DataFrame, share: float = 0.3, dealt_out: bool = False) -> DataFrame:
    """(page, word, kept) of (page, word, x0, y0, x1, y1, confidence): larger, then surer, then earlier words stay; one
    that overlaps a kept word by more than a share of the smaller area goes. Kept words are found by the cells of a grid
    as wide as a usual word, so a page is not compared throughout."""

    def area(w) -> float:
        return (w.x1 - w.x0) * (w.y1 - w.y0)

    def walk(page):
        own = list(page)
        wide = max(1e-9, sum(w.x1 - w.x0 for w in own) / len(own))
        tall = max(1e-9, sum(w.y1 - w.y0 for w in own) / len(own))
        grid: dict[tuple[int, int], list] = {}
        for w in sorted(own, key=lambda w: (-area(w), -w.confidence, w.word)):
            cells = [(i, j) for i in range(int(w.x0 // wide), int(w.x1 // wide) + 1) for j in range(int(w.y0 // tall), int(w.y1 // tall) + 1)]

            def twice(k, w=w) -> bool:
                across, down = min(w.x1, k.x1) - max(w.x0, k.x0), min(w.y1, k.y1) - max(w.y0, k.y0)
                return across > 0 and down > 0 and across * down > share * min(area(w), area(k))

            over = any(twice(k) for c in cells for k in grid.get(c, ()))
            if not over:
                for c in cells:
                    grid.setdefault(c, []).append(w)
            yield w.page, w.word, not over

    return walk_groups(words, "page", ["word"], walk, "page long, word int, kept boolean", dealt_out)


def regular_tables(cells: DataFrame) -> DataFrame:
    """(table, regular) of (table, row, ord, row_span, col_span): cells fill the free places of a row from the left; a
    table is regular if no row that it has leaves a gap and all are as wide as the first. What a span covers below the
    last row doesn't count."""

    def walk(table):
        taken: dict[int, set[int]] = {}
        rows: list[int] = []
        at = 0
        for c in table:
            if not rows or rows[-1] != c.row:
                rows.append(c.row)
                at = 0
            own = taken.setdefault(len(rows) - 1, set())
            while at in own:
                at += 1
            wide = max(1, c.col_span)
            for i in range(max(1, c.row_span)):
                taken.setdefault(len(rows) - 1 + i, set()).update(range(at, at + wide))
            at += wide
        full = set(range(max(taken[0]) + 1))
        yield c.table, all(taken[k] == full for k in range(len(rows)))

    return walk_groups(cells, "table", ["row", "ord"], walk, f"table {dict(cells.dtypes)['table']}, regular boolean")


def varied_selection(words: DataFrame, most: int = 40, letters: int = 4) -> DataFrame:
    """(page, place, word) of (page, ord, word, bold, italic, size): at each step the word with most characters not seen
    yet, the longer of equals, then the earlier; at most 40, which is the size of a sample to match fonts with. Words that
    are bold, italic, without a size or of fewer than four letters are left out. Of words with the same characters the
    longest and earliest come first, so only the first `most` of each such set are kept in memory."""

    def walk(page):
        sets: dict[frozenset, list] = {}
        for w in page:
            if not w.bold and not w.italic and w.size > 0 and sum(c.isalpha() for c in w.word) >= letters:
                own = sets.setdefault(frozenset(w.word), [])
                own.append((-len(w.word), w.ord, w.word, w.page))
                if len(own) > 2 * most:
                    own.sort()
                    del own[most:]
        for own in sets.values():
            own.sort(reverse=True)
        seen: set[str] = set()
        for place in range(most):
            if not sets:
                return
            chars = min(sets, key=lambda s: (-len(s - seen), sets[s][-1][:2]))
            _, _, word, key = sets[chars].pop()
            if not sets[chars]:
                del sets[chars]
            seen |= chars
            yield key, place, word

    return walk_groups(words, "page", ["ord"], walk, "page long, place int, word string")


def unique_names(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """(key, name, unique): names that repeat in a key, in any case, get 2, 3 and so on, past those that are taken."""

    def walk(group):
        taken: set[str] = set()
        last: dict[str, int] = {}
        for r in group:
            n = getattr(r, name)
            found, k = n, last.get(n.lower(), 1)
            while found.lower() in taken:
                k += 1
                found = f"{n} {k}"
            last[n.lower()] = k
            taken.add(found.lower())
            yield getattr(r, key), n, found

    return walk_groups(rows.select(key, name, order), key, [order], walk, f"{key} {dict(rows.dtypes)[key]}, {name} string, `unique` string")
