"""Pages built from glyphs, against a plain builder that goes glyph by glyph."""

import math
import random
import statistics

from quire.operators import text_page as tp

GLYPH = "page long, block int, line int, ord int, ch string, x0 double, y0 double, x1 double, y1 double, ox double, oy double, size double, font string, baseline double"
GAPS = " \t\r\n\f\xa0"


def union(boxes):
    return [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]


def orientation(a, b):
    dx, dy = (b[0] + b[2] - a[0] - a[2]) / 2, (b[1] + b[3] - a[1] - a[3]) / 2
    n = math.hypot(dx, dy)
    if n == 0:
        return "horizontal"
    return ("horizontal" if dx >= 0 else "reversed") if abs(dx) / n >= 0.98 else "vertical" if abs(dy) / n >= 0.98 else "skewed"


def plain_line(glyphs):
    seen, gap = [], False
    for g in glyphs:
        if g[4] in GAPS:
            gap = bool(seen)
            continue
        seen.append((g, gap))
        gap = False
    if not seen:
        return None
    dx, dy = seen[-1][0][9] - seen[0][0][9], seen[-1][0][10] - seen[0][0][10]
    n = math.hypot(dx, dy)
    dx, dy = (dx / n, dy / n) if n else (1.0, 0.0)
    rect = lambda g: [min(g[5], g[7]), min(g[6], g[8]), max(g[5], g[7]), max(g[6], g[8])]
    extent = lambda r: abs(dx) * (r[2] - r[0]) + abs(dy) * (r[3] - r[1])
    centre = lambda r: (r[0] + r[2]) / 2 * dx + (r[1] + r[3]) / 2 * dy
    words, last = [], None
    for g, apart in seen:
        r = rect(g)
        if last is not None and (apart or centre(r) - centre(last[0]) - (extent(last[0]) + extent(r)) / 2 > 0.15 * max(last[1], g[11])) or last is None:
            words.append([])
        words[-1].append((g[4], r))
        last = (r, g[11])
    boxes = [r for w in words for _, r in w]
    return {"text": " ".join("".join(c for c, _ in w) for w in words), "box": union(boxes), "baseline": glyphs[0][13], "way": orientation(boxes[0], boxes[-1])}


def align(lines, box, width):
    near = lambda a, b: abs(a - b) <= 1.0
    left, right = all(near(x["box"][0], box[0]) for x in lines), [near(x["box"][2], box[2]) for x in lines]
    middle = (box[0] + box[2]) / 2
    if len(lines) > 1:
        if left and all(right[:-1]) and not right[-1]:
            return "justify"
        if all(right) and not left:
            return "right"
        if not left and all(near((x["box"][0] + x["box"][2]) / 2, middle) for x in lines):
            return "center"
    elif near(middle, width / 2):
        return "center"
    return "left"


def leading(lines, size):
    gaps = [abs(b["baseline"] - a["baseline"]) for a, b in zip(lines, lines[1:], strict=False)]
    return statistics.median(gaps) if gaps and statistics.median(gaps) > 0 else 1.2 * size


def ordered(lines):
    return sorted(lines, key=lambda x: (x["baseline"], x["box"][0])) if all(x["way"] == "horizontal" for x in lines) else lines


def plain_page(glyphs, width):
    blocks = []
    for b in sorted({g[1] for g in glyphs}):
        own = [g for g in glyphs if g[1] == b]
        lines = [x for n in sorted({g[2] for g in own}) if (x := plain_line([g for g in own if g[2] == n]))]
        seen = [g for g in own if g[4] not in GAPS]
        sizes = [g[11] for g in seen if g[11] > 0]
        if not lines or not sizes:
            continue
        counts, font, best = {}, None, 0
        for g in seen:
            if g[12]:
                counts[g[12]] = counts.get(g[12], 0) + 1
                if counts[g[12]] > best:
                    font, best = g[12], counts[g[12]]
        lines = ordered(lines)
        turned = next((x["way"] for x in lines if x["way"] in ("vertical", "reversed")), None)
        way = turned or ("skewed" if any(x["way"] == "skewed" for x in lines) else "horizontal")
        size, box = statistics.median(sizes), union([x["box"] for x in lines])
        blocks.append({"lines": lines, "box": box, "font": font, "size": size, "leading": leading(lines, size), "way": way, "align": align(lines, box, width)})
    out = []
    for b in blocks:
        last = out[-1] if out else None
        if last and last["way"] == b["way"] == "horizontal" and last["font"] == b["font"] and abs(last["size"] - b["size"]) <= 0.5:
            gap = b["lines"][0]["baseline"] - last["lines"][-1]["baseline"]
            shared, narrow = min(last["box"][2], b["box"][2]) - max(last["box"][0], b["box"][0]), min(x["box"][2] - x["box"][0] for x in (last, b))
            if 0 < gap <= 1.6 * max(last["leading"], b["leading"]) and narrow > 0 and shared >= 0.5 * narrow:
                lines, box = ordered(last["lines"] + b["lines"]), union([last["box"], b["box"]])
                out[-1] = last | {"lines": lines, "box": box, "leading": leading(lines, last["size"]), "align": align(lines, box, box[2] - box[0])}
                continue
        out.append(b)
    return [(n, [round(v, 6) for v in b["box"]], "\n".join(x["text"] for x in b["lines"]), len(b["lines"]), b["font"], b["size"], round(b["leading"], 6), b["align"], b["way"]) for n, b in enumerate(out)]


def test_pages_equal_a_plain_builder(spark):
    rng = random.Random(21)
    glyphs, want = [], {}
    for page in range(60):
        own, y = [], 20.0
        for block in range(rng.randrange(1, 7)):
            left, font, size = rng.choice([50.0, 50.0, 50.0, 80.0]), rng.choice(["A"] * 6 + ["B"]), rng.choice([10.0, 10.0, 10.4, 14.0])
            turn = rng.choice([0.0] * 9 + [math.pi / 2, math.pi, 0.4])
            y += rng.choice([0.0, 2.0, 30.0])
            for line in range(rng.randrange(1, 4)):
                x, n = left + rng.choice([0.0, 0.0, 12.0]), rng.randrange(0, 9)
                for k in range(n):
                    ch = rng.choice("abcdef \xa0")
                    at = (x - left) * math.cos(turn) + left, y + (x - left) * math.sin(turn)
                    box = [at[0], at[1] - 8, at[0] + 5, at[1]]
                    if rng.random() < 0.2:
                        box = [box[2], box[3], box[0], box[1]]
                    own.append((page, block, line, k, ch, *box, *at, rng.choice([size, size, size, 0.0]), rng.choice([font, font, "", "C"]), y))
                    x += rng.choice([5.0, 5.0, 5.5, 9.0])
                y += 12.0
        glyphs += own
        want[page] = plain_page(own, 400.0)
    df = tp.text_page(spark.createDataFrame(glyphs, GLYPH), spark.createDataFrame([(p, 400.0) for p in range(60)], "page long, width double"))
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.page, r.paragraph)):
        got.setdefault(r.page, []).append((r.paragraph, [round(v, 6) for v in (r.x0, r.y0, r.x1, r.y1)], r.text, r.lines, r.font, r.size, round(r.leading, 6), r.align, r.orientation))
    assert {p: v for p, v in want.items() if v} == got
    assert {"horizontal", "vertical", "reversed", "skewed"} == {v[8] for vs in want.values() for v in vs} and any(v[3] > 3 for vs in want.values() for v in vs)
