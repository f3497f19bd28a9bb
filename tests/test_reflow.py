"""Text set in a box, against a plain search over break places, for mixed scripts and shrinking sizes."""

import random

from quire.operators import reflow as rf

FACE = rf.Face({" ": 0.3, "-": 0.3, "i": 0.25, "m": 0.9, "字": 1.0, "。": 1.0, "「": 1.0})


def pieces_of(text):
    """(paragraph, piece, joint before it) where a line may break before each piece but the first."""
    for n, p in enumerate(q for q in text.split("\n") if q.strip()):
        for w, word in enumerate(p.split()):
            units, at = [], 0
            while at < len(word):
                stop = at + 1
                if not rf.IDEOGRAPHIC.match(word[at]):
                    while stop < len(word) and not rf.IDEOGRAPHIC.match(word[stop]):
                        stop += 1
                units.append(word[at:stop])
                at = stop
            glued = []
            for u in units:
                if glued and (u[0] in "。、)" or glued[-1][-1] in "「("):
                    glued[-1] += u
                else:
                    glued.append(u)
            for k, u in enumerate(glued):
                yield n, u, "" if k or w == 0 else " "


def plain(text, width, size):
    """Greedy: the longest run of pieces that fits is a line."""
    lines, rest = [], list(pieces_of(text))
    while rest:
        n, line = rest[0][0], rest[0][1]
        k = 1
        while k < len(rest) and rest[k][0] == n and FACE.width(line + rest[k][2] + rest[k][1], size) <= width + 0.25:
            line += rest[k][2] + rest[k][1]
            k += 1
        lines.append((line, n))
        rest = rest[k:]
    return lines


def test_lines_equal_a_plain_search(spark):
    rng = random.Random(40)
    rows, want = [], {}
    for k in range(400):
        words = ["".join(rng.choice("aim字字「。)") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(0, 20))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\n"]) for w in words)
        width, height, size = rng.choice([30.0, 60.0, 100.0]), rng.choice([None, 30.0, 80.0]), rng.choice([8.0, 10.0, 12.0])
        rows.append((k, text, width, height, size))
        now = size
        while True:
            lines = plain(text, width, now)
            foot = (len(lines) - 1) * 14.0 + now if lines else 0.0
            over = any(FACE.width(t, now) > width + 0.25 for t, _ in lines) or (height is not None and foot > height + 0.25)
            if not over or now <= 6:
                break
            now = max(now - 0.5, 6.0)
        want[k] = (now, over, lines)
    df = spark.createDataFrame([*rows, (999, None, 10.0, 10.0, 10.0)], "block int, text string, width double, height double, size double")
    got = {r.block: (r.size, r.overflow, [(x["text"], x["paragraph"]) for x in r.lines]) for r in rf.reflowed_blocks(df, FACE, leading=14.0, least=6.0).collect()}
    assert got == want | {999: (10.0, False, [])}
    assert len({v[0] for v in want.values()}) > 6 and {v[1] for v in want.values()} == {True, False}


def test_hyphens_indents_and_spaces():
    lines = lambda text, width, **more: [x[0] for x in rf.set_text(text, width, None, 10.0, FACE, **more)[2]]
    assert lines("abcdefgh ij", 25.0) == ["abcdefgh", "ij"] and lines("abcdefgh ij", 25.0, hyphenate=True) == ["abcd-", "efgh", "ij"]
    assert lines("abc", 5.0, hyphenate=True) == ["abc"]  # no room for two characters and a hyphen
    assert lines("a\xa0b c", 12.0) == ["a\xa0b", "c"] and lines(" \n\t\n", 10.0) == []
    size, over, made = rf.set_text("aa aa aa\n\naa", 28.0, None, 10.0, FACE, indent=14.0, between=5.0)
    assert [(x[0], x[1], x[2], x[4]) for x in made] == [("aa", 0, 0.0, 14.0), ("aa aa", 0, 12.0, 0.0), ("aa", 1, 29.0, 14.0)] and not over and size == 10.0
    assert rf.break_units("字「字」ab字。") == ["字", "「字」", "ab", "字。"] and rf.break_units("ไทย") == ["ไทย"] and rf.break_units("字́a") == ["字́", "a"]
