"""Pages read as text, files of them, and the order of display, against plain versions."""

import random
import re

import duckdb
from pyspark.sql import functions as F
from quire.operators import text_export as te

RTL, AR = re.compile("[֐-ࣿיִ-﷿ﹰ-﻿]"), re.compile("[؀-޿ࡠ-ࣿﭐ-﷿ﹰ-﻿]")
PIECE = "page long, ord int, text string, x double, y double, size double, width double"


def way(text):
    counts = [sum(c.isalpha() and bool(RTL.match(c)) == side for c in text) for side in (True, False)]
    return counts, "rtl" if counts[0] else "ltr" if counts[1] else None


def reading(directions, rtl):
    """Units of a line in the order they are read: neutrals resolved, then levels undone from the lowest."""
    base, n = "rtl" if rtl else "ltr", len(directions)
    resolved = []
    for k, d in enumerate(directions):
        left = next((x for x in reversed(directions[:k]) if x), base)
        right = next((x for x in directions[k + 1 :] if x), base)
        resolved.append(d or (left if left == right else base))
    level = [1 if d == "rtl" else 2 if rtl else 0 for d in resolved]
    order = list(range(n))
    for least in (1, 2):
        k = 0
        while k < n:
            stop = k
            while stop < n and level[order[stop]] >= least:
                stop += 1
            order[k:stop] = order[k:stop][::-1]
            k = stop + 1
    return order


def plain_page(pieces):
    lines = []
    for p in pieces:
        own = next((x for x in lines if abs(x[0][4] - p[4]) <= max(1, p[5] / 2)), None)
        if own:
            own.append(p)
        else:
            lines.append([p])
    out, last = [], None
    for line in sorted(lines, key=lambda x: -x[0][4]):
        own = sorted(line, key=lambda p: p[3])
        ways = [way(p[2]) for p in own]
        if any(d == "rtl" for _, d in ways):
            own = [own[k] for k in reading([d for _, d in ways], sum(c[0] for c, _ in ways) > sum(c[1] for c, _ in ways))]
        text = ""
        for a, b in zip([None, *own], own, strict=False):
            gap = 0 if a is None else max(b[3] - a[3] - a[6], a[3] - b[3] - b[6])
            text += (" " if a is not None and gap > 0.15 * max(a[5], b[5]) else "") + b[2]
        text, y, size = " ".join(text.split()), line[0][4], max(p[5] for p in line)
        if text:
            if last is None or last[0] - y > 1.6 * max(last[1], size):
                out.append([])
            out[-1].append(text)
            last = (y, size)
    return out


def test_pages_equal_a_plain_reading(spark):
    rng = random.Random(9)
    words = ["one", "two ", " x", "12", "-", "", "שלום", "עברית", "سلام", "A1", " ", "#tag", "שa"]
    rows = []
    for page in range(60):
        for k in range(rng.randrange(1, 25)):
            rows.append((page, k, rng.choice(words), rng.randrange(400) + 0.5 * rng.randrange(2), 10.0 * rng.randrange(12) + rng.randrange(3), float(rng.choice([6, 10, 11])), float(rng.randrange(60))))
    df = spark.createDataFrame(rows, PIECE)
    text = {r.page: r.text for r in te.page_texts(df).collect()}
    marked = {r.page: r.text for r in te.page_texts(df, markdown=True).collect()}
    for page in range(60):
        want = plain_page([r for r in rows if r[0] == page])
        assert text.get(page, "") == "\n\n".join("\n".join(p) for p in want)
        assert marked.get(page, "").replace("\\", "") == "\n\n".join(" ".join(p) for p in want)


def test_text_files(spark):
    df = spark.createDataFrame([(1, 2, "third"), (1, 0, "first\n\nmore"), (1, 1, None), (2, 4, "only \U0001f600")], "doc_id long, page int, text string")
    got = {r.doc_id: (r.content, r.empty_pages, r.characters) for r in te.text_files(df).collect()}
    assert got == {1: ("﻿first\n\nmore\n\n----- 2 -----\n\n\n\n----- 3 -----\n\nthird\n", [1], 16), 2: ("﻿only \U0001f600\n", [], 7)}
    assert {r.doc_id: r.content for r in te.text_files(df, markdown=True).collect()}[1] == "first\n\nmore\n\n---\n\n\n\n---\n\nthird\n"


def plain_display(classes):
    """The algorithm for one right-to-left paragraph, rule after rule over a list."""
    t, n = list(classes), len(classes)
    strong = "R"
    for k in range(n):
        if t[k] in ("L", "R", "AL"):
            strong = t[k]
        elif t[k] == "EN" and strong == "AL":
            t[k] = "AN"
    t = ["R" if x == "AL" else x for x in t]
    for k in range(1, n - 1):
        if t[k - 1] == t[k + 1] and ((t[k] == "ES" and t[k - 1] == "EN") or (t[k] == "CS" and t[k - 1] in ("EN", "AN"))):
            t[k] = t[k - 1]
    for run in re.finditer("e+", "".join("e" if x == "ET" else "n" if x == "EN" else "." for x in t)):
        if (run.start() and t[run.start() - 1] == "EN") or (run.end() < n and t[run.end()] == "EN"):
            t[run.start() : run.end()] = ["EN"] * len(run[0])
    strong = "R"
    for k in range(n):
        if t[k] in ("L", "R"):
            strong = t[k]
        t[k] = "ON" if t[k] in ("ES", "ET", "CS") else "L" if t[k] == "EN" and strong == "L" else t[k]
    for run in re.finditer("o+", "".join("o" if x == "ON" else "." for x in t)):
        both = run.start() and run.end() < n and t[run.start() - 1] == t[run.end()] == "L"
        t[run.start() : run.end()] = ["L" if both else "R"] * len(run[0])
    order, k = list(range(n)), 0
    while k < n:
        stop = k
        while stop < n and t[stop] != "R":
            stop += 1
        order[k:stop] = order[k:stop][::-1]
        k = stop + 1
    return order[::-1]


def test_display_order_equals_the_plain_algorithm(spark):
    rng = random.Random(10)
    kinds = ["L", "R", "AL", "EN", "AN", "ES", "ET", "CS", "ON"]
    lines = [[rng.choice(kinds) for _ in range(rng.randrange(1, 14))] for _ in range(400)]
    df = spark.createDataFrame([(k, j, c) for k, line in enumerate(lines) for j, c in enumerate(line)], "line int, ord int, class string")
    got = {}
    for r in te.display_places(df, ["line"]).orderBy("line", "place").collect():
        got.setdefault(r.line, []).append(r.ord)
    assert got == {k: plain_display(line) for k, line in enumerate(lines)}


def test_classes_of_characters(spark):
    want = {"a": "L", "é": "L", "א": "R", "ב": "R", "ا": "AL", "5": "EN", "۵": "EN", "٥": "AN", "+": "ES", "-": "ES", "%": "ET", "€": "ET", ",": "CS", "\xa0": "CS", "(": "ON", " ": "ON", "ם x": "R"}
    df = spark.createDataFrame([(k,) for k in want], "u string")
    assert {r.u: r.c for r in df.select("u", te.display_class(F.col("u")).alias("c")).collect()} == want


def test_words_that_come_together_are_not_shuffled(spark, tmp_path):
    from test_scale import plan

    from quire.plans.form_queries import T8F_SQL, t8_text_files

    rows = [(p, k, f"w{k}" if k % 7 else " ", 40.0 * (k % 3), 20.0 * (-k // 6) + (2.0 if k % 2 else 0.0), 10.0 - 2 * (k % 2), 25.0) for p in range(9) for k in range(p * 5)]
    rows += [(20, k, None if k == 1 else "x", 0.0 if k < 4 else None, 0.0, 8.0, 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "page long, ord int, text string, x double, y double, size double, width double")
    want = sorted(map(tuple, te.line_texts(df).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        made = te.line_texts(df.coalesce(1).sortWithinPartitions("page", "ord"), together=True, turned=False)
        assert "hashpartitioning" not in plan(made)
        assert sorted(map(tuple, made.collect())) == want and len(want) > 20
        assert {r.page: len(r.pieces) for r in te.placed_lines(df.where("page = 20")).collect()} == {20: 5}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = ["one two\n\n\nthree\n", None, "", "שלום two עברית\nplain  words", "a\n" * 85 + "end", " \n\t"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = t8_text_files(spark, str(tmp_path))
    shuffles = [x for x in plan(made).splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 3 and not any("(page#" in x and "line#" not in x for x in shuffles)
    got = {r.doc_id: (r.md5, r.empty, r.characters) for r in made.collect()}
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id NOT IN (1, 3)")
        assert {k: v for k, v in got.items() if k != 3} == {r[0]: tuple(r[1:]) for r in db.sql(T8F_SQL).fetchall()}
    assert got[3][1:] == (0, len("עברית two שלום\nplain words"))
