"""Every query against its SQL; those that SQL can't express against plain Python."""

import difflib

import pytest
from compare import difference
from quire.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, db, name):
    assert difference(QUERIES[name](spark, sf), ORACLE_SQL[name], db) == ""


def test_line_diff_rebuilds_the_other_version(spark, sf):
    from quire.operators.compare import line_changes
    from quire.plans.text_queries import _versions

    left, right = (df.toPandas().set_index(["pair", "page"])["text"] for df in _versions(spark, sf))
    kinds = set()
    for key, a in left.items():
        changes = line_changes(a, right[key])
        lines = [x.rstrip() for x in a.split("\n") if x.rstrip()]
        other = [x.rstrip() for x in right[key].split("\n") if x.rstrip()]
        gone = {c[1] for c in changes if c[1] is not None}
        new = {c[2]: c[3] for c in changes if c[2] is not None}
        same = [x for k, x in enumerate(lines, 1) if k not in gone]
        assert same == [x for k, x in enumerate(other, 1) if k not in new]
        assert all(other[k - 1] == t for k, t in new.items())
        for kind, _, _, text, before, words, reason in changes:
            if kind == "changed" and reason is None:
                for side, whole in (("removed", before), ("added", text)):
                    rest = list(whole.split())
                    for w in (w for k, w in words if k == side):
                        rest.remove(w)
                    assert len(rest) == len(whole.split()) - sum(k == side for k, _ in words)
                assert len(before.split()) - sum(k == "removed" for k, _ in words) == len(text.split()) - sum(k == "added" for k, _ in words)
        kinds |= {c[0] for c in changes}
    assert {"changed", "removed"} <= kinds
    assert QUERIES["d1_line_diff"](spark, sf).count() == sum(len(line_changes(a, right[k])) for k, a in left.items())


def test_bounds_of_the_line_diff_are_reported(spark):
    from quire.operators.compare import compare_pages, line_changes, page_status, summary, word_changes

    long = "\n".join(f"line {k}" for k in range(500))
    other = "\n".join(f"other {k}" for k in range(500))
    whole = line_changes(long, other)
    assert len(whole) == 500 and {c[6] for c in whole} == {"line-matrix"} and whole[0][:3] == ("changed", 1, 1)
    assert line_changes("\n".join(["a"] * 499), "\n".join(["b"] * 499))[0][6] is None  # 500 * 500 cells
    assert word_changes("a b c", "a x c") == [("removed", "b"), ("added", "x")] and word_changes("a " * 70, "b " * 70) is None
    left = spark.createDataFrame([(1, 0, long), (1, 1, "same"), (1, 2, "x y")], "pair long, page int, text string")
    right = spark.createDataFrame([(1, 0, other), (1, 1, "same  "), (1, 3, "new\nlines")], "pair long, page int, text string")
    got = summary(compare_pages(left, right), page_status(left, right)).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 500, 1, 1, 1, 1, True, ["line-matrix"])]


def test_common_subsequence_is_longest():
    from quire.operators.compare import common_subsequence

    a, b = list("abcbdab"), list("bdcaba")
    script = common_subsequence(a, b)
    assert sum(k == "same" for k, *_ in script) == 4
    assert [k for k, *_ in common_subsequence(["x"], ["y"])] == ["removed", "added"]  # a removal comes first
    assert difflib.SequenceMatcher(None, a, b).ratio() <= 2 * 4 / 13 + 1e-9


def test_long_lines_are_compared_in_full(spark, tmp_path):
    """A last line of 1,500 words that goes, beside a new one, is over the bound of word tables."""
    import random

    from compare import oracle
    from quire.operators import compare

    text = "first\n" + " ".join(["The"] + ["word"] * 1500)
    spark.createDataFrame([(3, text), (4, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert difference(QUERIES["d2_summary"](spark, str(tmp_path)), ORACLE_SQL["d2_summary"], oracle(str(tmp_path))) == ""
    rng = random.Random(4)
    for size in (1, 3, 40, 90):
        a, b = ([rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(size + 1))] for _ in range(2))
        small, compare.SMALL = compare.SMALL, 10**9
        plain = compare.common_subsequence(a, b)
        compare.SMALL = small
        assert compare._long_subsequence(a, b) == plain


def test_split_by_size(spark, sf):
    got = QUERIES["p8_split_by_size"](spark, sf).toPandas().sort_values(["doc_id", "page"])
    texts = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")["text"]
    for doc, rows in got.groupby("doc_id"):
        sizes = [len(x.encode()) for x in texts[doc].split("\n")]
        part, used, want = 0, 0, []
        for s in sizes:
            if used and used + s > 2000:
                part, used = part + 1, 0
            used += s
            want.append(part)
        assert rows["part"].tolist() == want


def test_journal_fold(spark, sf):
    from quire.plans.record_queries import ACTIONS

    got = QUERIES["v1_journal"](spark, sf).toPandas().set_index("ord")
    events = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values("event_id")
    for _, own in events.groupby("user_id"):
        entries, cursor = [], 0
        for e, kind in zip(own["event_id"], own["event_type"], strict=True):
            action = ACTIONS.get(kind, "undo")
            if action == "append":
                entries = [*entries[:cursor], e]
                cursor = len(entries)
            else:
                cursor = max(0, cursor - 1) if action == "undo" else min(len(entries), cursor + 1)
            assert (got.loc[e, "kept"], got.loc[e, "cursor"]) == (len(entries), cursor)


def test_batch_run(spark, sf):
    got = {r["item"]: r["status"] for r in QUERIES["b3_batch_run"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("crc32(cast(source as binary)) % 97 AS batch", "doc_id", "octet_length(text) AS bytes", "text").toPandas()
    for _, own in docs.sort_values("doc_id").groupby("batch"):
        n = used = 0
        for r in own.itertuples():
            if r.bytes <= 200_000:
                n, used = n + 1, used + r.bytes
            fits = r.bytes <= 200_000 and n <= 40 and used <= 200_000
            assert got[r.doc_id] == ("done" if fits else "skipped")
    assert len(got) == len(docs)


def test_a_failing_item_stops_no_other(spark):
    from quire.operators import forms

    items = spark.createDataFrame([(1, k, 10, "x" * k) for k in range(5)], "batch long, item long, bytes long, text string")
    got = {r["item"]: (r["status"], r["note"]) for r in forms.batch_run(items, lambda t: 6 // len(t), 4, 1000).collect()}
    assert got == {0: ("failed", "ZeroDivisionError"), 1: ("done", "6"), 2: ("done", "3"), 3: ("done", "2"), 4: ("skipped", "over a bound")}


def test_reflow_columns_tables_and_boxes_equal_plain_ones(spark, sf):
    """Queries that walk pages, against the same rules over pandas rows."""
    from quire.plans.model_queries import _boxes

    boxes = _boxes(spark, sf).toPandas().sort_values(["page", "n"])
    got = {(r.page, r.block): r.paragraph for r in QUERIES["t3_paragraphs"](spark, sf).collect()}
    kept = {(r.page, r.word): r.kept for r in QUERIES["i5_suppressed"](spark, sf).collect()}
    regular = {r["table"]: r.regular for r in QUERIES["u5b_regular_tables"](spark, sf).collect()}
    for page, own in boxes.groupby("page"):
        number, last = -1, None
        for b in own.itertuples():
            lines = [b.y0, b.y0 + 4]
            level = not b.text.endswith("7")
            if last and level and last["level"] and b.font == last["font"] and abs(b.size - last["size"]) <= 0.5:
                gaps = sorted(y - x for x, y in zip(last["lines"], last["lines"][1:]))  # noqa: B905
                lead = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2
                gap, shared, narrow = lines[0] - last["lines"][-1], min(b.x1, last["x1"]) - max(b.x0, last["x0"]), min(b.x1 - b.x0, last["x1"] - last["x0"])
                joins = 0 < gap <= 1.6 * max(lead, 4.0) and shared >= narrow / 2
            else:
                joins = False
            if joins:
                last = last | {"x0": min(last["x0"], b.x0), "x1": max(last["x1"], b.x1), "lines": sorted(last["lines"] + lines)}
            else:
                number, last = number + 1, {"x0": b.x0, "x1": b.x1, "lines": lines, "font": b.font, "size": b.size, "level": level}
            assert got[page, b.n] == number
        words = sorted(((b.x0, b.y0 % 20, b.x1, b.y0 % 20 + 10, b.size, b.n) for b in own.itertuples()), key=lambda w: (-(w[2] - w[0]) * (w[3] - w[1]), -w[4], w[5]))
        stay = []
        for w in words:
            area = lambda k: (k[2] - k[0]) * (k[3] - k[1])
            cross = [(min(w[2], k[2]) - max(w[0], k[0]), min(w[3], k[3]) - max(w[1], k[1]), k) for k in stay]
            over = any(a > 0 and d > 0 and a * d > 0.3 * min(area(w), area(k)) for a, d, k in cross)
            assert kept[page, w[5]] == (not over)
            stay += [] if over else [w]
        rows = {}
        for b in own.itertuples():
            rows[b.n // 2] = rows.get(b.n // 2, 0) + (2 if b.x0 > 45 else 1)
        assert regular[page] == (len(set(rows.values())) == 1)


def test_extensions_run(spark, sf):
    from quire.streaming import events

    batch = events.windowed_counts(spark.read.parquet(f"{sf}/events.parquet")).collect()
    streamed = events.run_windowed_counts(spark, sf)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch))
