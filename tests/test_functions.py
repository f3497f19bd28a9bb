from itertools import groupby

import pytest
from pyspark.sql import functions as F
from quire.functions import dates, numbers, text
from quire.functions.expressions import FormError, expression
from quire.operators import forms, graph, journal, pages, search


def values(spark, rows, column, name="x", kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"k int, {name} {kind}").orderBy("k").select(column).collect()]


def test_search_is_non_overlapping_and_counts_code_points(spark):
    rows = [(1, 0, "abc needle needle"), (1, 2, "NEEDLE"), (2, 0, "😀😀aaaa"), (3, 0, ""), (4, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, text string")
    got = sorted((r.doc_id, r.page, r.start, r.length) for r in search.search(df, "needle").collect())
    assert got == [(1, 0, 4, 6), (1, 0, 11, 6), (1, 2, 0, 6)]
    assert [r.start for r in search.search(df, "aa").orderBy("start").collect()] == [2, 4]
    assert search.search(df, "").count() == 0


def test_dotted_and_dotless_i(spark):
    found = lambda needle, x: values(spark, [x], F.regexp_count("x", F.lit(text.needle_pattern(needle))))[0]
    assert found("istanbul", "İSTANBUL") == 1 and found("I", "ı") == 1 and found("I", "i") == 1
    assert found("i", "ı") == 0 and found("ı", "i") == 0 and found("σας", "ΣΑΣ") == 1


def test_fold_and_words(spark):
    assert values(spark, ["İſΣΑΣ"], text.fold(F.col("x"))) == ["isσασ"]
    assert values(spark, ["The cat's 2nd—mat", ""], text.words(F.col("x"))) == [["the", "cat", "s", "2nd", "mat"], []]


def test_replacement_guard(spark):
    assert values(spark, ["plain", "soft­hyphen", "‮bidi"], text.is_forbidden(F.col("x"))) == [False, True, True]


def test_form_numbers(spark):
    rows = ["1.234,56", "1,234.56", "12,5", "1.234.567", "7 kg", "-3", "none", "", None, "1'000", ".5", "-,25", "0.125", "1.234"]
    assert values(spark, rows, numbers.form_number(F.col("x"))) == [1234.56, 1234.56, 12.5, 1234567.0, 7.0, -3.0, None, None, None, 1000.0, 0.5, -0.25, 0.125, 1.234]
    styled = lambda k, x: values(spark, [x], numbers.form_number(F.col("x"), F.lit(k)))[0]
    assert [styled(2, x) for x in ("1.234", "1.234,5", "1235.56", "0.125")] == [1234.0, 1234.5, 1235.56, 0.125]
    assert [styled(0, "1,234"), styled(1, "1,234"), styled(3, "1,5"), styled(4, "1'234.5")] == [1234.0, 1.234, 1.5, 1234.5]


def test_sizes_and_percentages(spark):
    rows = [0, 900, 1023, 1024, 1100, 1536, 1048524, 1048575, 5557452, -1, None]
    want = ["0 B", "900 B", "1023 B", "1.0 KB", "1.1 KB", "1.5 KB", "1,023.9 KB", "1.0 MB", "5.3 MB", "—", "—"]
    assert values(spark, rows, numbers.size_text(F.col("x")), kind="long") == want
    assert values(spark, [1.4, 0.0037], numbers.percent_text(F.col("x"), 2), kind="double") == ["140.00%", "0.37%"]


def test_markdown_escapes(spark):
    rows = ["a*b_c`d", "~~x~~ [l](u) <b> &amp; & b", "# head", " # no", "- item", "12. item", "12) item", "1234567890. no", "7.", "a > b ] c", "7.5 is a number"]
    want = [r"a\*b\_c\`d", r"\~\~x\~\~ \[l](u) \<b> \&amp; & b", r"\# head", " # no", r"\- item", r"12\. item", r"12\) item", "1234567890. no", r"7\.", "a > b ] c", "7.5 is a number"]
    assert values(spark, rows, text.markdown_escape(F.col("x"))) == want


def test_file_name_suffixes(spark):
    assert values(spark, ["a/b: c\x7f", " .. ", "x" * 70], text.safe_suffix(F.col("x"))) == ["-a b c", "", "-" + "x" * 60]


def test_cell_numbers_and_formulas(spark):
    rows = ["1.234", "1,234.5", "1234.5", "007", "1.234.567", "12.34,5", "-5", "1234567890123456", "x"]
    assert values(spark, rows, numbers.cell_number(F.col("x"))) == [None, 1234.5, 1234.5, None, 1234567.0, None, -5.0, None, None]
    assert values(spark, ["=1+1", "-5", "@x", "+1"], numbers.is_formula(F.col("x"))) == [True, False, True, True]
    assert values(spark, ["=A", 'say "x"', "a,b", "plain"], numbers.csv_field(F.col("x"))) == ["'=A", '"say ""x"""', '"a,b"', "plain"]


def test_labels(spark):
    n = [1, 4, 9, 26, 27, 53, 1994]
    assert values(spark, n, numbers.roman(F.col("x")), kind="int") == ["I", "IV", "IX", "XXVI", "XXVII", "LIII", "MCMXCIV"]
    assert values(spark, [1, 26, 27, 53], numbers.letters(F.col("x")), kind="int") == ["A", "Z", "AA", "AAA"]
    assert values(spark, [1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 0, None], numbers.column_letters(F.col("x")), kind="int") == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA", "ZZZZ", "AAAAA", None, None]
    assert values(spark, [5, 12345], numbers.padded(F.col("x"), 3), kind="int") == ["005", "12345"]


def test_pdf_dates(spark):
    rows = ["D:20240229120000Z", "D:20230229", "D:2024", "D:20240101000000+02'30'", "20240101", "x", None, " d:20240101 ", "D:20240101x", "D:0000", "D:20240101000000-0530", "D:20240101000000Z00'00'", "D:20240101000000+2400", "D:202413"]
    got = values(spark, rows, dates.pdf_date_text(dates.pdf_date(F.col("x"))))
    assert got == ["D:20240229120000Z", None, "D:20240101000000Z", "D:20231231213000Z", None, None, None, "D:20240101000000Z", None, None, "D:20240101053000Z", "D:20240101000000Z", None, None]
    assert values(spark, ["D:1970", "1970-01-01T00:01:00Z", "never", None], dates.review_seconds(F.col("x"))) == [0, 60, 0, 0]
    assert values(spark, ["31/02/1999", "1.2.70", "1.2.69", "13/13/2000"], dates.display_to_iso(F.col("x"))) == ["1999-02-31", "1970-02-01", "2069-02-01", None]


def test_expressions(spark):
    fields = {"a": F.col("x"), "b.c": F.col("x") * 2}
    cases = {"a + b.c * 2": 25.0, "-(a)": -5.0, "a / 0": 0.0, "max(a, 7) - min(a, 7)": 2.0, "unknown + 1": 1.0, "(a - 1) / 2": 2.0, "8 / 4 / 2": 1.0}
    for e, want in cases.items():
        assert values(spark, [5.0], expression(e, fields), kind="double") == [want], e
    named = {"from": F.col("x"), "class": F.col("x") + 1, "f.1": F.col("x") + 2}
    assert values(spark, [5.0], expression("from + class * f.1", named), kind="double") == [47.0]
    assert values(spark, [5.0], expression("2 * -a - -1", fields), kind="double") == [-9.0]
    for bad in ("a +", "a ** 2", "f(a)", "a; b", "", "max(a)", "__import__('os')", "1_000", "0x10", "1e3", ".5", "1.", "1.2.3", "min(a,b,)", "a // 2", "(a", "a b", "+a", "é"):
        with pytest.raises(FormError):
            expression(bad, fields)


def test_ranges(spark):
    df = spark.createDataFrame([(1, "1-3, 5", 9), (2, "-2;8–", 9), (3, "4", 9)], "k int, expr string, pages int")
    got = sorted((r.k, r.page) for r in pages.parse_ranges(df, ["k"]).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 5), (2, 1), (2, 2), (2, 8), (2, 9), (3, 4)]
    for bad in ("3-1", "0", "10", "x", "2,2", "5,3", ""):
        with pytest.raises(Exception, match="page"):
            pages.parse_ranges(spark.createDataFrame([(1, bad, 9)], "k int, expr string, pages int"), ["k"]).collect()


def test_graphs_with_cycles(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("o", "gone")], "node string, parent string")
    assert sorted(map(tuple, graph.roots(edges, rounds=6).collect())) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2)]
    roles = spark.createDataFrame([("A", "B"), ("B", "P"), ("X", "Y"), ("Y", "X")], "role string, target string")
    assert sorted(map(tuple, graph.resolved_roles(roles, rounds=5).collect()), key=str) == [("A", "P"), ("B", "P"), ("X", None), ("Y", None)]


def test_deep_trees_and_long_paths(spark):
    from quire.operators import model

    deep = [("k0", None, 0, True)] + [(f"k{k}", f"k{k - 1}", k, k % 10 != 0) for k in range(1, 100)] + [("x", "y", 0, True), ("y", "x", 0, True)]
    nodes = spark.createDataFrame(deep, "key string, parent string, ord long, open boolean")
    got = {r.key: (r.depth, r.path) for r in graph.preorder(nodes).collect()}
    assert len(got) == 100 and got["k99"] == (99, "/".join(f"{k:012d}" for k in range(100)))
    long = spark.createDataFrame([("a", None, 9999999999999), ("b", None, 10000000000000), ("c", "b", 7), ("d", "lost", 1), ("e", "d", 1)], "key string, parent string, ord long")
    paths = {r.key: r.path for r in graph.preorder(long).collect()}
    assert paths == {"a": "09999999999999", "b": "10000000000000", "c": "10000000000000/00000000000007"}  # 13 and 14 digits, none cut
    counts = {r.key: (r.total, r.visible, r["count"]) for r in model.outline_counts(nodes.where("key like 'k%'")).collect()}
    for k in range(100):
        shown = 0
        for j in range(k + 1, 100):
            shown += 1
            if j % 10 == 0:
                break
        assert counts[f"k{k}"] == (99 - k, shown, shown if k == 0 or k % 10 else -shown)
    with pytest.raises(Exception, match="circle|overflow"):
        model.outline_counts(nodes.where("key in ('x', 'y')"), rounds=3).collect()


def test_reachable_over_many_steps(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(5, 300), (300, 7), (400, 401)], "src long, dst long")
    got = {r.node: r.distance for r in graph.reachable(spark.createDataFrame([(0,)], "node long"), edges).collect()}
    assert got == {k: k for k in range(41)} | {300: 6}
    near = graph.reachable(spark.createDataFrame([(0,), (400,)], "node long"), edges, most=2)
    assert sorted(map(tuple, near.collect())) == [(0, 0), (1, 1), (2, 2), (400, 0), (401, 1)]


def test_comment_threads(spark):
    rows = [("a", None, None, 1, None, None), ("b", "a", "R", 9, None, None), ("c", "b", "R", 3, None, None), ("g", "a", "Group", 2, None, None), ("r", "a", "R", 4, "Accepted", None), ("s", "r", "R", 6, "Rejected", "Review"), ("m", "a", "R", 5, "Marked", "Marked"), ("o", "gone", "R", 1, None, None), ("x", "y", "R", 1, None, None), ("y", "x", "R", 1, None, None)]
    df = spark.createDataFrame([(*r, r[3], r[0].upper()) for r in rows], "id string, parent string, reply_type string, ts int, state string, state_model string, ord int, author string")
    assert [tuple(r) for r in graph.threads(df).orderBy("root", "place").collect()] == [("a", "c", 2, 0), ("a", "b", 1, 1)]
    assert [tuple(r) for r in graph.thread_states(df).collect()] == [("a", 5, "Rejected", "S", 6, True)]


def test_pages_below(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "key string, parent string")
    pages_of = spark.createDataFrame([("c", 3), ("c", 1), ("b", 3), ("d", 7)], "key string, page int")
    assert {r.key: r.pages for r in graph.pages_below(nodes, pages_of).collect()} == {"a": [1, 3, 7], "b": [1, 3], "c": [1, 3], "d": [7]}


def test_audit_of_many_short_needles(spark):
    from quire.operators import rules

    texts = ["alpha beta w17 gamma w1700", "xw3x w3 w3", "the quick brown fox jumps over", "w", "", None, "aXa aXaXa", "quick  brown fox jumps"]
    needles = [f"w{k}" for k in range(1500)] + ["w", "é", "quick brown fox jumps", "brown fox", "aXa", " ", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ns = spark.createDataFrame(list(enumerate(needles)), "item_id long, text string")
    want = {(d, i): t.count(n) for d, t in enumerate(texts) if t for i, n in enumerate(needles) if n.strip() and t.count(n)}
    for few in (20_000, 10):
        assert {(r.doc_id, r.item_id): r.hits for r in rules.audit(df, ns, few).collect()} == want
    assert rules.audit(df, ns.where("false")).count() == 0


def test_masked_spans_may_overlap(spark):
    from quire.operators import rules

    df = spark.createDataFrame([(1, "abcdefghij"), (2, "xyz"), (3, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 2, 3), (1, 3, 4), (1, 9, 5), (2, 0, 1)], "doc_id long, start int, length int")
    got = {r.doc_id: r.text for r in rules.masked(df, spans).collect()}
    assert got == {1: "ab█████hi█", 2: "█yz", 3: None}


def test_structure_rules(spark):
    from quire.operators import rules

    rows = [("l", None, "L"), ("c", "l", "Caption"), ("i", "l", "LI"), ("b", "i", "LBody"), ("j", "l", "LI"), ("t", None, "Table"), ("p", "t", "P"), ("h", "t", "THead"), ("d", "h", "TD"), ("k", "t", "Caption")]
    nodes = spark.createDataFrame([(1, k, p, r) for k, p, r in rows], "doc_id long, key string, parent string, role string")
    got = sorted((r.reason, r.key) for r in rules.nesting_rules(nodes).collect())
    assert got == [("cell-outside-row", "d"), ("list-child", "c"), ("no-body", "j"), ("part-child", "d"), ("table-child", "p")]
    mapping = spark.createDataFrame([(1, "P", "H1"), (1, "A", "B"), (1, "B", "P"), (1, "X", "Y"), (1, "Y", "X"), (2, "A", "Z")], "doc_id long, role string, target string")
    used = spark.createDataFrame([(1, "A"), (1, "Q"), (2, "B"), (2, "P"), (2, "")], "doc_id long, role string")
    found = sorted((r.doc_id, r.reason, r.key) for r in rules.role_map_rule(mapping, used, ["P", "H1"]).collect())
    assert found == [(1, "remapped", "P"), (1, "unmapped", "Q"), (1, "unresolved", "X"), (1, "unresolved", "Y"), (2, "unmapped", "B"), (2, "unresolved", "A")]


def test_measures(spark):
    from quire.operators import geometry

    shapes = {"tie": [(0, 0), (4, 4), (4, 0), (0, 4)], "box": [(0, 0), (0, 0), (4, 0), (4, 3), (0, 3), (0, 0)], "two": [(1, 1), (4, 5)], "touch": [(0, 0), (4, 0), (2, 0), (2, 3)], "tri": [(0, 0), (3, 0), (0, 4)]}
    rows = [(k, i, float(x), float(y)) for k, points in shapes.items() for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "k string, ord int, x double, y double")
    got = {r.k: r for r in geometry.chains(df, ["k"]).collect()}
    assert {k: r.area == r.area for k, r in got.items()} == {"tie": False, "box": True, "two": True, "touch": False, "tri": True}
    assert (got["two"].area, got["two"].length, got["two"].perimeter) == (12, 10, 14) and got["two"].bearing == pytest.approx(53.1301, abs=1e-3)
    assert (got["box"].area, got["tri"].area, got["tri"].perimeter, got["tie"].bearing) == (12, 6, 12, 45)
    line = {r.k: r for r in geometry.chains(df, ["k"], mode="perimeter").collect()}
    assert (line["tri"].length, line["tri"].perimeter, line["tri"].area) == (8, 8, 0)
    with pytest.raises(Exception, match="two points"):
        geometry.chains(df, ["k"], mode="distance").collect()
    with pytest.raises(Exception, match="more than 128"):
        geometry.crosses_itself(spark.range(129).selectExpr("1 AS k", "id AS ord", "id AS x", "id * id AS y"), ["k"]).collect()


def test_overlaps_take_corners_in_any_order(spark):
    from quire.operators import geometry

    rects = spark.createDataFrame([(1, "a", 0, 0, 5, 5, "Text"), (1, "b", 9, 9, 6, 6, "Text"), (1, "c", 5, 5, 6, 6, "Text"), (1, "d", 0, 0, 5, 5, "Redact"), (2, "e", 0, 0, 5, 5, "Text")], "k int, id string, x0 int, y0 int, x1 int, y1 int, kind string")
    marks = spark.createDataFrame([(1, 5, 5, 3, 3), (1, 7, 7, 8, 8)], "k int, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r.id for r in geometry.overlaps(rects, marks, ["k"]).collect()) == ["a", "b"]


def test_alignment_and_style(spark):
    from quire.operators import layout

    lines = [("one", 1, 40.0, 60.0, 40.0, 60.0), ("off", 1, 0.0, 20.0, 0.0, 20.0), ("mid", 1, 10.0, 30.0, 5.0, 35.0), ("mid", 2, 5.0, 35.0, 5.0, 35.0), ("just", 1, 0.0, 50.0, 0.0, 50.0), ("just", 2, 0.0, 20.0, 0.0, 50.0)]
    df = spark.createDataFrame([(*x, 100.0) for x in lines], "k string, ord int, x0 double, x1 double, b0 double, b1 double, width double")
    assert {r.k: r["align"] for r in layout.line_alignment(df, ["k"]).collect()} == {"one": "center", "off": "left", "mid": "center", "just": "justify"}
    glyphs = spark.createDataFrame([(1, k, "x", 10.0, f) for k, f in enumerate("ABBA")], "k int, ord int, ch string, size double, font string")
    assert layout.block_style(glyphs, ["k"]).first()["font"] == "B"  # both have two, B came to two first


def test_pages(spark):
    docs = spark.createDataFrame([(1, 100), (2, 3), (3, 6), (4, 0)], "doc_id int, pages int")
    picked = lambda n: {d: sorted(r.page for r in rows) for d, rows in groupby(pages.sampled(docs, n).orderBy("doc_id").collect(), key=lambda r: r.doc_id)}
    assert picked(5) == {1: [0, 20, 40, 59, 99], 2: [0, 1, 2], 3: [0, 1, 2, 3, 5]} and picked(2) == {1: [0, 99], 2: [0, 2], 3: [0, 5]}
    rows = spark.createDataFrame([(1, p, 5) for p in range(5)], "doc_id int, page int, pages int")
    plan = lambda *a: sorted((r.part, r.name, r.first, r.last) for r in pages.split_plan(rows, *a).collect())
    assert plan("every", 2) == [(0, "part-1", 0, 1), (1, "part-2", 2, 3), (2, "part-3", 4, 4)] and len(plan("single")) == 5
    titles = spark.createDataFrame([(1, 1, 3, "B/x"), (1, 0, 3, "A: y"), (1, 2, 4, "..")], "doc_id int, ord int, page int, title string")
    assert plan("bookmarks", 0, titles) == [(0, "part-1", 0, 2), (1, "part-2-A y", 3, 3), (2, "part-3", 4, 4)]
    beyond = titles.union(spark.createDataFrame([(1, 3, 5, "far")], titles.schema))
    assert plan("bookmarks", 0, beyond) == [] and [tuple(r) for r in pages.refused_bookmarks(rows, beyond).collect()] == [(1, 3, 5, "far")]
    written = spark.createDataFrame([(1, "1, 2 - 3; 4-")], "doc_id int, expr string")
    assert plan("ranges", 0, None, written) == [(0, "part-1", 0, 0), (1, "part-2", 1, 2), (2, "part-3", 3, 4)]
    assert plan("booklet") == [(0, "part-1", 0, 3), (1, "part-2", 4, 4)] and plan("booklet", 2) == plan("every", 2)
    sized = rows.withColumn("bytes", F.lit(40))
    assert sorted((r.part, r.first, r.last) for r in pages.split_plan(sized, "size", 100).collect()) == [(0, 0, 1), (1, 2, 3), (2, 4, 4)]
    for bad, why in (("1-9", "bad page range"), ("3, 1-2", "repeat or descend")):
        with pytest.raises(Exception, match=why):
            plan("ranges", 0, None, written.withColumn("expr", F.lit(bad)))
    with pytest.raises(Exception, match="not there"):
        pages.replaced_pages(rows, spark.createDataFrame([(1, 9, 0)], "doc_id int, page int, source_page int")).collect()


def test_cleanup_is_refused_without_a_whole_inventory(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert [r.key for r in journal.cleanup(keys, keys.where("key = 'a'")).collect()] == ["b"]
    with pytest.raises(ValueError, match="incomplete"):
        journal.cleanup(keys, complete=False)


def test_form_json(spark):
    kept = spark.createDataFrame([(1, '{"a": "{x}", "b": [1, "p", "q"], "c": {"d": 1}, "t": true, "n": null, "f": 1.5}')], "k int, json string")
    assert sorted((r.name, r.value) for r in forms.form_json(kept).collect()) == [("a", "{x}"), ("b", "p, q"), ("f", "1.5"), ("t", "true")]
    df = spark.createDataFrame([(1, '{"fields": [{"name": "a", "value": "x"}, {"value": "y"}, {"name": "n", "value": 3}]}'), (2, '{"b": "z", "c": null}'), (3, "nonsense")], "k int, json string")
    assert sorted((r.k, r.name, r.value) for r in forms.form_json(df).collect()) == [(1, "a", "x"), (1, "n", "3"), (2, "b", "z")]


def test_rule_sets():
    assert forms.checked_rules({"version": 1, "steps": [{"kind": "stamp", "params": {}}]})
    for bad in ({"version": 2, "steps": [{"kind": "stamp"}]}, {"version": 1, "steps": []}, {"version": 1, "steps": [{"kind": "boil"}]}):
        with pytest.raises(FormError):
            forms.checked_rules(bad)


def test_readers(spark, tmp_path):
    from quire.sources import files

    (tmp_path / "a.txt").write_bytes("çığ".encode("cp1254"))
    (tmp_path / "b.txt").write_bytes("çığ".encode())
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe" + "çığ".encode("utf-16-le"))
    got = sorted((r.path.rpartition("/")[2], r.encoding, r.text) for r in files.read_texts(spark, str(tmp_path)).collect())
    assert got == [("a.txt", "windows-1254", "çığ"), ("b.txt", "utf-8", "çığ"), ("c.txt", "utf-16le", "çığ")]
    assert files.sniff_delimiter('a;b;"c,d"\n1;2;3\n') == ";" and files.sniff_delimiter("a,b\nc,d") == "," and files.sniff_delimiter("plain") == ","
    rows = files.csv_rows('a,"b ""q""\nline",c\r\nx,y"z,\rlast', ",")
    assert rows == [["a", 'b "q"\nline', "c"], ["x", 'y"z', ""], ["last"]]


def test_no_break_spaces(spark):
    """White space is what scripts trim, and what parts words is a fixed set, the no-break space among them."""
    from quire.functions import text
    from quire.operators import compare, layout

    glyphs = spark.createDataFrame([(1, k, c, 10.0 * k, 10.0 * k + 10, 10.0, "A" if c == "\xa0" else "B") for k, c in enumerate("a\xa0\xa0\xa0b\u2003c")], "k int, ord int, ch string, x0 double, x1 double, size double, font string")
    assert [(r.ch, r.word) for r in layout.word_runs(glyphs, ["k"]).orderBy("ord").collect()] == [("a", 0), ("b", 1), ("\u2003", 1), ("c", 1)]
    assert layout.block_style(glyphs, ["k"]).first()["font"] == "B"
    left = spark.createDataFrame([(1, 0, "a\xa0\nb"), (1, 1, "a\x1c"), (1, 2, "x\u2028 \ufeff\n\xa0\n")], "pair long, page int, text string")
    right = spark.createDataFrame([(1, 0, "a\nb\u3000"), (1, 1, "a"), (1, 2, "x")], left.schema)
    status = {r.page: r.status for r in compare.page_status(left, right).collect()}
    assert status == {0: "identical", 1: "changed", 2: "identical"}
    for page in range(3):
        texts = [df.where(F.col("page") == page).first()["text"] for df in (left, right)]
        assert bool(compare.line_changes(*texts)) == (status[page] == "changed")
    assert values(spark, ["1.\xa0x", "1.x", "1. x"], text.markdown_escape(F.col("x"))) == ["1\\.\xa0x", "1.x", "1\\. x"]


def test_csv_numbers_and_bounds(spark):
    from quire.operators import exchange

    cells = ["h", "1,5", "1.5", "1,000,5", "0x1F", "0b12", " ", "", "-.5e3", "Infinity", "1_0", "\xa07\xa0"]
    df = spark.createDataFrame([(1, "\n".join(f'"{c}"' for c in cells))], "k int, t string")
    got = {r.row: r.numeric for r in exchange.csv_tables(df, "k", "t").collect()}
    assert [got[k] for k in range(len(cells))] == [False, True, True, False, True, False, True, False, True, False, False, True]
    assert exchange.csv_tables(df, "k", "t", most_rows=3).count() == 3 and [tuple(r) for r in exchange.csv_notes(df, "k", "t", most_rows=3).collect()] == [(1, 12, 3)]
    with pytest.raises(Exception, match="too large"):
        exchange.csv_tables(spark.createDataFrame([(1, "," * 1000)], df.schema), "k", "t").collect()


def test_date_pictures(spark):
    from quire.functions import dates

    read = lambda picture, *given: values(spark, list(given), dates.picture_to_iso(F.col("x"), picture))
    assert read("DD/MM/YYYY", "31/02/2024", " 01/12/0001 ", "1/02/2024", "01/13/2024", "00/12/2024", "01/12/0000", "x", None) == ["2024-02-31", "0001-12-01", None, None, None, None, None, None]
    assert read("D.M.YY", "1.2.69", "11.12.70", "1.2.1970") == ["2069-02-01", "1970-12-11", None]
    assert read("YYYY(MM)[DD]+", "2024(01)[05]+", "2024(01)[05]") == ["2024-01-05", None] and read("MM/YYYY", "01/2024") == [None]
    show = lambda picture, *given: values(spark, list(given), dates.iso_to_picture(F.col("x"), picture))
    assert show("D.M.YY / DD MM YYYY", "2024-01-05", "2024-1-5", None) == ["5.1.24 / 05 01 2024", None, None]


def test_error_rates(spark):
    from quire.operators import compare

    rows = [("a", "one two three", "one too three"), ("a", "four", ""), ("b", "", "x"), ("c", "x\xa0y", "x y")]
    got = {r.k: (r.cer, r.wer) for r in compare.error_rates(spark.createDataFrame(rows, "k string, want string, got string"), ["k"], "want", "got").collect()}
    assert got["a"] == (5 / 17, 2 / 4) and got["b"] == (None, None) and got["c"] == (1 / 3, 0.0)


def test_overlaps_of_every_size_equal_brute_force(spark):
    import random

    from quire.operators import geometry

    rng = random.Random(50)

    def boxes(n, key):
        for _ in range(n):
            x, y, w, h = rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice([0.0, 1e-5, 0.5, 3.0, 40.0, 900.0]), rng.choice([0.0, 0.5, 3.0, 40.0, 900.0])
            yield (key, *rng.choice([(x, y, x + w, y + h), (x + w, y + h, x, y)]))

    rects, marks = ([b for key in range(3) for b in boxes(n, key)] for n in (250, 60))
    marks += [(7, 0.0, 0.0, 1e6, 1e6), (0, 16.0, 16.0, 32.0, 32.0)]
    rects += [(7, 5.0, 5.0, 5.0, 5.0), (0, 32.0, 16.0, 40.0, 20.0), (0, 8.0, 16.0, 16.0, 20.0), (0, 31.0, 31.0, 64.0, 64.0)]
    schema = "k int, x0 double, y0 double, x1 double, y1 double"
    got = sorted(map(tuple, geometry.overlaps(spark.createDataFrame(rects, schema), spark.createDataFrame(marks, schema), ["k"]).collect()))
    order = lambda b: (min(b[1], b[3]), min(b[2], b[4]), max(b[1], b[3]), max(b[2], b[4]))
    meets = lambda a, b: a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]
    want = sorted(r for r in rects if any(m[0] == r[0] and meets(order(r), order(m)) for m in marks))
    assert got == want and 50 < len(want) < len(rects)
