from quire.operators import sequential
from quire.operators.groups import ROWS, walk_groups


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_groups_stream_across_batches(spark):
    df = spark.range(3 * ROWS + 7).selectExpr("id % 3 AS k", "id")

    def number(group):
        for n, r in enumerate(group):
            yield r.k, r.id, n

    got = rows(walk_groups(df, "k", ["id"], number, "k long, id long, n long"))
    assert len(got) == 3 * ROWS + 7 and all(n == i // 3 for _, i, n in got)
    assert walk_groups(df.where("false"), "k", ["id"], number, "k long, id long, n long").count() == 0
    assert rows(walk_groups(spark.sql("SELECT CAST(NULL AS LONG) k, 5L id"), "k", ["id"], number, "k long, id long, n long")) == [(None, 5, 0)]


def test_paragraphs_grow_as_they_merge(spark):
    blocks = [(1, 0, 0.0, 100.0, [0.0]), (1, 1, 0.0, 40.0, [15.0]), (1, 2, 30.0, 100.0, [30.0]), (1, 3, 0.0, 100.0, [90.0]), (2, 0, 0.0, 9.0, [0.0]), (2, 1, 0.0, 9.0, [19.0]), (2, 2, 0.0, 9.0, [38.0]), (2, 3, 0.0, 9.0, [68.0])]
    df = spark.createDataFrame([(*b, 10.0, "F", "horizontal") for b in blocks], "page long, block int, x0 double, x1 double, baselines array<double>, size double, font string, orientation string")
    # the leading of merged lines is their own: 30 after gaps of 19 still joins, as 1.6 * 19 > 30
    assert rows(sequential.merged_paragraphs(df)) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 0, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0)]
    assert rows(sequential.merged_paragraphs(df.where("page = 2").replace("horizontal", "vertical"))) == [(2, 0, 0), (2, 1, 1), (2, 2, 2), (2, 3, 3)]


def test_export_lines(spark):
    pieces = [(1, 0, "low", 0.0, 10.0, 10.0), (1, 1, "top", 0.0, 50.0, 10.0), (1, 2, " right ", 40.0, 52.0, 10.0), (1, 3, "near", 20.5, 10.0, 10.0), (1, 4, "  ", 0.0, 30.0, 10.0), (1, 5, "next", 0.0, 38.0, 10.0)]
    df = spark.createDataFrame([(*p, 20.0) for p in pieces], "page long, ord int, text string, x double, y double, size double, width double")
    assert rows(sequential.export_lines(df)) == [(1, 0, 0, "top right"), (1, 0, 1, "next"), (1, 1, 2, "lownear")]


def test_suppression_is_greedy(spark):
    boxes = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 1, 1.0, 1.0, 9.0, 9.0, 0.9), (1, 2, 20.0, 0.0, 25.0, 5.0, 0.1), (1, 3, 20.0, 0.0, 25.0, 5.0, 0.2), (1, 4, 40.0, 0.0, 50.0, 10.0, 0.5), (1, 5, 46.5, 0.0, 56.5, 9.0, 0.5), (1, 6, 48.0, 0.0, 58.0, 8.0, 0.5)]
    df = spark.createDataFrame(boxes, "page long, word int, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert rows(sequential.suppressed(df)) == [(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, True), (1, 4, True), (1, 5, False), (1, 6, True)]


def test_regular_tables(spark):
    # a span below the last row doesn't count; one that leaves a gap does
    cells = [(1, 0, 0, 2, 1), (1, 0, 1, 1, 1), (1, 1, 0, 1, 1), (2, 0, 0, 1, 2), (2, 1, 0, 1, 1), (3, 0, 0, 2, 1), (4, 0, 0, 1, 1), (4, 0, 1, 1, 1), (4, 0, 2, 2, 1), (4, 1, 0, 1, 1)]
    df = spark.createDataFrame(cells, "table long, row int, ord int, row_span int, col_span int")
    assert rows(sequential.regular_tables(df)) == [(1, True), (2, False), (3, True), (4, False)]


def test_varied_selection_looks_at_all_characters(spark):
    words = ["aaaa", "abcd", "xyz-q", "dcba", "ab1", "longwords", "wordslong", "BOLD"]
    df = spark.createDataFrame([(1, k, w, w == "BOLD", False, 9.0) for k, w in enumerate(words)], "page long, ord int, word string, bold boolean, italic boolean, size double")
    left, seen, want = [(k, w) for k, w in enumerate(words) if w not in ("BOLD", "ab1")], set(), []
    while left and len(want) < 5:
        k, w = max(left, key=lambda x: (len(set(x[1]) - seen), len(x[1]), -x[0]))
        left.remove((k, w))
        seen |= set(w)
        want.append(w)
    assert [w for _, _, w in rows(sequential.varied_selection(df, 5))] == want


def test_unique_names(spark):
    names = spark.createDataFrame([(1, 0, "A"), (1, 1, "a 2"), (1, 2, "a"), (1, 3, "A")], "k long, o int, n string")
    assert sorted(r.unique for r in sequential.unique_names(names, "k", "n", "o").collect()) == ["A", "A 4", "a 2", "a 3"]
