from quire.operators import reading


def places(spark, directions, rtl):
    df = spark.createDataFrame([(1, k, d, rtl) for k, d in enumerate(directions)], "line int, ord int, direction string, rtl_base boolean")
    return [r.ord for r in reading.reading_places(df, ["line"]).orderBy("place").collect()]


def test_reading_order(spark):
    r, l, n = "rtl", "ltr", None  # noqa: E741
    assert places(spark, [l, n, l], False) == [0, 1, 2]
    assert places(spark, [r, n, r], True) == [2, 1, 0]
    assert places(spark, [r, l, n, l, r], True) == [4, 1, 2, 3, 0]  # a name of two words keeps its order
    assert places(spark, [l, r, n, r, l], False) == [0, 3, 2, 1, 4]
    assert places(spark, [l, n, r], False) == [0, 1, 2] and places(spark, [n, n], True) == [1, 0]


def test_block_units_and_tokens(spark):
    df = spark.createDataFrame([("a hy-\nphen and Al-\nAndalus\nend",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(reading.block_units(df.t)).collect()] == ["a hyphen and Al- Andalus end", "", None]
    df = spark.createDataFrame([("  ﬁRST \n  Ｘ ",), (None,)], "t string")
    assert [r[0] for r in df.select(reading.find_tokens(df.t)).collect()] == ["first x", None]


def test_reflow_is_greedy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in reading.reflowed(docs, 60).collect():
        assert " ".join(r.lines).split() == texts[r.doc_id].split()
        for a, b in zip(r.lines, [*r.lines[1:], None], strict=True):
            assert len(a) <= 60 or " " not in a
            assert b is None or len(a) + 1 + len(b.split(" ")[0]) > 60


def test_text_columns(spark):
    rows = [(1, 0, 10.0, "a"), (1, 0, 50.0, "b"), (1, 1, 12.0, "c"), (1, 1, 13.0, "d"), (1, 2, 47.0, "e")]
    df = spark.createDataFrame(rows, "page long, row int, x double, text string")
    assert {(r.row, r.text): r.column for r in reading.text_columns(df).collect()} == {(0, "a"): 0, (0, "b"): 1, (1, "c"): 0, (1, "d"): 1, (2, "e"): 1}


def test_stream_tables(spark):
    rows = [(1, r, r * 20.0, r * 20.0 + 12, x, x + w, f"{r}{c}") for r in (0, 1, 2) for c, (x, w) in enumerate(((0.0, 20.0), (50.0, 30.0)))]
    rows += [(1, 3, 60.0, 72.0, 0.0, 90.0, "a line of prose"), (1, 9, 300.0, 312.0, 0.0, 20.0, "x"), (1, 9, 300.0, 312.0, 50.0, 70.0, "y")]
    df = spark.createDataFrame(rows, "page long, row int, top double, bottom double, x0 double, x1 double, text string")
    got = sorted(map(tuple, reading.stream_tables(df).collect()))
    assert got == [(1, 0, r, c, f"{r}{c}") for r in (0, 1, 2) for c in (0, 1)]


def test_structure_edits(spark):
    nodes = spark.createDataFrame([("a", None, "Document"), ("b", "a", "Sect"), ("c", "b", "P"), ("d", "b", "P"), ("e", "a", "Div"), ("f", "e", "P")], "key string, parent string, role string")
    edits = spark.createDataFrame([("b", "unwrap", None), ("d", "role", "H1"), ("f", "move", "a"), ("e", "drop", None)], "key string, action string, value string")
    assert sorted(map(tuple, reading.edited(nodes, edits).collect())) == [("a", None, "Document"), ("c", "a", "P"), ("d", "a", "H1"), ("f", "a", "P")]


def test_prose_in_columns_is_no_table(spark):
    kind = "page long, row int, top double, bottom double, x0 double, x1 double, text string, block int"

    def found(rows):
        return reading.stream_tables(spark.createDataFrame(rows, kind)).count()

    line = "some words of running text"
    page = lambda block, text=line, width=100.0: [(1, r, r * 20.0, r * 20.0 + 12, x, x + width, text, block(r, c)) for r in range(4) for c, x in enumerate((0.0, 130.0))]
    assert found(page(lambda r, c: c)) == 0  # each column a block of its own
    assert found(page(lambda r, c: 0)) == 0  # one block, but its lines fill their columns
    assert found(page(lambda r, c: c, "short cell")) == 8
    assert found(page(lambda r, c: r)) == 8  # rows are blocks, as in a table
    ragged = [(*p[:5], p[4] + (100.0 if p[1] == 0 else 60.0), *p[6:]) for p in page(lambda r, c: 0)]
    assert found(ragged) == 8  # one block with cells of every width
    assert found([(*p[:6], "twenty-four-letters-long", p[7]) for p in page(lambda r, c: 0)]) == 8  # wrapped lines hold words
    one = [p if p[4] else (*p[:6], "4", p[7]) for p in page(lambda r, c: c)]
    assert found(one) == 8  # one column of prose beside numbers
