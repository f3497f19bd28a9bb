"""What keeps a step's memory and time in proportion to its input."""

import contextlib
import io

import pyarrow as pa
from pyspark.sql import functions as F


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_slices_hold_a_bounded_share_of_the_texts():
    from quire.operators.groups import slices

    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "text": ["a" * 10, "", None, "b" * 35, "c" * 5, "d", "é" * 9]})
    got = list(slices([batch, batch.slice(0, 0)], "text", 20))
    assert [r for b in got for r in b.to_pylist()] == batch.to_pylist()
    assert len(got) == 2 and all(sum(len((t or "").encode()) for t in b.column("text").to_pylist()[:-1]) <= 20 for b in got)


def test_reflow_makes_a_slice_at_a_time(spark, monkeypatch):
    from quire.operators import reading

    docs = spark.createDataFrame([(k, "word " * (k % 5)) for k in range(50)], "doc_id long, text string")
    got = {r["doc_id"]: r["lines"] for r in reading.reflowed(docs, 10).collect()}
    assert got == {k: [" ".join(["word"] * n) for n in [2] * (k % 5 // 2) + [1] * (k % 5 % 2)] for k in range(50)}


def test_one_look_finds_what_single_searches_find(spark):
    from quire.operators import aligned

    texts = ["In the ﬁnal the­ the", "thé é café", "", None, "THE in-\nner INN i"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = [("in", False), ("the", True), ("é", False), ("", False)]
    each = {(r["doc_id"], n, *tuple(r)[1:]) for n, whole in wanted for r in aligned.aligned_matches(df, ["doc_id"], n, whole_word=whole).collect()}
    made = aligned.searched(df, ["doc_id"], wanted)
    assert {tuple(r) for r in made.collect()} == each and len(each) > 6
    assert plan(made).count("MapInArrow") == 1


def test_nothing_looks_ahead_over_the_rest_of_a_line_for_each_unit(spark):
    from quire.operators.reading import reading_places
    from quire.operators.text_export import display_places

    units = spark.createDataFrame([(1, k, d, False, c) for k, (d, c) in enumerate([("rtl", "R"), (None, "ET"), ("ltr", "EN"), (None, "ON"), (None, "ON")])], "g int, ord int, direction string, rtl_base boolean, class string")
    assert "unboundedfollowing" not in plan(reading_places(units, ["g"])).lower()
    assert "unboundedfollowing" not in plan(display_places(units, ["g"])).lower()
    assert [r["place"] for r in reading_places(units, ["g"]).orderBy("ord").collect()] == [0, 1, 2, 3, 4]


def test_a_date_is_taken_apart_once(spark):
    from quire.functions.dates import pdf_date, pdf_date_text

    rows = ["D:2024", "D:20240229", " d:20240131235960", "D:202402301200", "D:20240101120000+05'30'", "D:20240101120000-0530", "D:20240101Z05'", "D:202401011", "D:0000", None, "x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = df.select("k", pdf_date_text(pdf_date(F.col("t"))).alias("d"))
    assert [r["d"] for r in got.orderBy("k").collect()] == ["D:20240101000000Z", "D:20240229000000Z", None, None, "D:20240101063000Z", "D:20240101173000Z", "D:20240101000000Z", None, None, None, None]
    assert plan(got).count("regexp") < 8


def test_a_file_is_audited_in_one_look(spark):
    from quire.operators.file_audit import audited_files

    df = spark.createDataFrame([(1, bytearray(b"%PDF the the")), (2, bytearray(b"none"))], "doc_id long, content binary")
    made = audited_files(df, ["the", "lost"])
    text = plan(made)
    assert text.count("MapInArrow") == 1 and "Exchange" not in text
    got = {tuple(r) for r in made.where("check = 'residual-text'").collect()}
    assert got == {(1, "residual-text", "content", 2, 1, 5), (1, "residual-text", "info", 0, 1, None), (2, "residual-text", "info", 0, 2, None)}


def test_larger_tables_go_to_more_parts(spark):
    from quire.operators.groups import dealt_by_rows

    assert dealt_by_rows(spark.range(5000), "id", rows=100).rdd.getNumPartitions() == 50
    assert dealt_by_rows(spark.range(50), "id", rows=100).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_words_of_a_pair_are_shuffled_once(spark):
    from quire.operators.compare import word_recall

    one = spark.createDataFrame([(1, "a b b c"), (2, ""), (3, None), (4, "x x")], "pair long, text string")
    two = spark.createDataFrame([(1, "b c c d"), (4, "x x x"), (9, "z")], "pair long, text string")
    made = word_recall(one, two)
    assert {tuple(r) for r in made.select("pair", "words", "kept", "recall").collect()} == {(1, 4, 2, 0.5), (2, 0, 0, None), (3, 0, 0, None), (4, 2, 2, 1.0)}
    assert not [x for x in plan(made).splitlines() if "Exchange hashpartitioning" in x and ", h#" in x]


def test_steps_of_a_graph_take_edges_as_they_are(spark, sf):
    from unittest import mock

    from quire.plans import record_queries

    with mock.patch.object(record_queries.graph, "reachable", side_effect=lambda seeds, edges: edges):
        assert "Exchange" not in plan(record_queries.g6_reachable(spark, sf))


def test_only_lines_written_from_the_right_are_put_in_order(spark):
    from unittest import mock

    from quire.operators import text_export as te

    words = {1: ["one", "two"], 2: ["שלום", "two", "עברית"]}
    rows = [(p, k, w, 30.0 * k, 0.0, 10.0, 25.0) for p, ws in words.items() for k, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "page long, ord int, text string, x double, y double, size double, width double")
    seen, real = [], te.reading_places
    with mock.patch.object(te, "reading_places", side_effect=lambda units, *a: (seen.append(units), real(units, *a))[1]):
        got = {r["page"]: r["text"] for r in te.page_texts(df).collect()}
    assert got == {1: "one two", 2: "עברית two שלום"}
    assert {r["page"] for r in seen[0].select("page").distinct().collect()} == {2}
    assert {(r["page"], len(r["pieces"])) for r in te.placed_lines(df).collect()} == {(1, 2), (2, 3)}


def test_documents_of_many_lines_are_set_out(spark, tmp_path):
    from quire.plans.form_queries import t8_text_files

    texts = ["a b\n" * 22_000 + "end", None, "", "a  b \n\n c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["empty"], r["characters"]) for r in t8_text_files(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 22_000 * 3 + 3 + 22_000 - 550), 2: (1, 0), 3: (0, 6)}


def test_files_are_dealt_out_and_a_dictionary_is_one_row(spark):
    from quire.operators import form_files
    from quire.operators.groups import part_count

    more = "4000000000 0 obj << /T (far) /V [ (a) 9 /B 7 0 R ] >> endobj 7 0 obj <63> endobj"
    text = f"{form_files.HEADER}\n1 0 obj << /FDF << /Fields [ << /T (a) /Kids [ 4000000000 0 R << /T (b) /V (x) >> ] >> ] >> >> endobj {more}"
    df = spark.createDataFrame([(1, text.encode()), (2, b"%PDF")], "file long, content binary").coalesce(1)
    got = {(r["file"], r["name"], r["value"], tuple(r["items"] or ()), r["problem"]) for r in form_files.form_fields(df).collect()}
    assert got == {(1, "a.far", None, ("a", "B", "c"), None), (1, "a.b", "x", (), None), (2, None, None, (), "not a form data file")}
    rows = form_files.file_entries(df)
    assert rows.rdd.getNumPartitions() == part_count(df)
    assert rows.where("file = 1").count() == 4


def test_nodes_are_dealt_out_into_parts_by_their_number(spark, sf):
    import random
    from unittest import mock

    from quire.operators import rules
    from quire.plans import record_queries

    rng = random.Random(4)
    roles = ["L", "LI", "LBody", "Lbl", "TR", "TD", "TBody", "Table", "Caption", "P", "H1", "H3", "H", "Figure", ""]
    rows = [(d, f"n{k}", rng.choice([None, f"n{rng.randrange(k + 3)}"]), k, rng.choice(roles), rng.choice([None, "", "x"]), None) for d in range(5) for k in range(40)]
    nodes = spark.createDataFrame(rows, "doc_id long, key string, parent string, ord long, role string, alt string, actual string")
    role = {(d, k): r for d, k, _, _, r, _, _ in rows}
    want = []
    for d, k, p, _, r, _, _ in rows:
        up = role.get((d, p), "")
        want += [(d, reason, k) for reason, (names, allowed, side) in rules.NESTING.items() if (up in names and r not in allowed if side == "parent" else r in names and up not in allowed)]
        want += [(d, "no-body", k)] if r == "LI" and not any(x[:1] + x[2:3] == (d, k) and x[4] == "LBody" for x in rows) else []
    whole = sorted(tuple(r) for r in rules.run_rules(nodes).collect())
    assert sorted(tuple(r) for r in rules.run_rules(nodes, 7).collect()) == whole
    assert sorted((d, reason, k) for d, rule, reason, k in whole if rule == "nesting") == sorted(want)
    with mock.patch.object(record_queries, "parts_by_rows", return_value=23):
        dealt = [x for x in plan(record_queries.u5_structure_rules(spark, sf)).splitlines() if "Exchange hashpartitioning(doc_id" in x or "Exchange hashpartitioning(l_orderkey" in x]
    assert len(dealt) >= 6 and all(", 23)," in x for x in dealt)


def test_a_table_in_few_files_is_dealt_out(spark, tmp_path):
    from quire.operators.groups import spread

    cores = spark.sparkContext.defaultParallelism
    for files in (1, cores):
        spark.range(100).repartition(files).write.parquet(f"{tmp_path}/{files}")
    assert spread(spark.read.parquet(f"{tmp_path}/1"), 23, "id").rdd.getNumPartitions() == 23
    assert "Exchange" not in plan(spread(spark.read.parquet(f"{tmp_path}/{cores}"), 23, "id"))
