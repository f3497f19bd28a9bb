"""XFDF files: what is written, what is read, threads, and files that are none."""

from pyspark.sql import functions as F
from quire.operators import comments

ROW = (
    "file long, ord int, name string, subtype string, page int, rect array<double>, contents string, title string, modified string, created string, colour string, opacity double, width double,"
    "coords array<double>, strokes array<array<double>>, ends array<double>, parent string, state string, state_model string"
)


def note(ord, name, subtype="Text", **more):
    row = {"file": 1, "ord": ord, "name": name, "subtype": subtype, "page": 1, "rect": [10.0, 20.0, 110.0, 70.0], "contents": "text", "title": "Ali"} | more
    return tuple(row.get(c.strip().split(" ")[0]) for c in ROW.replace("array<array<double>>", "x").replace("array<double>", "x").split(","))


def written(spark, *rows):
    return comments.comment_files(spark.createDataFrame(list(rows), ROW)).first()


def elements(content):
    return content[content.index("<annots>") + 8 : content.index("</annots>")].split("\n")


def test_elements_as_written(spark):
    got = written(
        spark, note(0, "a", "Square", rect=[110.0, 70.0, 10.0, 20.0], width=2.0, colour="#ffd400", opacity=0.33333, contents=""), note(1, "b", "Line", ends=[10.0, 780.0, 30.12345, -0.0001], contents='a&b <c> "d"\x01'),
        note(2, "c", "Ink", strokes=[[10.0, 700.0, 20.0, 600.0, 30.0], []], contents=""), note(3, "d", modified="2024-05-06T07:08:09+02:00", created="D:2024", parent="a"),
        note(4, "e", parent="a", state="Accepted"), note(5, "f", "Popup"), note(6, "g", "Stamp"), note(7, "h", rect=None), note(8, "i", "Highlight", coords=[1.0, 2.5], modified="soon"),
    )
    assert (got.written, got.skipped) == (4, 2)
    assert elements(got.content) == [
        '<square page="1" rect="10,20,110,70" name="a" title="Ali" color="#FFD400" opacity="0.333" width="2"/>',
        '<line page="1" rect="10,20,110,70" name="b" title="Ali" start="10,780" end="30.123,0"><contents>a&amp;b &lt;c&gt; &quot;d&quot;</contents></line>',
        '<ink page="1" rect="10,20,110,70" name="c" title="Ali"><inklist><gesture>10,700;20,600</gesture><gesture></gesture></inklist></ink>',
        '<text page="1" rect="10,20,110,70" name="d" title="Ali" date="D:20240506050809Z" creationdate="D:2024" inreplyto="a" flags="print,nozoom,norotate" icon="Comment"><contents>text</contents></text>',
        '<text page="1" rect="10,20,110,70" name="e" title="Ali" inreplyto="a" state="Accepted" statemodel="Review" flags="hidden,print,nozoom,norotate" icon="Comment"><contents>text</contents></text>',
        '<highlight page="1" rect="10,20,110,70" name="i" title="Ali" coords="1,2.5"><contents>text</contents></highlight>',
    ]
    assert got.content.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve"><annots>') and got.content.endswith("</annots></xfdf>\n")


def xfdf(inner, head=""):
    return f'{head}<xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>{inner}</annots></xfdf>'


def read(spark, *contents):
    marks, counts = comments.read_comments(spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "file long, content string"))
    return {(r.file, r.name): r for r in marks.collect()}, {r.file: tuple(r)[1:] for r in counts.collect()}


def test_marks_as_read(spark):
    marks, counts = read(
        spark,
        xfdf(
            '<highlight page="2" rect="9 1,5;4" coords="0,10,5,10,0,2,5,2,1,1" color=" #AABBCC " name="h" title="T"><contents> a &amp; b </contents></highlight>'
            '<square rect="0,0,10,20" width="4" name="s" opacity="7"/><circle page="-3" rect="0,0,2,20" width="9" name="c" opacity="0" color="red"/>'
            '<line page="1" rect="0,0,9,9" start="1,2" end="3,4" name="l"/><line page="1" rect="0,0,9,9" start="1" end="3,4" name="bad line"/>'
            '<ink page="1" rect="0,0,9,9" name="i"><inklist><gesture>1,2;3,4</gesture><gesture>1,2</gesture></inklist></ink><ink page="1" rect="0,0,9,9" name="no ink"/>'
            '<freetext page="1" rect="0,0,9,9" name="f"><contents>x</contents><defaultappearance>/Helv 11.5 Tf 1 0.5 0 rg</defaultappearance></freetext><freetext page="1" rect="0,0,9,9"><contents> </contents></freetext>'
            '<text page="1" rect="0,0,9" name="short"/><text page="1" rect="0,0,9,9" name="h"/><stamp page="1" rect="0,0,9,9"/><text page="1" rect="0,0,9,9" name="rich"><contents-richtext><body><p>so <b>rich</b></p></body></contents-richtext></text>',
            "\ufeff<?xml version='1.0'?> <!-- x -->",
        ),
    )
    told = {n: (r.kind, r["shape"], r.page, r.boxes, r.colour, r.opacity, r.width, r.contents, r.title) for (_, n), r in marks.items()}
    assert told == {
        "h": ("highlight", None, 2, [[0.0, 2.0, 5.0, 10.0]], "#aabbcc", 1.0, None, " a & b ", "T"), "s": ("shapes", "square", 0, [[2.0, 2.0, 8.0, 18.0]], "#e5484d", 1.0, 4.0, "", ""),
        "c": ("shapes", "circle", 0, [[1.0, 4.5, 1.0, 15.5]], "#e5484d", 0.02, 9.0, "", ""), "l": ("shapes", "line", 1, [[0.0, 0.0, 9.0, 9.0]], "#e5484d", 1.0, None, "", ""),
        "i": ("ink", None, 1, [[1.0, 1.0, 8.0, 8.0]], "#e5484d", 1.0, 2.0, "", ""), "f": ("freetext", None, 1, [[0.0, 0.0, 9.0, 9.0]], "#ff8000", 1.0, None, "x", ""),
        "rich": ("note", None, 1, [[0.0, 0.0, 9.0, 9.0]], "#e5484d", 1.0, None, "so rich", ""),
    }
    assert marks[0, "l"].ends == [1.0, 2.0, 3.0, 4.0] and marks[0, "i"].strokes == [[1.0, 2.0, 3.0, 4.0]] and marks[0, "f"].font_size == 11.5
    assert counts == {0: (7, 6, 1, None)}


def test_threads(spark):
    text = lambda name, more, body="x": f'<text page="0" rect="0,0,9,9" name="{name}" {more}><contents>{body}</contents></text>'
    inner = text("m", "") + text("r2", 'inreplyto="r1" date="D:20240102"', "second") + text("r1", 'inreplyto="m" date="D:20240101" title="A"', "first") + text("lost", 'inreplyto="gone"')
    inner += text("s1", 'inreplyto="m" state="Rejected" date="D:20240301"') + text("s2", 'inreplyto="r2" state="Accepted" statemodel="Review" date="D:20240201"') + text("s3", 'inreplyto="m" state="Odd"')
    inner += text("s4", 'inreplyto="m" state="Marked" statemodel="Marked"') + text("e", 'inreplyto="m"', " ") + text("g", 'inreplyto="m" replyType="group"') + text("x", 'inreplyto="y"') + text("y", 'inreplyto="x"')
    marks, counts = read(spark, xfdf(inner), xfdf(text("m", "")))
    m = marks[0, "m"]
    assert [(r.title, r.contents) for r in m.replies] == [("A", "first"), ("", "second")] and m.review.state == "Rejected"
    assert set(marks) == {(0, "m"), (0, "g"), (1, "m")} and marks[1, "m"].replies == [] and marks[1, "m"].review is None
    assert counts == {0: (2, 6, 0, None), 1: (1, 0, 0, None)}


def test_files_that_are_no_comments(spark):
    marks, counts = read(spark, "", None, "<fdf/>", "<xfdf><annots><text></annots></xfdf>", xfdf(""), '<xfdf xmlns="x"> </xfdf>')
    assert marks == {} and [counts[k][3] for k in range(6)] == ["not XFDF"] * 4 + [None] * 2


def test_writer_and_reader_invert_each_other(spark):
    rows = [
        note(0, "a", "Highlight", coords=[0.0, 10.0, 5.5, 10.0, 0.0, 2.0, 5.5, 2.0], colour="#aabbcc", opacity=0.25, contents="é <\n\"'&> \U0001f600", title="x & y"),
        note(1, "b", "Circle", width=4.0, contents=""), note(2, "c", "Ink", width=3.0, strokes=[[1.0, 2.0, 3.5, 4.125]], contents="  ink  "), note(3, "d", "Line", ends=[1.0, 2.0, 3.0, 4.0]),
        note(4, "e", parent="a", created="2024-01-02T00:00:00Z", contents="answer"),
    ]
    made = comments.comment_files(spark.createDataFrame(rows, ROW))
    marks, counts = comments.read_comments(made)
    got = {r.name: r for r in marks.collect()}
    assert set(got) == {"a", "b", "c", "d"} and counts.first()[1:] == (4, 0, 0, None)
    assert (got["a"].boxes, got["a"].colour, got["a"].opacity, got["a"].contents, got["a"].title) == ([[0.0, 2.0, 5.5, 10.0]], "#aabbcc", 0.25, rows[0][6], "x & y")
    assert got["b"].width == 4.0 and got["c"].strokes == [[1.0, 2.0, 3.5, 4.125]] and got["c"].contents == "  ink  " and got["d"].ends == [1.0, 2.0, 3.0, 4.0]
    assert [r.contents for r in got["a"].replies] == ["answer"]
    assert made.select(F.length("content")).first()[0] > 500
