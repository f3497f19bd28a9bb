"""Form data files: hand-written ones, a plain recursive reader, and what is written read back."""

import random
import re

from quire.operators import form_files
from quire.operators.form_files import HEADER


def read(spark, *contents):
    df = spark.createDataFrame([(k, c if isinstance(c, bytes) else c.encode("latin-1")) for k, c in enumerate(contents)], "file long, content binary")
    return {k: [tuple(r)[2:6] if r.problem is None else r.problem for r in sorted(rows, key=lambda r: r.place or 0)] for k, rows in by_file(form_files.form_fields(df).collect()).items()}


def by_file(rows):
    out = {}
    for r in rows:
        out.setdefault(r.file, []).append(r)
    return out


def file_of(fields, more=""):
    return f"{HEADER}\n1 0 obj\n<< /FDF << /Fields [ {fields} ] >> >>\nendobj\n{more}\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n"


def test_values_of_every_kind(spark):
    fields = r"""<< /T (name) /V (Ay\350e \(x\) (nested) \\ \q end) >> <</T<6369>/V<FEFF00C70131>>> % comment ) <<
    << /T (on) /V /Yes >> << /T (off) /V /Off >> << /T (other) /V /Not#20Sure >> << /T (list) /V [ (a) /B <63> 4 ] >>
    << /T (number) /V 4 >> << /T (half) /V >> << /V (nameless) >> (stray) << /T (empty) /V () >>"""
    assert read(spark, file_of(fields))[0] == [
        ("name", "text", "Ayèe (x) (nested) \\ q end", None), ("ci", "text", "Çı", None), ("on", "flag", "true", None), ("off", "flag", "false", None),
        ("other", "state", "Not Sure", None), ("list", "list", None, ["a", "B", "c"]), ("empty", "text", "", None),
    ]


def test_kids_references_and_rings(spark):
    more = "2 0 obj << /T (b) /Kids [ 3 0 R 3 0 R << /V (no title) >> 2 0 R 99 0 R ] >> endobj\n3 0 obj << /T (c) /V 4 0 R >> endobj 4 0 obj 5 0 R endobj 5 0 obj (far) endobj 6 0 obj 6 0 R endobj"
    fields = "<< /T (a) /Kids [ 2 0 R << /T (d) /V (near) >> << /Kids [ << /T (e) /V /On >> ] >> ] >> << /T (ring) /V 6 0 R >>"
    assert read(spark, file_of(fields, more))[0] == [("a.b.c", "text", "far", None), ("a.d", "text", "near", None), ("a.e", "state", "On", None)]
    apart = f"{HEADER}\n7 0 obj << /Fields 8 0 R >> endobj 8 0 obj [ << /T (x) /V (y) >> ] endobj stream ( < binary endstream"
    assert read(spark, apart)[0] == [("x", "text", "y", None)]


def test_files_that_cannot_be_read(spark):
    got = read(spark, "%PDF-1.7", file_of("<< /T (a"), f"{HEADER}\n<< /A 1 >>", f"{HEADER}\n<41", f"{HEADER}\n{'[' * 100}", b"", file_of(""), file_of("<< /T (ok) /V (1) >>"))
    assert got[0] == ["not a form data file"] and got[1] == ["a string has no end"] and got[2] == ["no fields"] and got[3] == ["a hexadecimal string has no end"]
    assert got[4] == ["objects are nested too deeply"] and got[5] == ["not a form data file"] and 6 not in got and got[7] == [("ok", "text", "1", None)]


def test_writer_and_reader_invert_each_other(spark):
    texts = ["plain", "", "a(b)c\\d", "line\nfeed\r\ttab", "Ayşe ı \U0001f600", "\x9a café", "(", "\\", "a\x01b", "%x [y] <z>", "﻿"]
    rows = [(1, k, f"f{t}", "text", t, None) for k, t in enumerate(texts)]
    rows += [(2, 0, "on", "flag", "true", None), (2, 1, "off", "flag", "false", None), (2, 2, "s", "state", "Not sure #1 ş/", None), (2, 3, "l", "list", None, texts), (2, 4, "none", "list", None, [])]
    df = spark.createDataFrame(rows, "file long, place int, name string, kind string, value string, items array<string>")
    back = form_files.form_fields(form_files.form_file(df)).collect()
    assert sorted(tuple(r)[:6] for r in back) == sorted(rows, key=str) or {str(tuple(r)[:6]) for r in back} == {str(r) for r in rows}
    assert all(r.problem is None for r in back)


def plain_fields(source):
    """Names and texts of nested fields, by recursion over a file of dictionaries, arrays and simple strings."""
    marks = re.findall(r"<<|>>|\[|\]|/\w+|\(\w*\)", source)
    at = 0

    def value():
        nonlocal at
        mark = marks[at]
        at += 1
        if mark == "<<":
            out = {}
            while marks[at] != ">>":
                key = marks[at]
                at += 1
                out[key] = value()
            at += 1
            return out
        if mark == "[":
            out = []
            while marks[at] != "]":
                out.append(value())
            at += 1
            return out
        return mark[1:-1] if mark[0] == "(" else mark

    def walk(fields, above):
        for f in fields:
            name = f"{above}.{f['/T']}" if above and "/T" in f else f.get("/T", above)
            if "/T" in f and "/V" in f:
                yield name, f["/V"]
            yield from walk(f.get("/Kids", []), name)

    return list(walk(value(), ""))


def test_nested_fields_equal_a_plain_recursion(spark):
    rng = random.Random(8)

    def field(depth):
        parts = [f"/T (t{rng.randrange(9)})"] if rng.random() < 0.8 else []
        parts += [f"/V (v{rng.randrange(99)})"] if rng.random() < 0.7 else []
        parts += [f"/Kids [ {' '.join(field(depth + 1) for _ in range(rng.randrange(4)))} ]"] if depth < 5 and rng.random() < 0.6 else []
        rng.shuffle(parts)
        return f"<< {' '.join(parts)} >>"

    sources = [f"[ {' '.join(field(0) for _ in range(rng.randrange(1, 6)))} ]" for _ in range(30)]
    got = read(spark, *[file_of(s[2:-2]) for s in sources])
    for k, s in enumerate(sources):
        assert [(n, v) for n, _, v, _ in got.get(k, [])] == plain_fields(s)
