"""Audits of files: words hidden in strings, revisions, loose objects, traces, and rows for what is clean."""

import random
import unicodedata

from quire.operators import file_audit as fa


def audit(spark, needles, *contents):
    df = spark.createDataFrame([(k, c if isinstance(c, bytes) else c.encode("latin-1")) for k, c in enumerate(contents)], "doc_id long, content binary")
    out = {}
    for r in fa.audited_files(df, needles).collect():
        out.setdefault(r.doc_id, {})[r.check, r.severity if r.check == "residual-text" and r.severity == "info" else r.term if r.check == "residual-text" else None] = (r.severity, r.n, r.at)
    return out


CLEAN = "%PDF-1.7\n1 0 obj << /Type /Catalog >> endobj\ntrailer << /Root 1 0 R >>\nstartxref\n9\n%%EOF\n"


def test_a_clean_file_has_a_row_for_each_check(spark):
    got = audit(spark, ["secret", "", "secret", "other"], CLEAN)[0]
    assert set(got) == {("residual-text", "info"), *((c, None) for c in ("previous-revision", "orphan-object", "compressed", "metadata", "xmp", "attachment", "annotation", "javascript", "names"))}
    assert all(v == ("info", 0, None) for v in got.values())


def test_words_as_they_stand_and_as_they_read(spark):
    wide = lambda t: "<FEFF" + t.encode("utf-16-be").hex() + ">"
    octal = "(" + "".join(f"\\{b:03o}" for b in b"secret") + ")"
    loose = unicodedata.normalize("NFD", "Ayşé")
    files = [
        CLEAN + " secret (a secret) <73656372 6574>", CLEAN + octal + "(se\\\ncret)(se\\)cret)", CLEAN + wide("x secret secret"), CLEAN + wide(loose) + wide("\x1btr\x1bAyşé"), (CLEAN + "Ay").encode() + "Ayşé".encode(),
        CLEAN + "% (secr\\145t)\n << /A <</B (secr\\145t)>> >>", CLEAN + "\n2 0 obj << /Filter /X >> stream\n(secr\\145t)\nendstream", CLEAN + "\n2 0 obj << >> stream\r\n(secr\\145t) Tj (open endstream (secr\\145t)", CLEAN + "(a\\",
    ]
    got = audit(spark, ["secret", "Ayşé"], *files)
    n = lambda k, term: got[k].get(("residual-text", term), (0, 0))[1]
    assert [n(k, 1) for k in range(9)] == [3, 2, 2, 0, 0, 1, 0, 2, 0] and [n(k, 2) for k in range(9)] == [0, 0, 0, 2, 1, 0, 0, 0, 0]
    assert got[0]["residual-text", 1] == ("content", 3, len(CLEAN) + 1) and got[1]["residual-text", 1][2] == len(CLEAN)
    assert got[0]["residual-text", "info"][0] == "info" and ("residual-text", "info") in got[8]


def test_revisions_objects_and_traces(spark):
    two = CLEAN + "\n<< /Prev 9 >>\nstartxref\n5\n%%EOF"
    loose = CLEAN + "\n7 0 obj (left) endobj\r7 0 obj (again) endobj\n8 0 obj << /Type /XRef >> endobj\n9 0 obj endobj << /XRef >>"
    packed = loose + "\n10 0 obj << /Type /ObjStm /Filter /FlateDecode >>"
    traces = CLEAN + "/Info 3 0 R <?xpacket begin /Annots [] /JavaScript /Names /EmbeddedFile /EmbeddedFiles<</Names[]>> /EmbeddedFiles 12 0 R\n12 0 obj << /Kids [ ] >> endobj /EmbeddedFiles <</Names [1 0 R]>> /EmbeddedFilesX<<>>"
    got = audit(spark, [], CLEAN, two, loose, packed, traces)
    assert got[1]["previous-revision", None] == ("content", 2, CLEAN.index("startxref"))
    assert got[2]["orphan-object", None][:2] == ("content", 3) and got[3]["orphan-object", None][:2] == ("warning", 1) and got[3]["compressed", None][:2] == ("warning", 1)
    assert {c: v[:2] for (c, _), v in got[4].items() if v[1]} == {"metadata": ("warning", 1), "xmp": ("warning", 1), "attachment": ("warning", 3), "annotation": ("warning", 1), "javascript": ("warning", 1), "names": ("info", 3)}
    assert ("residual-text", "info") not in got[0]


def test_hidden_strings_equal_a_plain_walk():
    rng = random.Random(30)
    pieces = ["(", ")", "\\", "\\(", "\\101", "\\7", "\\\r\n", "\r", "a", "b<", "<41>", "<4", ">", "<<", ">>", "%c\n", " stream\n", "endstream", "/Filter", "\n3 0 obj", "<feff0041>", " "]

    def plain(source):
        out, at, limit, resume = [], 0, len(source), None
        objects = [k for k in range(len(source)) if source.startswith("3 0 obj", k) and (k == 0 or source[k - 1] in "\r\n")]
        while at < len(source):
            if resume is not None and at >= limit:
                at, limit, resume = resume, len(source), None
                continue
            c = source[at]
            if c == "%":
                while at < limit and source[at] not in "\r\n":
                    at += 1
            elif c == "(":
                start, depth, raw, at = at, 1, b"", at + 1
                while at < limit and depth:
                    c = source[at]
                    at += 1
                    if c == "\\":
                        e = source[at] if at < limit else ""
                        if e and e in "01234567":
                            d = e
                            at += 1
                            while len(d) < 3 and at < limit and source[at] in "01234567":
                                d += source[at]
                                at += 1
                            raw += bytes([int(d, 8) & 255])
                        elif e == "\r":
                            at += 2 if source[at + 1 : min(at + 2, limit)] == "\n" else 1
                        elif e:
                            at += 1
                            raw += b"" if e == "\n" else {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}.get(e, e).encode("latin-1")
                    elif c == "\r":
                        raw += b"\n"
                        at += source[at : min(at + 1, limit)] == "\n"
                    else:
                        depth += (c == "(") - (c == ")")
                        raw += c.encode("latin-1") if depth else b""
                text = fa._read(raw)
                if text != source[start + 1 : at - 1]:
                    out.append((start, at, text))
            elif c == "<" and source[at + 1 : min(at + 2, limit)] == "<":
                at += 2
            elif c == "<":
                stop = source.find(">", at, limit)
                body = source[at + 1 : stop if stop >= 0 else limit]
                digits = "".join(x for x in body if x in "0123456789abcdefABCDEF")
                start, at = at, stop + 1 if stop >= 0 else limit
                out.append((start, at, fa._read(bytes.fromhex(digits + "0" * (len(digits) % 2)))))
            elif resume is None and source.startswith("stream\n", at) and at and source[at - 1] in "> \t\r\n":
                data = at + 7
                stop = source.find("endstream", data)
                stop = len(source) if stop < 0 else stop
                opening = max([o for o in objects if o <= at], default=0)
                if "/Filter" in source[opening:at]:
                    at = stop
                else:
                    at, limit, resume = data, stop, stop
            else:
                at += 1
        return out

    seen = 0
    for _ in range(4000):
        source = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        got = list(fa.hidden_strings(source))
        assert got == plain(source), source
        seen += len(got)
    assert seen > 4000
