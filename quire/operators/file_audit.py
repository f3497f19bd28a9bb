"""What a file that was meant to be cleaned still holds: the words themselves, earlier revisions, loose objects, traces.

A file's bytes are a text of one character a byte, so each check is a column over its row. Words are also looked for in the
file's strings as they read: escapes, hexadecimal and UTF-16 hide them from a search of the bytes. Those strings are found by
walking the file's syntax, and only the ones that read otherwise than they are written are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.operators.form_files import ESCAPES, PDF_DOC
from quire.operators.groups import slices

# Fixed values of the syntax: what begins something that isn't plain, the parts of a literal string, how an object's
# definition opens a line, and how far back a stream's dictionary and how far on an object's type are looked for.
POINT = re.compile(r"%[^\r\n]*|\(|<<|<|(?<=[> \t\r\n])stream[ \t]*(?:\r\n|\r|\n)")
PART = re.compile(r"\\(?P<octal>[0-7]{1,3})|\\(?P<escape>\r\n|[\s\S])|(?P<open>\()|(?P<close>\))|(?P<line>\r\n?)|(?P<plain>[^\\()\r]+)|(?P<last>\\)")
DEFINITION = r"(?:\A|(?<=[\r\n]))(\d+) 0 obj"
DICTIONARY, TYPE = 65536, 160
EMPTY_TREE = r"\s*<<(?:\s*/(?:Names|Kids)\s*\[\s*\])*\s*>>"
LANGUAGE = re.compile("\x1b[A-Za-z]{2}(?:-?[A-Za-z]{2})?\x1b")  # a language tag inside a text
NAME_END = r"(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\z)"
# Traces, what marks them, and how grave they are, in the order of the report.
TRACES = (("metadata", "/Info", "warning"), ("xmp", "<?xpacket", "warning"), ("attachment", "/EmbeddedFile", "warning"), ("annotation", "/Annots", "warning"), ("javascript", "/JavaScript", "warning"), ("names", "/Names", "info"))


def _read(raw: bytes) -> str:
    """A string's text: UTF-16 or UTF-8 where marked, else PDFDocEncoding; composed."""
    if raw[:2] == b"\xfe\xff":
        text = LANGUAGE.sub("", raw[2 : len(raw) & ~1].decode("utf-16-be", "replace"))
    elif raw[:3] == b"\xef\xbb\xbf":
        text = LANGUAGE.sub("", raw[3:].decode("utf-8", "replace"))
    else:
        text = raw.decode("latin-1").translate(PDF_DOC)
    return normalize("NFC", text)


def _literal(source: str, at: int, limit: int) -> tuple[bytes, int]:
    raw, depth = bytearray(), 1
    for part in PART.finditer(source, at, limit):
        kind, value = part.lastgroup, part[part.lastgroup]
        if kind == "octal":
            raw.append(int(value, 8) & 255)
        elif kind == "escape":
            raw += b"" if value[0] in "\r\n" else ESCAPES.get(value, value).encode("latin-1")
        elif kind == "line":
            raw += b"\n"
        elif kind != "last":
            depth += (kind == "open") - (kind == "close")
            if not depth:
                return bytes(raw), part.end()
            raw += value.encode("latin-1")
    return bytes(raw), limit


def hidden_strings(source: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, text) of the strings of a file that read otherwise than they are written. Comments, dictionaries and
    streams with a filter are passed over; a string in a stream without one ends where the stream does."""
    objects = [m.start() for m in re.finditer(DEFINITION, source)]
    at, limit, resume = 0, len(source), None
    while True:
        found = POINT.search(source, at, limit)
        if not found:
            if resume is None:
                return
            at, limit, resume = resume, len(source), None
            continue
        mark, at = found[0], found.end()
        if mark == "(":
            raw, at = _literal(source, at, limit)
            text = _read(raw)
            if text != source[found.end() : at - 1]:
                yield found.start(), at, text
        elif mark == "<":
            stop = source.find(">", at, limit)
            body, at = (source[at:stop], stop + 1) if stop >= 0 else (source[at:limit], limit)
            digits = re.sub("[^0-9a-fA-F]", "", body)
            yield found.start(), at, _read(bytes.fromhex(digits + "0" * (len(digits) % 2)))
        elif mark[0] == "s" and resume is None:
            stop = source.find("endstream", at)
            stop = len(source) if stop < 0 else stop
            k = bisect_right(objects, found.start()) - 1
            opening = max(objects[k] if k >= 0 else 0, found.start() - DICTIONARY)
            if "/Filter" in source[opening : found.start()]:
                at = stop
            else:
                limit, resume = stop, stop


def with_strings(files: DataFrame) -> DataFrame:
    """(doc_id, text, strings) of files (doc_id, content): the bytes as characters, and the hidden strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
        for batch in slices(batches, "content"):
            texts = [(c or b"").decode("latin-1") for c in batch.column("content").to_pylist()]
            found = [[{"start": a, "stop": b, "text": t.encode("utf-8", "replace").decode()} for a, b, t in hidden_strings(x)] for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts), pa.array(found, kind)], names=["doc_id", "text", "strings"])

    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {dict(files.dtypes)['doc_id']}, text string, strings array<struct<start:int,stop:int,text:string>>")


def _count(text: Column, needle: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def _first(text: Column, needle: str) -> Column:
    at = F.instr(text, needle)
    return F.when(at > 0, at - 1)


def _term(number: int, needle: str) -> Column:
    """(check, severity, n, term, at) of a needle: how often it stands in the bytes, as it is or in UTF-8, and how much
    oftener in the strings as they read."""
    forms = list(dict.fromkeys([needle, needle.encode().decode("latin-1")]))
    composed = normalize("NFC", needle)
    raw = lambda text: sum((_count(text, f) for f in forms), F.lit(0).cast("long"))
    more = lambda s: _count(s["text"], composed) - raw(F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"]))
    extra = F.filter(F.transform("strings", lambda s: F.struct(more(s).alias("n"), s["start"].alias("at"))), lambda s: s["n"] > 0)
    n = raw(F.col("text")) + F.aggregate(extra, F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    at = F.array_min(F.array_compact(F.concat(F.array(*[_first(F.col("text"), f) for f in forms]), F.transform(extra, lambda s: s["at"]))))
    return _finding("residual-text", "content", n, number, at)


def _finding(check: str, severity: str, n: Column, term: int | None = None, at: Column | None = None) -> Column:
    facts = {"check": F.lit(check), "severity": F.lit(severity), "n": n.cast("long"), "term": F.lit(term).cast("int"), "at": (F.lit(None) if at is None else at).cast("int")}
    return F.struct(*[v.alias(k) for k, v in facts.items()])


def audited_files(files: DataFrame, needles: list[str]) -> DataFrame:
    """(doc_id, check, severity, n, term, at) for files (doc_id, content) that shouldn't hold the needles, a person's list.

    Each needle that is found is a row with its number in the list, from 1, how often, and the first place; empty and
    repeated needles are passed over. Then come: earlier revisions (more than one startxref, or a /Prev), objects that
    nothing refers to (`orphan-object`; where objects are packed into streams they can't be told, which is a warning), packed
    content (`compressed`), and traces. What isn't found is a row `clean` of severity info and count 0 for its check, so that a
    missing row never means that nothing was looked for.
    """
    terms = {n: number for number, n in reversed(list(enumerate(needles, 1))) if n}
    text = F.col("text")
    number = lambda column: F.transform(column, lambda x: x.cast("long"))
    used = number(F.regexp_extract_all(text, F.lit(r"(\d+) 0 R"), F.lit(1)))
    opened = rf"(?:\A|(?<=[\r\n]))(?=([\s\S]{{0,{TYPE}}}))(\d+) 0 obj"
    defined = F.arrays_zip(F.regexp_extract_all(text, F.lit(opened), F.lit(1)).alias("head"), number(F.regexp_extract_all(text, F.lit(opened), F.lit(2))).alias("number"))
    structural = lambda d: F.substring_index(d["head"], "endobj", 1).rlike(r"/(ObjStm|XRef)\b")
    loose = F.size(F.filter(defined, lambda d: ~F.array_contains(used, d["number"]) & ~structural(d)))
    packed, chains = _count(text, "/ObjStm"), _count(text, "/Prev")
    revisions = _count(text, "startxref")
    empty = number(F.regexp_extract_all(text, F.lit(rf"{DEFINITION}{EMPTY_TREE}"), F.lit(1)))
    named = number(F.regexp_extract_all(text, F.lit(rf"/EmbeddedFiles{NAME_END}\s*(\d+) 0 R"), F.lit(1)))
    bare = F.regexp_count(text, F.lit(rf"/EmbeddedFiles{NAME_END}{EMPTY_TREE}")) + F.size(F.filter(named, lambda k: F.array_contains(empty, k)))
    found = [_term(terms[n], n) for n in sorted(terms, key=terms.get)]
    found.append(_finding("previous-revision", "content", F.when((revisions > 1) | (chains > 0), F.greatest(revisions, chains)).otherwise(0), at=_first(text, "startxref")))
    found.append(F.when(packed > 0, _finding("orphan-object", "warning", packed, at=_first(text, "/ObjStm"))).otherwise(_finding("orphan-object", "content", loose)))
    found.append(_finding("compressed", "warning", _count(text, "/FlateDecode"), at=_first(text, "/FlateDecode")))
    for check, marker, severity in TRACES:
        n = _count(text, marker)
        found.append(_finding(check, severity, n - bare if check == "attachment" else n, at=_first(text, marker)))
    # one look at a text: what the findings say is sorted out in its own row
    met = lambda rows: F.filter(rows, lambda r: r["n"] > 0)
    told = lambda r: F.struct(r["check"], F.when(r["n"] > 0, r["severity"]).otherwise("info").alias("severity"), r["n"], r["term"], F.when(r["n"] > 0, r["at"]).alias("at"))
    # as many needles as weren't found, where there are such
    rest = lambda own: F.when(F.size(met(own)) < len(terms), F.array(_finding("residual-text", "info", F.lit(0), at=F.lit(None)).withField("term", F.lit(len(terms)) - F.size(met(own))))).otherwise(F.array())
    words, others = found[: len(terms)], found[len(terms) :]
    own = let(F.array(*words), lambda w: F.concat(met(w), rest(w))) if terms else None
    rows = F.transform(F.array(*others), told)
    return with_strings(files).select("doc_id", F.inline(rows if own is None else F.concat(own, rows)))
