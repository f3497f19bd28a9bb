"""Form data files (FDF): their objects as rows, the fields below each other by joins, and files written from values.

A file is cut into tokens and objects: a node, the node it hangs from and the slot it fills there (a key of a dictionary, a
place in an array). References are followed where a file is read, and each dictionary in an array becomes a row. Which field
stands below which, and what a field's whole name is, then follows by joins over all files at once, level by level. A file
that can't be read is a row with the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from quire.operators.graph import settled
from quire.operators.groups import dealt, slices

HEADER = "%FDF-1.2"
DEEPEST = 64
HOPS = 16
# PDFDocEncoding where it isn't Latin-1, from 0x18 and from 0x80 on, in order.
FROM_18 = "˘ˇˆ˙˝˛˚˜"
FROM_80 = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž\x9f€"
PDF_DOC = {0x18 + k: c for k, c in enumerate(FROM_18)} | {0x80 + k: c for k, c in enumerate(FROM_80)}

# Fixed values of the syntax: white space, and what ends a name or a bare word.
BLANK, WORD = r"[\t\n\x0b\x0c\r \xa0]", r"[^\t\n\x0b\x0c\r \xa0/<>\[\]()%]"
TOKEN = re.compile(rf"(?:{BLANK}++|%[^\r\n]*+)*+(?:(?P<open><<)|(?P<close>>>)|<(?P<hex>[^>]*)>|(?P<list>\[)|(?P<end>\])|/(?P<name>{WORD}*)|(?P<word>{WORD}+)|\((?P<plain>[^\\()]*)\)|(?P<string>\()|(?P<other>.))?", re.S)
PART = re.compile(r"(?P<plain>[^\\()]+)|\\(?P<octal>[0-7]{1,3})|\\(?P<escape>[\\()nrtbf])|(?P<lost>\\)|(?P<nest>\()|(?P<done>\))", re.S)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
KINDS = {"open": "dict", "list": "list", "string": "string", "name": "name", "ref": "ref"}
NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)", re.A)


class Unreadable(ValueError):
    """Why a file can't be read."""


def _text(raw: bytes) -> str:
    """The text of a string's bytes: UTF-16 where marked, else PDFDocEncoding."""
    if raw[:2] == b"\xfe\xff":
        try:
            return raw[2 : len(raw) & ~1].decode("utf-16-be")
        except UnicodeDecodeError:
            pass
        return raw[2 : len(raw) & ~1].decode("utf-16-be", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return raw.decode("latin-1").translate(PDF_DOC)


def _literal(source: str, at: int) -> tuple[str, int]:
    """The literal string whose opening parenthesis stands before `at`, and where it ends. Parentheses inside are paired."""
    raw, depth = bytearray(), 1
    for part in PART.finditer(source, at):
        kind, value = part.lastgroup, part[part.lastgroup]
        if kind == "octal":
            raw.append(int(value, 8) & 255)
        elif kind != "lost":  # a backslash before anything else goes
            depth += (kind == "nest") - (kind == "done")
            if not depth:
                return _text(bytes(raw)), part.end()
            raw += (ESCAPES.get(value, value) if kind == "escape" else value).encode("latin-1")
    raise Unreadable("a string has no end")


def _name(raw: str) -> str:
    """A name with its #xx escapes: UTF-8 where it is, else Latin-1."""
    if "#" not in raw and raw.isascii():
        return raw
    octets = re.sub(rb"#([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1].decode()), raw.encode("latin-1"))
    try:
        return octets.decode()
    except UnicodeDecodeError:
        return octets.decode("latin-1")


def tokens(source: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of the tokens of a file, given as one character a byte."""
    at = 0
    while at < len(source):
        found = TOKEN.match(source, at)
        kind, at = found.lastgroup, found.end()
        if kind == "word":
            value = found["word"]
            yield kind, value
            if value == "stream":
                at = (source.find("endstream", at) + 1 or len(source) + 1) - 1
        elif kind == "plain":
            raw = found["plain"]
            yield "string", raw if raw.isascii() and raw.isprintable() else _text(raw.encode("latin-1"))
        elif kind == "string":
            value, at = _literal(source, at)
            yield "string", value
        elif kind == "hex":
            try:
                raw = bytes.fromhex(found["hex"])
            except ValueError:
                digits = re.sub("[^0-9a-fA-F]", "", found["hex"])
                raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
            yield "string", _text(raw)
        elif kind == "other" and found["other"] == "<":
            raise Unreadable("a hexadecimal string has no end")
        elif kind:
            yield kind, _name(found[kind]) if kind == "name" else found[kind]


def nodes(content: bytes) -> Iterator[tuple[int, int, str, int, str, str]]:
    """(node, parent, slot, number, kind, text) of a file's objects: kinds are dict, list, string, name, ref and other. The
    parent of what stands by itself is -1, and number is that of an indirect object. Of equal keys the last counts."""
    source = content.decode("latin-1")
    if not source.startswith(HEADER):
        raise Unreadable("not a form data file")
    every = list(tokens(source))
    is_number = lambda k: 0 <= k < len(every) and every[k][0] == "word" and every[k][1].isascii() and every[k][1].isdigit()
    open_nodes: list[list] = []  # [node, kind, the key that waits for a value, or the next place]
    slots: dict[tuple[int, str], tuple] = {}
    at = made = 0
    number = -1
    while at < len(every):
        kind, value = every[at]
        top = open_nodes[-1] if open_nodes else None
        at += 1
        if top and kind == ("close" if top[1] == "dict" else "end"):
            open_nodes.pop()
            continue
        if top and top[1] == "dict" and top[2] is None:
            top[2] = value if kind == "name" else None
            continue
        if not top and (kind, value) == ("word", "obj") and is_number(at - 2) and is_number(at - 3):
            number = int(every[at - 3][1])
            continue
        if kind == "word":
            if value[0] in "0123456789" and is_number(at - 1) and is_number(at) and at + 1 < len(every) and every[at + 1] == ("word", "R"):
                kind, at = "ref", at + 2
            else:
                kind = "other"
        kind = KINDS.get(kind, "other")
        parent, slot = (-1, str(made)) if not top else (top[0], str(top[2]))
        slots[parent, slot] = (made, parent, slot, number if not top else -1, kind, value)
        if top:
            top[2] = None if top[1] == "dict" else top[2] + 1
        else:
            number = -1
        if kind in ("dict", "list"):
            open_nodes.append([made, kind, None if kind == "dict" else 0])
            if len(open_nodes) > DEEPEST:
                raise Unreadable("objects are nested too deeply")
        made += 1
    yield from slots.values()


def entries(content: bytes) -> Iterator[tuple]:
    """(list, at, node, title, kind, text, items, kids) of the dictionaries in a file's arrays, references replaced by what
    they name, up to HOPS of them from an indirect object; what leads nowhere, or round in a ring, is left out. The first has
    no list, and its kids are the fields array, or nothing. Arrays and dictionaries are told by their nodes."""
    every = list(nodes(content))
    numbered = {str(n[3]): n for n in every if n[3] >= 0}

    def there(n: tuple) -> tuple | None:
        for _ in range(HOPS + 1):
            if n is None or n[4] != "ref":
                return n
            n = numbered.get(n[5])
        return n if n and n[4] != "ref" else None

    held: dict[int, dict[str, tuple]] = {}
    for n in every:
        if n[1] >= 0 and (t := there(n)):
            held.setdefault(n[1], {})[n[2]] = t

    def slot(node: int, name: str, *kinds: str) -> tuple | None:
        found = held.get(node, {}).get(name)
        return found if found and found[4] in kinds else None

    roots = [n[0] for n in every if n[1] == -1 and n[4] == "dict"]
    tops = (slot(f[0] if (f := slot(r, "FDF", "dict")) else r, "Fields", "list") for r in sorted(roots))
    top = next(filter(None, tops), None)
    yield None, None, None, None, None, None, None, top and top[0]
    for parent in (n[0] for n in every if n[4] == "list"):
        for at, n in held.get(parent, {}).items():
            if n[4] == "dict":
                title, value, kids = slot(n[0], "T", "string"), slot(n[0], "V", "string", "name", "list"), slot(n[0], "Kids", "list")
                items = [i[5] for i in held.get(value[0], {}).values() if i[4] in ("string", "name")] if value and value[4] == "list" else None
                yield parent, int(at), n[0], title and title[5], value and value[4], value and value[5], items, kids and kids[0]


ENTRIES = "list int, at int, node int, title string, kind string, text string, items array<string>, kids int, problem string"


def file_entries(files: DataFrame) -> DataFrame:
    """(file, list, at, node, title, kind, text, items, kids, problem) of files (file, content), as entries() has them; a
    file that can't be read is one row with its problem. Files are dealt out to as many parts as there is work for."""
    made = to_arrow_schema(_parse_datatype_string(ENTRIES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            of, rows = [], []
            for k, content in enumerate(batch.column("content").to_pylist()):
                try:
                    own = [(*e, None) for e in entries(content or b"")]
                except Unreadable as problem:
                    own = [(*[None] * 8, str(problem))]
                of += [k] * len(own)
                rows += own
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file").take(pa.array(of)), *columns], names=["file", *made.names])

    return dealt(files.select("file", "content"), "file").mapInArrow(run, f"file {dict(files.dtypes)['file']}, {ENTRIES}")


def form_fields(files: DataFrame) -> DataFrame:
    """(file, place, name, kind, value, items, problem) of the fields that have a value in files (file, content).

    Names of fields below others are joined by points. kind is text, flag (value `true` for /Yes, `false` for /Off), state
    (another name) or list (its strings and names in items); other values are no form values. place numbers the fields of
    a file from 0, parents first. A dictionary is read once, where it is met first, level by level. A file that can't be
    read, or has no fields array, is one row with the problem.
    """
    every = settled(file_entries(files))
    heads, below = every.where("list is null"), every.where("list is not null").drop("problem").withColumnRenamed("kids", "own_kids")
    front = heads.where("kids is not null").select("file", F.col("kids").alias("list"), F.lit("").alias("above"), F.array().cast("array<int>").alias("path"))
    levels, seen = [], None
    for _ in range(DEEPEST + 1):
        if front.isEmpty():
            break
        met = front.join(below, ["file", "list"]).select("file", "node", F.struct(F.concat("path", F.array("at")).alias("path"), "above", "title", "kind", "text", "items", F.col("own_kids").alias("list")).alias("m"))
        met = met.groupBy("file", "node").agg(F.min("m").alias("m"))
        own = (met if seen is None else met.join(seen, ["file", "node"], "left_anti")).select("file", "node", "m.*")
        name = F.when(F.col("title").isNull(), F.col("above")).when(F.col("above") == "", F.col("title")).otherwise(F.concat("above", F.lit("."), "title"))
        own = settled(own.select("file", "node", "path", name.alias("name"), F.col("title").isNotNull().alias("titled"), "kind", "text", "items", "list"))
        levels.append(own)
        seen = own.select("file", "node") if seen is None else seen.union(own.select("file", "node"))
        front = own.where("list is not null").select("file", "list", F.col("name").alias("above"), "path")
    unread = heads.where("kids is null").select("file", F.lit(None).cast("int").alias("place"), *[F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("kind", "string"), ("value", "string"), ("items", "array<string>"))], F.coalesce("problem", F.lit("no fields")).alias("problem"))
    if not levels:
        return unread
    valued = levels[0]
    for level in levels[1:]:
        valued = valued.union(level)
    whole = valued.where("titled and kind is not null")
    text, kind = F.col("text"), F.col("kind")
    is_flag = (kind == "name") & text.isin("Yes", "Off")
    place = F.row_number().over(Window.partitionBy("file").orderBy("path")) - 1
    made = whole.select(
        "file", place.alias("place"), "name", F.when(is_flag, "flag").when(kind == "name", "state").when(kind == "list", "list").otherwise("text").alias("kind"),
        F.when(is_flag, (text == "Yes").cast("string")).when(kind != "list", text).alias("value"),
        F.when(kind == "list", F.col("items")).alias("items"), F.lit(None).cast("string").alias("problem"),
    )
    return made.union(unread)


def escaped(text: Column) -> Column:
    """A text as a literal string of a file: Latin-1's common part as it is, with its marks escaped; else UTF-16, in octal."""
    plain = F.regexp_replace(text, r"([\\()])", r"\\$1")
    for c, e in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        plain = F.replace(plain, F.lit(c), F.lit(f"\\{e}"))
    octets = F.regexp_extract_all(F.hex(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))), F.lit("[0-9A-F]{2}"), F.lit(0))
    wide = F.array_join(F.transform(octets, lambda h: F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0"))), "")
    return F.concat(F.lit("("), F.when(text.rlike(r"\A[\x09\x0a\x0d\x20-\x7e]*\z"), plain).otherwise(wide), F.lit(")"))


def escaped_name(text: Column) -> Column:
    """A text as a name: bytes of UTF-8 that a name can't show are written as #xx."""
    octets = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    shown = lambda h: F.char(F.conv(h, 16, 10).cast("int"))
    return F.array_join(F.transform(octets, lambda h: F.when(shown(h).rlike(r"[\x21-\x7e&&[^()<>\[\]{}/%#]]") & (h < "7F"), shown(h)).otherwise(F.concat(F.lit("#"), F.lower(h)))), "")


def form_file(fields: DataFrame) -> DataFrame:
    """(file, content): a form data file of the fields (file, place, name, kind, value, items), as form_fields reads them."""
    value = (
        F.when(F.col("kind") == "flag", F.when(F.col("value") == "true", F.lit("/Yes")).otherwise(F.lit("/Off")))
        .when(F.col("kind") == "state", F.concat(F.lit("/"), escaped_name(F.col("value"))))
        .when(F.col("kind") == "list", F.concat(F.lit("[ "), F.array_join(F.transform("items", escaped), " "), F.lit(" ]")))
        .otherwise(escaped(F.col("value")))
    )
    line = F.concat(F.lit("<< /T "), escaped(F.col("name")), F.lit(" /V "), value, F.lit(" >>"))
    listed = fields.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    parts = [F.lit(f"{HEADER}\n1 0 obj\n<< /FDF << /Fields [\n"), body, F.lit("\n] >> >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n")]
    return listed.select("file", F.encode(F.concat(*parts), "UTF-8").alias("content"))
