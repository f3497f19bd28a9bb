"""Comments as XFDF: files written from annotation rows, and read back to marks with their replies and review states.

An element is a row throughout: XML is written by column functions and parsed by Spark's own reader, and what answers what
follows by joins over all files at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.dates import review_seconds
from quire.operators.graph import roots, settled

# Annotation subtypes and their elements, the states of a review, and the namespace.
ELEMENTS = {
    "Highlight": "highlight", "Underline": "underline", "StrikeOut": "strikeout", "Squiggly": "squiggly", "Ink": "ink",
    "Square": "square", "Circle": "circle", "Line": "line", "Text": "text", "FreeText": "freetext",
}
MARKUP, SHAPES = ("highlight", "underline", "strikeout", "squiggly"), ("square", "circle", "line")
STATES = ("Accepted", "Rejected", "Cancelled", "Completed", "None")
NAMESPACE = "http://ns.adobe.com/xfdf/"


def number_text(value: Column) -> Column:
    """A number with at most three decimals."""
    text = F.regexp_replace(F.regexp_replace(F.round(value, 3).cast("decimal(38,3)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def _list_text(values: Column) -> Column:
    return F.array_join(F.transform(values, number_text), ",")


def xml_escaped(text: Column) -> Column:
    """Text as XML holds it; control characters, which it can't, go."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def file_date(text: Column) -> Column:
    """A date as files write it: one that is already stays, one of ISO 8601 is written in UTC, anything else is empty."""
    at = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())
    return F.when(text.startswith("D:"), text).otherwise(F.coalesce(F.date_format(at, "'D:'yyyyMMddHHmmss'Z'"), F.lit("")))


def comment_files(annotations: DataFrame) -> DataFrame:
    """(file, content, written, skipped): an XFDF file of each file's annotations (file, ord, name, subtype, page, rect,
    contents, title, modified, created, colour, opacity, width, coords, strokes, ends, parent, state, state_model), y upwards.

    Popups belong to their comments; other subtypes that the format doesn't carry, and annotations without a rectangle, are
    skipped. Answers are written, but not counted as comments.
    """
    element = F.create_map(*[F.lit(x) for pair in ELEMENTS.items() for x in pair])[F.col("subtype")]
    own = annotations.where("subtype <> 'Popup' or subtype is null").withColumn("element", F.when(F.col("rect").isNotNull(), element))
    answer, state = F.col("parent").isNotNull(), F.col("state")
    r = F.col("rect")
    rect = F.array(F.least(r[0], r[2]), F.least(r[1], r[3]), F.greatest(r[0], r[2]), F.greatest(r[1], r[3]))
    end = lambda k: F.concat_ws(",", *[number_text(F.coalesce(F.get("ends", F.lit(j)), F.lit(0.0))) for j in (k, k + 1)])
    flags = F.when(answer, F.when(state.isNull(), "print,nozoom,norotate").otherwise("hidden,print,nozoom,norotate"))
    is_line = F.col("element") == "line"
    values = {
        "page": F.col("page").cast("string"), "rect": _list_text(rect), "name": F.col("name"), "title": F.col("title"), "date": file_date(F.col("modified")),
        "creationdate": file_date(F.col("created")), "color": F.upper("colour"), "opacity": number_text(F.col("opacity")), "width": number_text(F.col("width")),
        "inreplyto": F.col("parent"), "state": state, "statemodel": F.when(state.isNotNull(), F.coalesce("state_model", F.lit("Review"))), "flags": flags,
        "coords": F.when(~F.col("element").isin("text", "freetext"), _list_text(F.col("coords"))), "start": F.when(is_line, end(0)), "end": F.when(is_line, end(2)),
        "icon": F.when(F.col("element") == "text", "Comment"),
    }
    shown = [F.when((v != "") & v.isNotNull(), F.concat(F.lit(f' {k}="'), xml_escaped(v), F.lit('"'))).otherwise("") for k, v in values.items()]
    pairs = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / 2).cast("int") - 1), lambda k: F.concat_ws(",", number_text(F.get(s, 2 * k)), number_text(F.get(s, 2 * k + 1))))
    gesture = lambda s: F.concat(F.lit("<gesture>"), F.when(F.size(s) > 1, F.array_join(pairs(s), ";")).otherwise(""), F.lit("</gesture>"))
    strokes = F.coalesce("strokes", F.array().cast("array<array<double>>"))
    inner = F.when(F.col("element") == "ink", F.concat(F.lit("<inklist>"), F.array_join(F.transform(strokes, gesture), ""), F.lit("</inklist>"))).otherwise("")
    contents = F.coalesce("contents", F.lit(""))
    body = F.concat(inner, F.when(contents == "", "").otherwise(F.concat(F.lit("<contents>"), xml_escaped(contents), F.lit("</contents>"))))
    tag = lambda close: F.concat(F.lit("</" if close else "<"), F.col("element"))
    whole = F.when(body == "", F.concat(tag(False), *shown, F.lit("/>"))).otherwise(F.concat(tag(False), *shown, F.lit(">"), body, tag(True), F.lit(">")))
    listed = own.groupBy("file").agg(
        F.sort_array(F.collect_list(F.when(F.col("element").isNotNull(), F.struct("ord", whole.alias("xml"))))).alias("l"),
        F.count(F.when(F.col("element").isNotNull() & ~answer, 1)).alias("written"), F.count(F.when(F.col("element").isNull(), 1)).alias("skipped"),
    )
    head, tail = f'<?xml version="1.0" encoding="UTF-8"?>\n<xfdf xmlns="{NAMESPACE}" xml:space="preserve"><annots>', "</annots></xfdf>\n"
    return listed.select("file", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["xml"]), "\n"), F.lit(tail)).alias("content"), "written", "skipped")


ATTRIBUTES = "page rect name title date creationdate color opacity width coords start end inreplyto replyType state statemodel contents".split()
ELEMENT = f"struct<{', '.join(f'`_{a}`: string' for a in ATTRIBUTES)}, contents: string, `contents-richtext`: string, defaultappearance: string, inklist: struct<gesture: array<string>>>"
OTHERS = ("stamp", "caret", "polygon", "polyline", "fileattachment", "sound", "redact", "link", "popup")


def numbers(text: Column) -> Column:
    """The numbers of a list parted by white space, commas or semicolons; parts that begin with none are left out."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![^\s,;])[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"), F.lit(0))
    return F.transform(parts, lambda p: p.cast("double"))


def comment_elements(files: DataFrame) -> DataFrame:
    """(file, ord, element, the attributes, contents, gestures, appearance, problem) of XFDF files (file, content): one row
    an element, or one with the problem of a file that isn't XFDF."""
    names = [*ELEMENTS.values(), *OTHERS]
    schema = f"annots struct<{', '.join(f'{n}: array<{ELEMENT}>' for n in names)}>, _corrupt_record string"
    bare = F.regexp_replace(F.coalesce("content", F.lit("")), "^\ufeff", "")
    head = bare.rlike(r"\A\s*(<\?xml[^>]*\?>\s*)?(<!--(?s:.)*?-->\s*)*<xfdf[\s>]")
    options = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}
    read = files.select("file", head.alias("head"), F.from_xml(bare, schema, options).alias("x"))
    broken = ~F.col("head") | F.col("x").isNull() | F.col("x._corrupt_record").isNotNull()
    def listed(at: int, name: str) -> Column:
        own = F.coalesce(F.col(f"x.annots.{name}"), F.array().cast(f"array<{ELEMENT}>"))
        return F.transform(own, lambda e, k: F.struct((F.lit(at * 1_000_000_000) + k).cast("long").alias("ord"), F.lit(name).alias("element"), e.alias("e")))

    each = F.concat(*[listed(at, name) for at, name in enumerate(names)])
    rows = read.select("file", broken.alias("broken"), F.explode_outer(F.when(~broken, each)).alias("r")).where("broken or r is not null")
    rich = F.trim(F.regexp_replace("r.e.contents-richtext", r"<[^>]*>", ""))
    return rows.select(
        "file", "r.ord", "r.element", *[F.col(f"r.e._{a}").alias(a) for a in ATTRIBUTES if a != "contents"], F.coalesce("r.e.contents", rich, "r.e._contents", F.lit("")).alias("contents"),
        F.col("r.e.inklist.gesture").alias("gestures"), F.coalesce("r.e.defaultappearance", F.lit("")).alias("appearance"), F.when(F.col("broken"), "not XFDF").alias("problem"),
    )


def _marks(elements: DataFrame) -> DataFrame:
    """The elements that stand for marks, with what is read off each; `usable` is false for what can't be one."""
    element, rect = F.col("element"), numbers(F.col("rect"))
    ordered = F.array(F.least(rect[0], rect[2]), F.least(rect[1], rect[3]), F.greatest(rect[0], rect[2]), F.greatest(rect[1], rect[3]))
    width = F.get(numbers(F.col("width")), F.lit(0))
    half = F.greatest(F.coalesce(width, F.lit(2.0)), F.lit(0.0)) / 2
    base = elements.withColumns({"box": F.when(F.size(rect) > 3, ordered), "stroke": width, "strokes": F.filter(F.transform("gestures", numbers), lambda s: (F.size(s) > 3) & (F.size(s) % 2 == 0))})
    b = F.col("box")
    inset = lambda k: F.least(half, (b[k + 2] - b[k]) / 2)
    inner = F.array(b[0] + inset(0), b[1] + inset(1), b[2] - inset(0), b[3] - inset(1))
    coords = numbers(F.col("coords"))
    corner = lambda q, of, odd: of(F.array(*[F.get(coords, 8 * q + 2 * j + odd) for j in range(4)]))
    quads = F.transform(F.sequence(F.lit(0), F.floor(F.size(coords) / 8).cast("int") - 1), lambda q: F.array(corner(q, F.array_min, 0), corner(q, F.array_min, 1), corner(q, F.array_max, 0), corner(q, F.array_max, 1)))
    start, end = numbers(F.col("start")), numbers(F.col("end"))
    ends = F.when((element == "line") & (F.size(start) > 1) & (F.size(end) > 1), F.concat(F.slice(start, 1, 2), F.slice(end, 1, 2)))
    ink = F.regexp_extract_all("appearance", F.lit(r"([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+rg"), F.lit(0))
    shades = F.transform(numbers(F.regexp_replace(ink[0], " rg$", "")), lambda v: F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 255 + 0.5))).cast("long")), 2, "0")))
    given = F.lower(F.trim("color"))
    colour = F.when(element == "freetext", F.when(F.size(ink) > 0, F.concat(F.lit("#"), F.array_join(shades, ""))).otherwise("#000000"))
    colour = colour.when(given.rlike("^#[0-9a-f]{6}$"), given).when(element == "highlight", "#ffd400").otherwise("#e5484d")
    usable = element.isin(*ELEMENTS.values()) & b.isNotNull() & ((element != "ink") | (F.size("strokes") > 0)) & ((element != "line") | ends.isNotNull()) & ((element != "freetext") | (F.trim("contents") != ""))
    page = F.regexp_extract(F.coalesce("page", F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int")
    opacity = F.get(numbers(F.col("opacity")), F.lit(0))
    made = {
        "kind": F.when(element.isin(*SHAPES), "shapes").when(element == "text", "note").otherwise(element), "shape": F.when(element.isin(*SHAPES), element),
        "page_known": F.col("page").isNotNull(), "page": F.when(page >= 0, page).otherwise(0), "colour": colour, "opacity": F.when(opacity.isNull(), 1.0).otherwise(F.least(F.greatest(opacity, F.lit(0.02)), F.lit(1.0))),
        "width": F.when(element.isin("ink", "square", "circle"), 2 * half).otherwise(width),
        "boxes": F.when(element.isin(*MARKUP), F.when(F.size(coords) > 7, quads).otherwise(F.array("box"))).when(element.isin("ink", "square", "circle"), F.array(inner)).otherwise(F.array("box")),
        "ends": ends, "font_size": F.regexp_extract("appearance", r"([\d.]+)\s+Tf", 1).try_cast("double"), "created": F.coalesce("creationdate", "date"), "usable": F.coalesce(usable, F.lit(False)),
    }
    return base.withColumns(made)


def read_comments(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The marks of XFDF files (file, content), and what each file held.

    Marks: file, name, kind, shape, page, boxes, ends, strokes, colour, opacity, width, font_size, contents, title, created,
    replies (title, contents, at: oldest first) and review (state, title, at: the latest). y grows upwards. An answer belongs
    to the mark at the end of its chain. Counts: file, marks, skipped, page_unknown, problem. Skipped are elements that are no
    usable mark, marks whose name is taken, answers that lead to no mark, states of other models or unknown, and empty replies.
    """
    every = settled(comment_elements(files).withColumn("id", F.monotonically_increasing_id()))
    answer = F.col("inreplyto").isNotNull() & (F.coalesce("replyType", F.lit("")) != "group")
    is_element = F.col("problem").isNull()
    named = _marks(every.where(is_element & ~answer)).withColumn("name", F.when(F.col("name") != "", F.col("name")).otherwise(F.concat(F.lit("\x00"), F.col("id").cast("string"))))
    first = named.where("usable").groupBy("file", "name").agg(F.min("ord").alias("ord"))
    marks = named.where("usable").join(first, ["file", "name", "ord"])
    key = lambda c: F.concat(F.to_json(F.struct("file")), F.col(c))
    answers = every.where(is_element & answer).withColumns({"key": key("name"), "up": key("inreplyto")})
    tops = marks.select(key("name").alias("node"), F.lit(None).cast("string").alias("parent"))
    below = answers.where("name is not null").groupBy("key").agg(F.max_by("up", "ord").alias("parent")).select(F.col("key").alias("node"), "parent").join(tops.select("node"), "node", "left_anti")
    ends = roots(tops.union(below)).select(F.col("node").alias("up"), F.col("root").alias("top"))
    at = F.coalesce("date", "creationdate")
    state_ok = F.col("state").isin(*STATES) & (F.coalesce("statemodel", F.lit("Review")) == "Review")
    use = F.when(F.col("top").isNull(), "skipped").when(F.col("state").isNotNull(), F.when(state_ok, "review").otherwise("skipped")).when(F.trim("contents") == "", "skipped").otherwise("reply")
    judged = answers.join(ends, "up", "left").withColumns({"use": use, "at": review_seconds(at)})
    who = F.coalesce("title", F.lit("")).alias("title")
    reply = F.sort_array(F.collect_list(F.when(F.col("use") == "reply", F.struct("at", "ord", who, "contents"))))
    review = F.max(F.when(F.col("use") == "review", F.struct("at", "ord", "state", who)))
    threads = judged.where("use <> 'skipped'").groupBy("top").agg(reply.alias("l"), review.alias("v"))
    replies = F.transform(F.coalesce("l", F.array().cast("array<struct<at:bigint,ord:bigint,title:string,contents:string>>")), lambda r: F.struct(r["title"], r["contents"], r["at"].alias("at")))
    found = marks.withColumn("top", key("name")).join(threads, "top", "left").select(
        "file", "name", "kind", "shape", "page", "boxes", "ends", "strokes", "colour", "opacity", "width", "font_size", "contents", F.coalesce("title", F.lit("")).alias("title"), "created",
        replies.alias("replies"), F.when(F.col("v").isNotNull(), F.struct("v.state", "v.title", "v.at")).alias("review"),
    )
    kept = marks.groupBy("file").agg(F.count("*").alias("marks"), F.count(F.when(~F.col("page_known"), 1)).alias("page_unknown"))
    lost = judged.groupBy("file").agg(F.count(F.when(F.col("use") == "skipped", 1)).alias("lost"))
    most = named.groupBy("file").agg(F.count("*").alias("candidates"))
    counts = files.select("file").join(kept, "file", "left").join(lost, "file", "left").join(most, "file", "left").join(every.where("problem is not null").select("file", "problem"), "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found, counts.select("file", zero("marks").alias("marks"), (zero("candidates") - zero("marks") + zero("lost")).alias("skipped"), zero("page_unknown").alias("page_unknown"), "problem")
