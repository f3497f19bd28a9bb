"""Canonical exact digests of documents, in DataFrame functions only.

A text is brought to canonical form: compatibility decomposition, case folding, marks in canonical order, white space
folded. So texts that Unicode holds for compatible without regard to case have one form (NFKD of the folded NFKD). Spark
has no normaliser: a table from the Unicode data of the driver's Python gives each character's folded decomposition,
looked up by code point in two steps; Hangul syllables are taken apart by arithmetic; runs of marks are sorted by class.
Texts of ASCII and the Latin letters U+00C0 to U+0131 alone need none of that: `lower` does, and in other texts these
letters are put together again, so that both ways end alike.

A fingerprint is a wide xxhash: two 64-bit hashes of independent seeds. Texts with equal hashes are compared byte by
byte, by grouping on hash and canonical text together; where one hash stands for different texts, their fingerprints are
told apart by a SHA-256.

Defined results: a null text counts as empty; repeated rows come back repeated; an empty table gives an empty result;
rows with equal doc_id follow each other by the hash of their text. What is no character in the driver's Unicode version
stands for itself. A text of any length is normalised whole, in its own row.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_narrow, let, text_of
from .order import bucket_bounds, bucket_of

PLAIN = r"[^\x00-\x7fÀ-ı]"
# Fixed value: what Unicode calls white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
FOLDABLE = f" [{WHITE}]+|[{WHITE}&&[^ ]][{WHITE}]*"
IOTA = "\u0345"  # the one mark that folding makes a letter of: only after marks are in order
# The ranges of Hangul syllables and of the letters they are made of.
HANGUL, LEAD, VOWEL, TAIL = 0xAC00, 0x1100, 0x1161, 0x11A7
LEADS, VOWELS, TAILS = 19, 21, 28


def _folded(c: str) -> str:
    apart = "".join(x if x == IOTA else x.casefold() for x in unicodedata.normalize("NFKD", c))
    return unicodedata.normalize("NFKD", apart)


@lru_cache(maxsize=1)
def _tables() -> tuple[list[list[str | None]], list[list[int]], str, list[list[str]]]:
    """Folded decompositions and mark classes by code point (blocks of 256, empty where all stand for themselves), the
    marks as the inside of a character class, and letters of U+00E0 to U+0131 taken apart and whole."""
    forms, classes, marks = [], [], []
    own = lambda x: 0xD800 <= x < 0xF900 or HANGUL <= x < HANGUL + LEADS * VOWELS * TAILS  # noqa: E731 - no characters, or taken apart by arithmetic
    for block in range(0, 0x110000, 256):
        points = range(block, block + 256)
        forms.append([None if own(x) or (f := _folded(chr(x))) == chr(x) else f for x in points])
        classes.append([0 if own(x) else unicodedata.combining(chr(x)) for x in points])
        forms[-1] = forms[-1] if any(x is not None for x in forms[-1]) else []
        marks += [x for x, k in zip(points, classes[-1], strict=True) if k]
        classes[-1] = classes[-1] if any(classes[-1]) else []
    runs: list[list[int]] = []
    for x in marks:
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    inside = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)
    letters = [[unicodedata.normalize("NFD", chr(x)), chr(x)] for x in range(0xE0, 0x132) if chr(x).islower() and unicodedata.decomposition(chr(x))]
    last = max(k for k, x in enumerate(forms) if x) + 1
    return forms[:last], classes[:last], inside, letters


def _constant(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _at(table: Column, point: Column) -> Column:
    return F.get(F.get(table, F.shiftright(point, 8)), point.bitwiseAND(F.lit(255)))


def _apart(text: Column) -> Column:
    """Each character's folded decomposition."""
    forms = _constant(_tables()[0], "array<array<string>>")
    jamo = lambda first, count: F.array(*[F.lit(chr(first + k)) if first + k != TAIL else F.lit("") for k in range(count)])

    def one(c: Column) -> Column:
        point = F.ascii(c)
        k = point - HANGUL
        hangul = F.concat(F.get(jamo(LEAD, LEADS), F.floor(k / (VOWELS * TAILS)).cast("int")), F.get(jamo(VOWEL, VOWELS), F.floor(k / TAILS).cast("int") % VOWELS), F.get(jamo(TAIL, TAILS), k % TAILS))
        return F.when((k >= 0) & (k < LEADS * VOWELS * TAILS), hangul).otherwise(F.coalesce(_at(forms, point), c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _ordered(text: Column) -> Column:
    """Runs of marks sorted by their class, equal ones as they stood."""
    _, by_point, inside, _ = _tables()
    classes, runs = _constant(by_point, "array<array<int>>"), f"[{inside}]{{2,}}"
    place = lambda c, i: F.struct(_at(classes, F.ascii(c)).alias("class"), i.alias("i"), c.alias("c"))
    found = F.transform(F.regexp_extract_all(text, F.lit(runs), F.lit(0)), lambda r: F.array_join(F.transform(F.sort_array(F.transform(F.split(r, ""), place)), lambda x: x["c"]), ""))
    joined = F.array_join(F.zip_with(F.split(text, runs, -1), found, lambda gap, run: F.concat(gap, F.coalesce(run, F.lit("")))), "")
    return F.when(text.rlike(runs), joined).otherwise(text)


def _letters_whole(text: Column) -> Column:
    pairs = _constant(_tables()[3], "array<array<string>>")
    joined = lambda t: F.aggregate(pairs, t, lambda acc, p: F.replace(acc, F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    return let(text, lambda t: F.when(t.rlike("[a-z][\u0300-\u0328]"), joined(t)).otherwise(t))


def canonical(text: Column) -> Column:
    """The canonical form of a text that is not null."""
    simple = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    whole = let(let(_apart(text), _ordered), lambda t: _letters_whole(F.replace(t, F.lit(IOTA), F.lit("ι"))))
    normal = F.when(text.rlike(PLAIN), whole).otherwise(simple)
    return F.trim(F.regexp_replace(normal, FOLDABLE, " "))


def wide_hash(canon: Column) -> Column:
    """32 hexadecimal digits."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit("second"), canon)))


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each canonical text: its wide hash h, SHA-256 s, number of rows and smallest doc_id.

    Grouping is by hash and text, so equal hashes are compared byte by byte; copies meet before the shuffle.
    """
    canon = canonical(text_of(F.col(f"`{text}`")))
    made = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), canon.alias("canon"))
    made = made.select("doc_id", "canon", wide_hash(F.col("canon")).alias("h"))
    groups = made.groupBy("h", "canon").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    return groups.select("h", F.sha2("canon", 256).alias("s"), "copies", "first")


def shared_hashes(classes: DataFrame) -> DataFrame:
    """The hashes that stand for more than one canonical text."""
    return classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def with_next(docs: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    """Add the text of the next row in descending doc_id; the last is followed by the first.

    Rows are dealt into runs of doc_id of about equal counts. The first row of each run is also sent to the end of the
    run before it, so a window over one run finds every successor; the list of first rows has one row a run.
    """
    spark = docs.sparkSession
    runs = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(f"`{doc_id}`").cast("long")
    placed = docs.withColumns({"__text": text_of(F.col(f"`{text}`")), "__id": key})
    placed = placed.withColumns({"__run": bucket_of(F.col("__id"), bucket_bounds(placed, "__id", runs)), "__hash": F.xxhash64("__text")})
    place = F.struct(F.coalesce("__id", F.lit(-(1 << 63))).alias("id"), F.col("__hash").alias("h"))
    tops = sorted((r["__run"], r["top"]) for r in placed.groupBy("__run").agg(F.max(place).alias("top")).collect())
    before = [(run, top["id"], top["h"], tops[(k + 1) % len(tops)][0]) for k, (run, top) in enumerate(tops)]
    heads = spark.createDataFrame(before or [(-1, 0, 0, -1)], "__run int, __top long, __top_hash long, __ghost int")
    both = placed.join(F.broadcast(heads), "__run")
    is_top = (place["id"] == F.col("__top")) & (place["h"] == F.col("__top_hash"))
    own = F.struct(F.col("__run").alias("run"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.col("__ghost").alias("run"), F.lit(1).alias("ghost"))
    both = both.withColumn("__at", F.explode(F.when(is_top, F.array(own, ghost)).otherwise(F.array(own))))
    w = Window.partitionBy("__at.run").orderBy("__at.ghost", F.col("__id").desc_nulls_last(), F.col("__hash").desc())
    after = both.select(*docs.columns, "__at", "__id", "__hash", "__text").withColumn(name, F.lead("__text").over(w))
    return after.where(F.col("__at.ghost") == 0).drop("__at", "__id", "__hash", "__text")


def digest_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    An exact digest knows only equal and different, so a likeness is 1 or 0; equal hashes are checked by their texts.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    shared = cut_narrow(shared_hashes(exact_classes(narrow)))
    both = with_next(narrow, "doc_id", "text", "__next")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("__edited", F.concat(F.left("text", n - half), F.left("__next", half)))
    both = both.withColumns({"n_chars": n.cast("long"), "edited_sha256": F.sha2("__edited", 256)})
    both = both.withColumns({"__c": canonical(F.col("text")), "__ce": canonical(F.col("__edited")), "__cn": canonical(F.col("__next"))})
    hashes = {"fingerprint": wide_hash(F.col("__c")), "edited_fingerprint": wide_hash(F.col("__ce"))}
    same = lambda a, b: F.when(F.xxhash64(a) == F.xxhash64(b), F.col(a) == F.col(b)).otherwise(False).cast("double")
    out = both.withColumns(hashes | {"near_edited": same("__c", "__ce"), "near_next": same("__c", "__cn")})
    if not shared.isEmpty():
        for column, canon in (("fingerprint", "__c"), ("edited_fingerprint", "__ce")):
            out = out.join(shared.withColumn("__two", F.lit(True)), F.col(column) == F.col("h"), "left").drop("h")
            out = out.withColumn(column, F.when(F.col("__two"), F.concat(column, F.sha2(canon, 256))).otherwise(F.col(column))).drop("__two")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
