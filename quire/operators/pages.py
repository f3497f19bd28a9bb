"""Page-set algebra: ranges, labels, splits, and plans for inserting, replacing, interleaving and printing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.numbers import letters, padded, roman
from quire.functions.text import safe_suffix
from quire.operators.groups import walk_groups

RANGE = r"^\s*(\d*)\s*[-–—]\s*(\d*)\s*$"


def parse_ranges(rows: DataFrame, key: list[str], expr: str = "expr", pages: str = "pages", ordered: bool = False) -> DataFrame:
    """key, place and page (from 1) of expressions such as `1-3, 5, 8-`; open ends reach the first or last page.

    An expression that is empty, malformed, out of bounds, or (unless ordered) not strictly ascending raises an error.
    """
    parts = F.split(F.regexp_replace(F.regexp_replace(F.trim(expr), r"\s*([-–—])\s*", "$1"), r"[,;\s]+", ","), ",")

    def span(part: Column) -> Column:
        low, high = F.regexp_extract(part, RANGE, 1), F.regexp_extract(part, RANGE, 2)
        dash = part.rlike(RANGE) & (part.rlike("[0-9]"))
        first = F.when(dash, F.when(low == "", 1).otherwise(low.try_cast("int"))).otherwise(part.try_cast("int"))
        last = F.when(dash, F.when(high == "", F.col(pages)).otherwise(high.try_cast("int"))).otherwise(part.try_cast("int"))
        good = (first >= 1) & (last <= F.col(pages)) & (first <= last)
        return F.when(good, F.sequence(first, last)).otherwise(F.raise_error(F.concat(F.lit("bad page range: "), F.col(expr))).cast("array<int>"))

    spread = rows.select(*key, expr, F.flatten(F.transform(parts, span)).alias("__pages"))
    p = F.col("__pages")
    sound = (F.size(F.array_distinct(p)) == F.size(p)) if ordered else (p == F.array_sort(F.array_distinct(p)))
    checked = F.when(sound, p).otherwise(F.raise_error(F.concat(F.lit("pages repeat or descend: "), F.col(expr))).cast("array<int>"))
    return spread.select(*key, F.posexplode(checked).alias("place", "page"))


def format_ranges(rows: DataFrame, key: list[str], page: str = "page") -> DataFrame:
    """key and expr: the distinct pages in ascending order, runs as `a-b`, joined by a comma and a space."""
    one = rows.select(*key, page).distinct()
    w = Window.partitionBy(*key).orderBy(page)
    islands = one.withColumn("__island", F.col(page) - F.row_number().over(w))
    runs = islands.groupBy(*key, "__island").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    joined = runs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))).alias("l"))
    return joined.select(*key, F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("expr"))


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """Add chunk, from 0: every `size` pages, and name: its number from 1 padded to the width of the last."""
    if size < 1:
        raise ValueError("a chunk holds one page at least")
    chunk = F.floor(F.col("page") / size).cast("int")
    total = F.ceil(F.col("pages") / size)
    return rows.withColumn("chunk", chunk).withColumn("name", F.concat(F.lit("part-"), padded(F.col("chunk") + 1, F.length(total.cast("string")))))


def split_by_bookmarks(bookmarks: DataFrame, key: list[str], pages: int) -> DataFrame:
    """key, first, last and title of each part: the first bookmark of a page opens one; pages before the first form one
    without a title."""
    w = Window.partitionBy(*key, "page").orderBy("ord")
    first = bookmarks.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    by_page = Window.partitionBy(*key).orderBy("page")
    parts = first.select(*key, F.col("page").alias("first"), (F.lead("page", 1, pages).over(by_page) - 1).alias("last"), "title")
    lead = first.groupBy(*key).agg(F.min("page").alias("m")).where("m > 0")
    return parts.unionByName(lead.select(*key, F.lit(0).alias("first"), (F.col("m") - 1).alias("last"), F.lit(None).cast("string").alias("title")))


def split_by_size(pages: DataFrame, limit: int) -> DataFrame:
    """(doc_id, page, part): pages fill parts up to a limit of bytes, in order; one that is larger stands alone.

    Where a part starts depends on all before, so a document's pages are walked in order.
    """

    def walk(own):
        part, used = 0, 0
        for p in own:
            if used and used + p.bytes > limit:
                part, used = part + 1, 0
            used += p.bytes
            yield p.doc_id, p.page, part

    return walk_groups(pages.select("doc_id", "page", "bytes"), "doc_id", ["page"], walk, "doc_id long, page int, part int")


def insert_plan(rows: DataFrame, at: Column, count: Column) -> DataFrame:
    """The places of a document's pages after `count` others are put in before place `at`, and those of the others."""
    own = rows.select("doc_id", F.lit("own").alias("origin"), "page", F.when(F.col("page") >= at, F.col("page") + count).otherwise(F.col("page")).alias("place"))
    one = rows.select("doc_id", at.alias("at"), count.alias("n")).distinct()
    new = one.select("doc_id", F.lit("new").alias("origin"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page"), "at")
    return own.unionByName(new.select("doc_id", "origin", "page", (F.col("at") + F.col("page")).alias("place")))


def interleave_place(side: Column, sheet: Column, fronts: Column, backs: Column, reverse: bool = False) -> Column:
    """Where a front (side 0) or back (side 1) page lands: in turn while both last, then what is left."""
    pairs = F.least(fronts, backs)
    at = F.when((side == 1) & F.lit(reverse), backs - 1 - sheet).otherwise(sheet)
    return F.when(at < pairs, 2 * at + side).otherwise(pairs + at)


def page_actions(rows: DataFrame, action: str, chosen: Column, target: Column | None = None) -> DataFrame:
    """(doc_id, page, copy, place) after delete, duplicate, move (chosen pages in order before target), reverse, or rotate
    (which adds rotation: chosen pages turn by target, 90 degrees where there is none, from their own rotation)."""
    w = Window.partitionBy("doc_id")
    if action == "delete":
        left = rows.where(~chosen)
        return left.select("doc_id", "page", F.lit(0).alias("copy"), (F.row_number().over(w.orderBy("page")) - 1).alias("place"))
    if action == "duplicate":
        copies = rows.select("doc_id", "page", F.explode(F.when(chosen, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
        return copies.withColumn("place", F.row_number().over(w.orderBy("page", "copy")) - 1)
    if action == "move":
        before = F.when(chosen, 1).when(F.col("page") < target, 0).otherwise(2)
        return rows.select("doc_id", "page", F.lit(0).alias("copy"), (F.row_number().over(w.orderBy(before, "page")) - 1).alias("place"))
    if action == "rotate":
        turn = F.when(chosen, F.lit(90) if target is None else target).otherwise(0)
        turned = (F.pmod((F.col("rotation") if "rotation" in rows.columns else F.lit(0)) + turn, F.lit(360))).cast("int")
        return rows.select("doc_id", "page", F.lit(0).alias("copy"), F.col("page").alias("place"), turned.alias("rotation"))
    if action == "reverse":
        picked = rows.withColumn("__c", chosen)
        up, down = Window.partitionBy("doc_id", "__c").orderBy("page"), Window.partitionBy("doc_id", "__c").orderBy(F.desc("page"))
        ranked = picked.withColumns({"__up": F.row_number().over(up), "__down": F.row_number().over(down)})
        mirror = ranked.where("__c").select("doc_id", F.col("__down").alias("__up"), F.col("page").alias("__to"))
        moved = ranked.where("__c").join(mirror, ["doc_id", "__up"]).select("doc_id", "page", F.lit(0).alias("copy"), F.col("__to").alias("place"))
        return moved.unionByName(ranked.where("not __c").select("doc_id", "page", F.lit(0).alias("copy"), F.col("page").alias("place")))
    raise ValueError(f"unknown action {action!r}")


def label_text(style: Column, prefix: Column, number: Column) -> Column:
    """A page label: decimal, roman, ROMAN, letters or LETTERS after a prefix; other styles have the prefix alone."""
    n = F.greatest(number, F.lit(1))
    body = F.when(style == "decimal", n.cast("string")).when(style == "ROMAN", roman(n)).when(style == "roman", F.lower(roman(n)))
    body = body.when(style == "LETTERS", letters(n)).when(style == "letters", F.lower(letters(n))).otherwise("")
    return F.concat(prefix, body)


def label_lookup(rows: DataFrame, key: list[str], order: list[str], start: Column, value: Column, name: str) -> DataFrame:
    """Add the value of the last row up to this one at which a range starts; null before the first."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(F.when(start, value), ignorenulls=True).over(w))


def compressed(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The rows at which value changes, in order: the starts of run-length ranges."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.where(F.lit(True)).withColumn("__was", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__was"))).drop("__was", "__n")


def label_ranges(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The starts of label ranges: rows (style, prefix, number) whose page doesn't go on from the one before. A page goes
    on in the same style and prefix with the next number; without a style there is nothing to count, and number is 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    same = F.col("style").eqNullSafe(F.lag("style").over(w)) & F.col("prefix").eqNullSafe(F.lag("prefix").over(w))
    goes_on = same & ((F.col("style") == "none") | (F.col("number") == F.lag("number").over(w) + 1))
    marked = rows.withColumns({"__first": F.row_number().over(w) == 1, "__on": F.coalesce(goes_on, F.lit(False))})
    number = F.when(F.col("style") == "none", F.lit(1)).otherwise(F.col("number"))
    return marked.where(F.col("__first") | ~F.col("__on")).withColumn("number", number).drop("__first", "__on")


def booklet(docs: DataFrame) -> DataFrame:
    """(doc_id, sheet, side, cell, page): two pages on each side, folded; pages from 1, null where blank."""
    size = (F.ceil(F.col("pages") / 4) * 4).cast("int")
    sheets = docs.where("pages > 0").select("doc_id", "pages", size.alias("s"), F.explode(F.sequence(F.lit(0), (size / 4).cast("int") - 1)).alias("sheet"))
    i, s = F.col("sheet"), F.col("s")
    cell = lambda side, n, page: F.struct(F.lit(side).alias("side"), F.lit(n).alias("cell"), page.alias("page"))
    cells = F.array(cell("front", 0, s - 2 * i), cell("front", 1, 2 * i + 1), cell("back", 0, 2 * i + 2), cell("back", 1, s - 2 * i - 1))
    flat = sheets.select("doc_id", "pages", "sheet", F.explode(cells).alias("c")).select("doc_id", "sheet", "c.side", "c.cell", "c.page", "pages")
    return flat.withColumn("page", F.when(F.col("page") <= F.col("pages"), F.col("page"))).drop("pages")


def sampled(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, page): all pages where they are few, else the first, the last and, up to the limit, those at steps of the
    last page's number over the limit, rounded. The first and the last are always among them."""
    last = F.col("pages") - 1
    steps = F.slice(F.sequence(F.lit(0), F.lit(max(limit, 1))), F.lit(2), F.lit(max(limit - 2, 0)))
    picks = F.concat(F.array(F.lit(0), last.cast("int")), F.transform(steps, lambda k: F.floor(k * last / limit + 0.5).cast("int")))
    all_pages = F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))
    return docs.where("pages > 0").select("doc_id", F.explode(F.when(F.col("pages") <= limit, all_pages).otherwise(F.array_distinct(picks))).alias("page"))


def positions(left: DataFrame, right: DataFrame, key: str, pages: str = "pages") -> DataFrame:
    """(key, position, side): the page positions of two documents up to the longer one; side is both, left or right."""
    both = left.select(key, F.col(pages).alias("n")).join(right.select(key, F.col(pages).alias("m")), key, "full").fillna(0, ["n", "m"])
    every = both.where("greatest(n, m) > 0").select(key, "n", "m", F.explode(F.sequence(F.lit(0), F.greatest("n", "m").cast("int") - 1)).alias("position"))
    side = F.when(F.col("position") >= F.col("m"), "left").when(F.col("position") >= F.col("n"), "right").otherwise("both")
    return every.select(key, "position", side.alias("side"))


def replaced_pages(rows: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, page, origin, source_page): pages of which target (doc_id, page, source_page) holds a replacement give
    way to it. A target page that isn't there, or that is named twice, raises an error."""
    one = target.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min("source_page").alias("source_page"))
    both = rows.select("doc_id", "page", F.lit(True).alias("there")).join(one, ["doc_id", "page"], "full")
    sound = F.col("there").isNotNull() & (F.coalesce("n", F.lit(1)) == 1)
    origin = F.when(sound, F.when(F.col("n").isNull(), "own").otherwise("new")).otherwise(F.raise_error(F.lit("a page to be replaced is not there, or named twice")).cast("string"))
    return both.select("doc_id", "page", origin.alias("origin"), "source_page")


def merged_documents(docs: DataFrame, key: list[str], order: str, pages: str = "pages") -> DataFrame:
    """Add first: the place of a document's first page where the documents of a key stand one behind the other."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("first", F.coalesce(F.sum(pages).over(w), F.lit(0)))


def composed(picks: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """Add place to picks (key, ord, page), and drop none: pages that their document has (sizes: key, pages) take places
    in order; the place of others is null, as they are refused."""
    both = picks.join(sizes, key, "left").withColumn("__ok", F.coalesce((F.col("page") >= 0) & (F.col("page") < F.col("pages")), F.lit(False)))
    w = Window.partitionBy(*key, "__ok").orderBy("ord")
    return both.withColumn("place", F.when(F.col("__ok"), F.row_number().over(w) - 1)).drop("__ok", "pages")


def halves(rows: DataFrame, landscape: Column, marked: Column) -> DataFrame:
    """Each row as `left` and `right` part where its page is landscape and holds no marks, else as `whole`."""
    parts = F.when(landscape & ~marked, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("whole")))
    return rows.withColumn("part", F.explode(parts))


def sheet_counts(pages: Column, per_sheet: int) -> Column:
    """How many sheets pages take at so many a sheet."""
    return F.ceil(pages / per_sheet).cast("int")


SIGNATURE = 4  # pages of a booklet's signature: two folded sheets


def range_parts(rows: DataFrame) -> DataFrame:
    """(doc_id, part, first, last), from 0, of (doc_id, expr, pages): each range of an expression such as `1-3, 5, 8-` is a
    part. What parse_ranges() refuses of the whole expression (a malformed range, one beyond the pages, pages that repeat or
    descend) raises an error."""
    sound = parse_ranges(rows, ["doc_id"]).select("doc_id").distinct()
    segments = F.filter(F.split(F.regexp_replace(F.trim("expr"), r"\s*([-–—])\s*", "$1"), r"[,;\s]+"), lambda x: x != "")
    spread = rows.select("doc_id", "pages", F.posexplode(segments).alias("part", "expr"))
    placed = parse_ranges(spread, ["doc_id", "part"]).join(sound, "doc_id")
    return placed.groupBy("doc_id", "part").agg((F.min("page") - 1).alias("first"), (F.max("page") - 1).alias("last"))


def refused_bookmarks(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, ord, page, title) of the bookmarks that point beyond the pages of their document (doc_id, pages)."""
    whole = rows.groupBy("doc_id").agg(F.max("pages").alias("pages"))
    return titles.join(whole, "doc_id").where("page is null or page < 0 or page >= pages").select("doc_id", "ord", "page", "title")


def split_plan(rows: DataFrame, mode: str, size: int = 0, titles: DataFrame | None = None, ranges: DataFrame | None = None, base: str = "part", lead_title: str = "") -> DataFrame:
    """(doc_id, part, name, first, last) of rows (doc_id, page, pages), pages from 0.

    Modes: `ranges` (ranges: doc_id, expr), `every` (each `size` pages), `size` (rows have bytes; parts of at most `size`
    bytes), `booklet` (signatures of `size` pages, four if none), `bookmarks` (titles: doc_id, ord, page, title; the first
    bookmark of a page opens a part), `single` and `odd-even`. A part is named by base, its number as wide as the last, and
    the title of its bookmark; odd and even pages by these words.

    A document with a bookmark beyond its pages is refused as a whole: it has no parts, and refused_bookmarks() tells why.
    """
    whole = rows.groupBy("doc_id").agg(F.max("pages").alias("pages"))
    suffix = F.lit("")
    if mode == "odd-even":
        odd = (F.col("page") % 2).cast("int")
        return rows.groupBy("doc_id", odd.alias("part")).agg(F.min("page").alias("first"), F.max("page").alias("last")).select("doc_id", "part", F.when(F.col("part") == 0, "odd").otherwise("even").alias("name"), "first", "last")
    if mode == "bookmarks":
        by_page, w = Window.partitionBy("doc_id", "page").orderBy("ord"), Window.partitionBy("doc_id").orderBy("first")
        sound = titles.join(refused_bookmarks(rows, titles).select("doc_id").distinct(), "doc_id", "left_anti")
        opens = sound.withColumn("rn", F.row_number().over(by_page)).where("rn = 1").select("doc_id", F.col("page").alias("first"), "title")
        lead = opens.groupBy("doc_id").agg(F.min("first").alias("m")).where("m > 0").select("doc_id", F.lit(0).alias("first"), F.lit(lead_title).alias("title"))
        both = opens.unionByName(lead).join(whole, "doc_id")
        parts = both.withColumns({"part": F.row_number().over(w) - 1, "last": F.coalesce(F.lead("first").over(w), "pages") - 1})
        suffix = F.coalesce(safe_suffix(F.col("title")), F.lit(""))
    elif mode == "ranges":
        parts = range_parts(ranges.join(whole, "doc_id"))
    elif mode == "size":
        parts = split_by_size(rows, size).groupBy("doc_id", "part").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    elif mode in ("every", "single", "booklet"):
        own = chunks(rows, 1 if mode == "single" else size or SIGNATURE if mode == "booklet" else size)
        parts = own.groupBy("doc_id", F.col("chunk").alias("part")).agg(F.min("page").alias("first"), F.max("page").alias("last"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    count = F.count("*").over(Window.partitionBy("doc_id"))
    name = F.concat(F.lit(f"{base}-"), padded(F.col("part") + 1, F.length(count.cast("string"))), suffix)
    return parts.select("doc_id", "part", name.alias("name"), "first", "last")
