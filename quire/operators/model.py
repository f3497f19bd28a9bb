"""Operators over a document's model: layers, outlines, fields, annotations, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import utf16_length
from quire.operators.graph import reachable, settled
from quire.operators.sequential import regular_tables


def layer_visibility(layers: DataFrame, members: DataFrame) -> DataFrame:
    """(content, visible) of (layer, base_on, on, off, view) and (content, layer, policy).

    A layer is on by its base state, then by the ON and OFF exceptions, then by what its view usage says. A policy reads
    its members' states: AnyOn (also where none is named), AllOn, AnyOff, AllOff; no member is visible, one that is no
    layer makes it unknown (null).
    """
    state = F.coalesce(F.col("view"), F.when(F.col("off"), False).when(F.col("on"), True).otherwise(F.col("base_on")))
    both = members.join(layers.select("layer", state.alias("state")), "layer", "left")
    named = F.col("layer").isNotNull()
    sums = both.groupBy("content").agg(
        F.first("policy", ignorenulls=True).alias("policy"), F.count(F.when(named, 1)).alias("n"), F.bool_or(named & F.col("state").isNull()).alias("strange"),
        F.bool_or("state").alias("some_on"), F.bool_and("state").alias("all_on"),
    )
    policy = F.coalesce("policy", F.lit("AnyOn"))
    seen = F.when(policy == "AllOn", F.col("all_on")).when(policy == "AnyOff", ~F.col("all_on")).when(policy == "AllOff", ~F.col("some_on")).otherwise(F.col("some_on"))
    return sums.select("content", F.when(F.col("n") == 0, True).when(F.col("strange"), None).otherwise(seen).alias("visible"))


def outline_counts(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(key, total, visible, count) of (key, parent, open): descendants, those that show when the node is open, and the
    number that is stored: visible ones, negative for a closed node.

    A node knows the sums of what lies less than 2 ** k below it, and the node 2 ** k above it; a round adds the sums of
    the nodes 2 ** k below and doubles both, so n levels need about log n rounds. A parent that isn't there is none;
    nodes in a circle are refused.
    """
    there = nodes.select(F.col("key").alias("parent"), F.lit(True).alias("there"))
    one = F.lit(1).cast("long")
    start = nodes.join(there, "parent", "left").select("key", "open", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(True).alias("clear"), one.alias("total"), one.alias("shown"))
    at = settled(start)
    for _ in range(rounds):
        if not at.where("up is not null").limit(1).count():
            visible = F.col("shown") - 1
            return at.select("key", (F.col("total") - 1).alias("total"), visible.alias("visible"), F.when(F.col("open"), visible).otherwise(-visible).alias("count"))
        seen = F.when(F.col("clear"), 1 + F.when(F.col("open"), F.col("shown") - 1).otherwise(0)).otherwise(0)
        more = at.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("total").alias("more"), F.sum(seen).alias("more_shown"))
        above = at.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("open").alias("up_open"), F.col("clear").alias("up_clear"))
        both = at.join(more, "key", "left").join(above, "up", "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        at = settled(both.select("key", "open", F.col("up2").alias("up"), (F.col("clear") & F.col("up_open") & F.col("up_clear")).alias("clear"), plus("total", "more"), plus("shown", "more_shown")))
    raise ValueError("nodes hang in a circle")


def bound_sync(fields: DataFrame, bindings: DataFrame) -> DataFrame:
    """(path, status, value) of fields (name, value) bound by name to data leaves (path, stored): changed, unchanged or
    skipped. Of fields that share a name the one with a value counts; a leaf without one is skipped."""
    one = fields.groupBy("name").agg(F.max(F.nullif(F.col("value"), F.lit(""))).alias("value"), F.count("*").alias("n"))
    both = bindings.join(one, "name", "left")
    status = F.when(F.col("n").isNull(), "skipped").when(F.coalesce("value", F.lit("")) == F.coalesce("stored", F.lit("")), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"), F.when(status == "changed", F.coalesce("value", F.lit(""))).otherwise(F.col("stored")).alias("value"))


def cascade(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of everything that goes with the seeds: popups of what goes, replies to it, and owners of popups that go;
    from (id, kind, parent, reply_to)."""
    popups = records.where("kind = 'Popup' and parent is not null")
    edges = popups.select(F.col("parent").alias("src"), F.col("id").alias("dst")).union(popups.select("id", "parent"))
    edges = edges.union(records.where("reply_to is not null").select("reply_to", "id"))
    return reachable(seeds.select(F.col("id").alias("node")), edges).select(F.col("node").alias("id"))


def bytes_fate(before: Column, after: Column) -> Column:
    """Whether signed bytes are unchanged, appended to, or rewritten."""
    return F.when(before == after, "unchanged").when(F.startswith(after, before), "appended").otherwise("rewritten")


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The stored rows, with those of the same key replaced by new ones, and further new ones."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def smallest_region(words: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """Add region to words (x, y): the smallest region (x0, y0, x1, y1) of the key that holds the point, else -1."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    best = words.join(regions, key).where(inside).groupBy(*key, "word").agg(F.min(F.struct(area.alias("area"), F.col("region").alias("r"))).alias("m"))
    return words.join(best, [*key, "word"], "left").select(*key, "word", F.coalesce(F.col("m.r"), F.lit(-1)).alias("region"))


def distances(seeds: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(node, distance) up to `most` steps, as trust paths are bounded."""
    return reachable(seeds, edges, most)


def table_rule(cells: DataFrame) -> DataFrame:
    """(table, reason, count) of (table, row, ord, role, scope, headers, id, row_span, col_span): no header cell; header
    cells with neither scope nor a cell that names them; data cells without headers in a table that isn't regular."""
    heads = cells.groupBy("table").agg(F.count(F.when(F.col("role") == "TH", 1)).alias("n"))
    none = heads.where("n = 0").select("table", F.lit("headers").alias("reason"), F.lit(0).cast("long").alias("count"))
    named = cells.select("table", F.explode("headers").alias("id")).distinct()
    bare = cells.where("role = 'TH' and scope is null").join(named, ["table", "id"], "left_anti")
    uneven = regular_tables(cells.select("table", "row", "ord", "row_span", "col_span")).where("not regular").select("table")
    lacking = cells.where("role <> 'TH' and coalesce(size(headers), 0) < 1").join(uneven, "table", "left_semi")
    counted = lambda rows, reason: rows.groupBy("table").agg(F.count("*").alias("count")).select("table", F.lit(reason).alias("reason"), "count")
    return none.unionByName(counted(bare, "scope")).unionByName(counted(lacking, "regular"))


def line_segments(pieces: DataFrame, key: list[str], gap: float = 1.2) -> DataFrame:
    """key, segment, text and x0 of (x0, x1, size, text) pieces on a line: a gap of over 1.2 times the size ends one."""
    w = Window.partitionBy(*key).orderBy("x0")
    new = F.when(F.col("x0") - F.lag("x1").over(w) > gap * F.col("size"), 1).otherwise(0)
    marked = pieces.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = marked.groupBy(*key, "segment").agg(F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("l"))
    return joined.select(*key, "segment", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"), F.col("l")[0]["x0"].alias("x0"))


def enclosing(objects: DataFrame, offsets: DataFrame, key: list[str]) -> DataFrame:
    """(key, id, at) of offsets (key, id, offset): the last object (key, object, offset) that begins at or before it, or
    `byte n` where none does."""
    both = objects.select(*key, "offset", F.col("object"), F.lit(0).alias("kind"), F.lit(None).cast(dict(offsets.dtypes)["id"]).alias("id"))
    both = both.unionByName(offsets.select(*key, "offset", F.lit(None).cast(dict(objects.dtypes)["object"]).alias("object"), F.lit(1).alias("kind"), "id"))
    w = Window.partitionBy(*key).orderBy("offset", "kind", "object").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("in", F.last("object", ignorenulls=True).over(w)).where("kind = 1")
    return found.select(*key, "id", F.coalesce(F.col("in").cast("string"), F.concat(F.lit("byte "), F.col("offset").cast("string"))).alias("at"))


def orphans(objects: DataFrame, references: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """Objects (key, kind) that no reference (key) names, but for kinds that need none."""
    own = objects.where(~F.col("kind").isin(*exempt)) if exempt else objects
    return own.join(references.select("key").distinct(), "key", "left_anti")


def edge_marks(words: DataFrame, width: Column, band: float = 0.03) -> DataFrame:
    """Add mark to words (text, x0, x1): whether a word of one or two characters lies in the outer 3 % of the page."""
    low, high = F.col("x0") < band * width, F.col("x1") > width - band * width
    return words.withColumn("mark", (utf16_length(F.col("text")) <= 2) & (low | high))


def confidence_report(words: DataFrame, key: list[str], low: float = 60, doubtful: float = 10) -> DataFrame:
    """key, words, low and doubtful: how many words there are, how many of low confidence, and whether any is doubtful."""
    return words.groupBy(*key).agg(F.count("*").alias("words"), F.count(F.when(F.col("confidence") < low, 1)).alias("low"), F.bool_or(F.col("confidence") < doubtful).alias("doubtful"))
