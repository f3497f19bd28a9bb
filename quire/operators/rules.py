"""Rules over structure trees, form fields and texts, each a DataFrame of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.geometry import merged
from quire.operators.graph import resolved_roles, settled

FINDING = ["doc_id", "rule", "reason", "key"]


def _into(parts: int | None, df: DataFrame, *key: str) -> DataFrame:
    """df dealt out by key into so many parts, or as it is. Two that are dealt alike are joined where they lie."""
    return df.repartition(parts, *key) if parts else df


def heading_rule(nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """Findings of (doc_id, key, ord, role): plain H beside H1 to H6 (at the first H), a first heading that isn't H1, and
    levels that skip."""
    heads = _into(parts, nodes.where(F.col("role").rlike("^H[1-6]?$")).select("doc_id", "key", "ord", "role"), "doc_id").withColumn("level", F.nullif(F.substring("role", 2, 1), F.lit("")).cast("int"))
    numbered = heads.where(F.col("level").isNotNull())
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = numbered.withColumn("before", F.lag("level").over(w))
    first = before.where(F.col("before").isNull() & (F.col("level") != 1)).withColumn("reason", F.lit("first"))
    skip = before.where(F.col("level") > F.col("before") + 1).withColumn("reason", F.lit("skip"))
    kinds = heads.groupBy("doc_id").agg(F.count("level").alias("n"), F.min(F.when(F.col("level").isNull(), F.struct("ord", "key"))).alias("h"))
    mixed = kinds.where("n > 0 and h is not null").select("doc_id", F.lit("heading").alias("rule"), F.lit("mixed").alias("reason"), F.col("h.key").alias("key"))
    both = first.unionByName(skip).select("doc_id", F.lit("heading").alias("rule"), "reason", "key")
    return both.unionByName(mixed)


def figure_rule(nodes: DataFrame) -> DataFrame:
    """Figures and formulas with neither alternative nor actual text."""
    bare = nodes.where(F.col("role").isin("Figure", "Formula") & F.coalesce("alt", F.lit("")).eqNullSafe("") & F.coalesce("actual", F.lit("")).eqNullSafe(""))
    return bare.select("doc_id", F.lit("figure").alias("rule"), F.lit("no-text").alias("reason"), "key")


# The reasons of the nesting rules, and which child may stand in which parent.
PARTS = ("THead", "TBody", "TFoot")
NESTING = {
    "list-child": (("L",), ("LI",), "parent"),
    "item-outside-list": (("LI",), ("L",), "child"),
    "item-child": (("LI",), ("Lbl", "LBody"), "parent"),
    "part-outside-item": (("Lbl", "LBody"), ("LI",), "child"),
    "cell-outside-row": (("TH", "TD"), ("TR",), "child"),
    "row-outside-table": (("TR",), ("Table", *PARTS), "child"),
    "row-child": (("TR",), ("TH", "TD"), "parent"),
    "part-child": (PARTS, ("TR",), "parent"),
    "table-child": (("Table",), ("TR", "Caption", *PARTS), "parent"),
}


def nesting_rules(nodes: DataFrame, reasons: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Findings of (doc_id, key, parent, role): children that a parent may not hold, and nodes outside their parents.

    Parents that no rule names are like none, and a node without a parent breaks only rules about its own role.
    """
    named = {r for roles, allowed, _ in NESTING.values() for r in (*roles, *allowed)}
    up = nodes.where(F.col("role").isin(*named)).select("doc_id", F.col("key").alias("parent"), F.col("role").alias("parent_role"))
    own = nodes.where(F.col("parent").isNotNull() | F.col("role").isin(*named)).select("doc_id", "parent", "key", "role")
    both = _into(parts, own, "doc_id", "parent").join(_into(parts, up, "doc_id", "parent"), ["doc_id", "parent"], "left")
    none = F.coalesce(F.col("parent_role"), F.lit(""))

    def broken(reason: str) -> Column:
        roles, allowed, side = NESTING[reason]
        if side == "parent":
            return none.isin(*roles) & ~F.col("role").isin(*allowed)
        return F.col("role").isin(*roles) & ~none.isin(*allowed)

    found = F.array_compact(F.array(*[F.when(broken(r), F.lit(r)) for r in reasons or NESTING]))
    made = both.select("doc_id", F.lit("nesting").alias("rule"), F.explode(found).alias("reason"), "key")
    if reasons and "no-body" not in reasons:
        return made
    bodies = nodes.where("role = 'LBody'").select("doc_id", F.col("parent").alias("key"))
    items = nodes.where("role = 'LI'").select("doc_id", "key")
    bare = _into(parts, items, "doc_id", "key").join(_into(parts, bodies, "doc_id", "key"), ["doc_id", "key"], "left_anti")
    return made.unionByName(bare.select("doc_id", F.lit("nesting").alias("rule"), F.lit("no-body").alias("reason"), "key"))


def role_map_rule(mapping: DataFrame, nodes: DataFrame, standard: list[str]) -> DataFrame:
    """Findings (doc_id, rule, reason, key) about roles, key being the role: `remapped` where a standard role is mapped,
    `unresolved` where a mapped one leads to no standard role, `unmapped` where a node's role is neither standard nor
    mapped. mapping: (doc_id, role, target); nodes: (doc_id, role)."""
    is_standard = lambda c: F.col(c).isin(*standard)
    own = mapping.select("doc_id", "role", "target")
    custom = own.where(~is_standard("role"))
    step = custom.select(F.struct("doc_id", "role").alias("role"), F.struct("doc_id", F.col("target").alias("role")).alias("target"))
    ends = resolved_roles(step).select("role.doc_id", "role.role", F.col("final.role").alias("final"))
    found = own.where(is_standard("role")).select("doc_id", F.lit("remapped").alias("reason"), F.col("role").alias("key"))
    found = found.unionByName(ends.where(F.col("final").isNull() | ~is_standard("final")).select("doc_id", F.lit("unresolved").alias("reason"), F.col("role").alias("key")))
    bare = nodes.where((F.col("role") != "") & ~is_standard("role")).select("doc_id", "role").distinct().join(own, ["doc_id", "role"], "left_anti")
    found = found.unionByName(bare.select("doc_id", F.lit("unmapped").alias("reason"), F.col("role").alias("key")))
    return found.select("doc_id", F.lit("role-map").alias("rule"), "reason", "key")


def run_rules(nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """The findings of all structure rules. parts: into how many parts nodes are dealt where several are looked at together,
    so that a task's sorts hold no more of a larger table; else as the session shuffles."""
    found = [heading_rule(nodes, parts), figure_rule(nodes), nesting_rules(nodes, parts=parts)]
    return reduce(DataFrame.unionByName, [f.select(*FINDING) for f in found])


def field_problems(fields: DataFrame) -> DataFrame:
    """Add problem to (kind, value, read_only, required, max_length, options): the first that holds, or null."""
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    problem = (
        F.when(F.col("read_only"), "read-only")
        .when(F.col("required") & (F.col("kind") == "checkbox") & (F.col("value") != "true"), "required")
        .when(F.col("required") & blank, "required")
        .when(F.length("value") > F.col("max_length"), "too-long")
        .when(F.col("kind").isin("choice", "radio") & ~blank & ~F.array_contains("options", F.col("value")), "not-an-option")
    )
    return fields.withColumn("problem", problem)


def audit(texts: DataFrame, needles: DataFrame, broadcast_rows: int = 20_000) -> DataFrame:
    """(doc_id, item_id, hits): how often each needle still stands in each text, without overlaps; only pairs with hits.

    Texts meet needles by the hash of something that any text with the needle must hold: for needles of four words or
    more their second and third word, which stand whole; for shorter ones their first four characters, or as many as
    there are. Only hashes leave a text's row; where needles are few enough to broadcast they meet in place, else by
    shuffle. What met is looked up in the texts and counted exactly. Blank needles are skipped, equal ones are looked
    up once.
    """
    clean = needles.where(F.trim("text") != "").groupBy(F.col("text").alias("needle")).agg(F.min("item_id").alias("item_id"))
    spaced = F.split(F.regexp_replace("needle", r"\s+", " "), " ")
    clean = settled(clean.withColumn("w", spaced).select("needle", "item_id", F.when(F.size("w") >= 4, 0).otherwise(F.least(F.length("needle"), F.lit(4))).alias("n"), F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2))).alias("pair")))
    sizes = {r["n"]: r["count"] for r in clean.groupBy("n").count().collect()}  # 0 to 4
    few = sum(sizes.values()) <= broadcast_rows
    keyed = clean.select("item_id", "needle", "n", F.when(F.col("n") == 0, F.col("pair")).otherwise(F.xxhash64(F.left("needle", F.col("n")))).alias("h"))
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    count = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), count), F.slice("w", F.lit(2), count), lambda x, y: F.xxhash64(x, y))
    marked = lambda hashes, n: F.transform(F.array_distinct(hashes), lambda h: F.struct(F.lit(n).alias("n"), h.alias("h")))

    def grams(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda k: k + n - 1 <= F.length("text"))
        return F.transform(starts, lambda k: F.xxhash64(F.substring(F.col("text"), k, F.lit(n))))

    keys = [marked(pairs, 0)] if 0 in sizes else []
    keys += [marked(grams(n), n) for n in sizes if n]
    if not keys:
        return texts.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("hits")).limit(0)
    spread = texts.select("doc_id", "text", words.alias("w")).select("doc_id", F.explode(F.concat(*keys)).alias("k")).select("doc_id", "k.n", "k.h")
    meet = spread.join(F.broadcast(keyed) if few else keyed, ["n", "h"]).select("doc_id", "item_id", "needle").distinct()
    hits = F.floor((F.length("text") - F.length(F.replace("text", F.col("needle"), F.lit("")))) / F.length("needle"))
    return texts.select("doc_id", "text").join(meet, "doc_id").select("doc_id", "item_id", hits.alias("hits")).where("hits > 0")


def masked(texts: DataFrame, spans: DataFrame, mark: str = "█") -> DataFrame:
    """texts with every (doc_id, start, length) span covered by the mark, a character for a character; spans may overlap.

    Spans are merged first; then a text is put together once from the pieces between them.
    """
    merged_spans = merged(spans.select("doc_id", "start", (F.col("start") + F.col("length")).alias("stop")), ["doc_id"]).drop("parts")
    each = merged_spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))
    before = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))), "s")
    piece = lambda x, p: F.concat(F.substring(F.col("text"), p["stop"] + 1, x["start"] - p["stop"]), F.repeat(F.lit(mark), F.least(x["stop"], F.length("text")) - x["start"]))
    pieces = F.zip_with("s", F.slice("p", F.lit(1), F.size("s")), piece)
    rest = F.substring(F.col("text"), F.element_at("s", -1)["stop"] + 1, F.length("text"))
    both = texts.join(each, "doc_id", "left").withColumn("p", F.when(F.col("s").isNotNull(), before))
    return both.withColumn("text", F.when(F.col("s").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest))).drop("s", "p")


def redaction_needles(glyphs: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    """(key, needle): the distinct texts, longer than a character, of runs of glyphs (ord, ch, x0, x1, y0, y1) whose
    centres lie in a mark (mark, x0, y0, x1, y1) of the key."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    g = glyphs.select(*key, "ord", "ch", cx.alias("cx"), cy.alias("cy"))
    inside = g.join(marks, key).where("cx >= x0 and cx < x1 and cy >= y0 and cy < y1")
    runs = inside.withColumn("run", F.col("ord") - F.row_number().over(Window.partitionBy(*key, "mark").orderBy("ord")))
    listed = runs.groupBy(*key, "mark", "run").agg(F.sort_array(F.collect_list(F.struct("ord", "ch"))).alias("l"))
    return listed.select(*key, F.trim(F.array_join(F.transform("l", lambda x: x["ch"]), "")).alias("needle")).where("length(needle) > 1").distinct()

