"""Trees and graphs as edge tables: threads, reading order, reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.shared import shared_folder


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative result in the shared checkpoint folder, with one file a core at most."""
    shared_folder(df.sparkSession)
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)).checkpoint(eager=True)


def roots(edges: DataFrame, node: str = "node", parent: str = "parent", rounds: int = 40) -> DataFrame:
    """(node, root, depth) of every node that hangs from a root (a null parent); cycles and orphans are left out.

    Each round doubles how far a node looks up, so a chain of n needs about log n rounds; what still moves after those
    runs in a circle.
    """
    at = settled(edges.select(F.col(node).alias("node"), F.coalesce(parent, node).alias("up"), F.col(parent).isNotNull().cast("long").alias("depth")))
    for _ in range(min(rounds, at.count().bit_length() + 1)):
        above = at.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        new = settled(at.join(above, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.select("node", F.col("up").alias("root"), "depth")
        at = new.drop("moved")
    tops = edges.where(F.col(parent).isNull()).select(F.col(node).alias("up"))
    return at.join(tops, "up", "left_semi").select("node", F.col("up").alias("root"), "depth")


def _answers(records: DataFrame) -> DataFrame:
    """Records with what they answer: members of a group stand for themselves."""
    grouped = F.coalesce(F.col("reply_type") == "Group", F.lit(False)) if "reply_type" in records.columns else F.lit(False)
    return records.withColumn("parent", F.when(~grouped, F.col("parent")))


def threads(records: DataFrame) -> DataFrame:
    """(root, id, depth, place) of the replies below each root, oldest first; from (id, parent, ts, ord) and, where there
    are such columns, reply_type (a `Group` record is no reply) and state (a record with one is no reply, though others
    may answer it). Chains that end at a record that isn't there, or in a circle, are left out."""
    own = _answers(records)
    placed = roots(own, "id", "parent").withColumnRenamed("node", "id").where("depth > 0")
    found = placed.join((own.where("state is null") if "state" in own.columns else own).select("id", "ts", "ord"), "id")
    oldest = Window.partitionBy("root").orderBy("ts", "ord", "id")
    return found.select("root", "id", "depth", (F.row_number().over(oldest) - 1).alias("place"))


def thread_states(records: DataFrame) -> DataFrame:
    """(root, records, state, author, at, marked) of each thread: how many records hang below its root, the latest review
    state with who gave it and when, and whether the latest mark says so.

    records: (id, parent, reply_type, ts, ord, author, state, state_model). A state without a model is a review.
    """
    own = _answers(records)
    placed = roots(own, "id", "parent").withColumnRenamed("node", "id").where("depth > 0")
    found = placed.join(own.drop("parent"), "id")
    review = F.col("state").isNotNull() & (F.coalesce("state_model", F.lit("Review")) == "Review")
    last = lambda when: F.max(F.when(when, F.struct("ts", "ord", "author", "state")))
    made = found.groupBy("root").agg(F.count("*").alias("records"), last(review).alias("r"), last(F.col("state_model") == "Marked").alias("m"))
    return made.select("root", "records", "r.state", "r.author", F.col("r.ts").alias("at"), F.coalesce(F.col("m.state") == "Marked", F.lit(False)).alias("marked"))


def preorder(nodes: DataFrame) -> DataFrame:
    """(key, depth, path) for (key, parent, ord): paths of padded ordinals sort as the tree is read, parents first.

    Each round doubles how far up a path reaches, so n levels need about log n rounds; what is whole is not joined again.
    Nodes that hang from no root (their chain ends at a node that isn't there, or in a circle) are left out: the first find
    nothing to join, the second are still on their way after as many rounds as any chain needs. Ordinals are padded to the
    widest, twelve digits at least; negative ones are refused.
    """
    sizes = nodes.agg(F.count("*").alias("n"), F.max(F.length(F.col("ord").cast("string"))).alias("w"), F.min("ord").alias("least")).first()
    if (sizes["least"] or 0) < 0:
        raise ValueError("ordinals begin at 0")
    step = F.lpad(F.col("ord").cast("string"), max(12, sizes["w"] or 0), "0")
    at = settled(nodes.select("key", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("int").alias("depth"), step.alias("path")))
    for _ in range(sizes["n"].bit_length()):
        if at.where("up is not null").isEmpty():
            break
        above = at.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("path").alias("ahead"))
        moved = at.where("up is not null").join(above, "up").select("key", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat_ws("/", "ahead", "path").alias("path"))
        at = settled(at.where("up is null").unionByName(moved))
    return at.where("up is null").select("key", "depth", "path")


def reachable(seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, distance) of everything that can be reached from (node) over (src, dst), by the fewest steps, up to `most`.

    A round takes one step from the nodes it found last. What was found is kept in parts that cover 1, 2, 4... rounds, so
    each row is written again about log n times in n rounds, not in every one. Rounds end when nothing new is found.
    """
    front = settled(seeds.select("node").distinct().withColumn("distance", F.lit(0)))
    parts, distance = [(1, front)], 0
    while most is None or distance < most:
        distance += 1
        seen = reduce(DataFrame.unionByName, [p for _, p in parts])
        step = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = settled(step.join(seen, "node", "left_anti").withColumn("distance", F.lit(distance)))
        if not front.limit(1).count():
            break
        parts.append((1, front))
        while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
            (m, a), (n, b) = parts.pop(), parts.pop()
            parts.append((m + n, settled(a.unionByName(b))))
    return reduce(DataFrame.unionByName, [p for _, p in parts])


def pages_below(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, pages) of every node below which there are pages: the distinct pages of the node and all below it, sorted.

    nodes: (key, parent); pages: (key, page). Pages go up as in reachable(): one (node, page) row once.
    """
    pairs = pages.join(nodes.select("key"), "key", "left_semi").select(F.struct("key", "page").alias("node"))
    front = settled(pairs.distinct())
    parts = [(1, front)]
    above = nodes.where("parent is not null").select("key", "parent")
    while True:
        seen = reduce(DataFrame.unionByName, [p for _, p in parts])
        step = front.select("node.key", "node.page").join(above, "key").select(F.struct(F.col("parent").alias("key"), "page").alias("node")).distinct()
        front = settled(step.join(seen, "node", "left_anti"))
        if not front.limit(1).count():
            break
        parts.append((1, front))
        while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
            (m, a), (n, b) = parts.pop(), parts.pop()
            parts.append((m + n, settled(a.unionByName(b))))
    every = reduce(DataFrame.unionByName, [p for _, p in parts]).select("node.key", "node.page")
    return every.groupBy("key").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def resolved_roles(mapping: DataFrame, rounds: int = 20) -> DataFrame:
    """(role, final) for (role, target): chains are followed to their end; one that runs in a circle ends as null."""
    at = settled(mapping.select("role", F.col("target").alias("final")))
    for _ in range(rounds):
        nxt = at.select(F.col("role").alias("final"), F.col("final").alias("next"))
        new = settled(at.join(nxt, "final", "left").select("role", "final", F.col("next").isNotNull().alias("moved"), F.coalesce("next", "final").alias("to")))
        if not new.where("moved").limit(1).count():
            return new.select("role", "final")
        at = new.select("role", F.col("to").alias("final"))
    still = mapping.select(F.col("role").alias("final")).distinct().withColumn("loop", F.lit(True))
    return at.join(still, "final", "left").select("role", F.when(F.col("loop").isNull(), F.col("final")).alias("final"))


def linked_groups(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, first) of the nodes in (a, b) links: the smallest node that can be reached."""
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = settled(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("first")))
    for _ in range(rounds):
        near = both.join(at.select(F.col("node").alias("b"), "first"), "b").groupBy(F.col("a").alias("node")).agg(F.min("first").alias("near"))
        pulled = settled(at.join(near, "node").select("node", F.col("first").alias("was"), F.least("first", "near").alias("first")))
        up = pulled.select(F.col("node").alias("first"), F.col("first").alias("up"))
        new = settled(pulled.join(up, "first").select("node", "was", F.col("up").alias("first")))
        at = new.select("node", "first")
        if not new.where("was <> first").limit(1).count():
            return at
    raise RuntimeError("the groups did not settle")
