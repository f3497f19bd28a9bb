"""Removal and moves of annotations, and the check of what was written against what was asked.

What is removed follows from the targets by anti-joins; what a new version must hold follows from the old one, and the two
are compared entry by entry, so an output that lost, kept, changed or gained anything else is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = ["doc_id", "page", "id"]
# Fixed value: a reference to an object, its generation where it isn't 0.
REFERENCE = r"^\d+R\d*$"


def refused_targets(annotations: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, page, id, reason) of the targets that can't be removed: a page below 0, an id that is no reference, or no
    such annotation on that page."""
    there = annotations.select(*ENTRY, F.lit(True).alias("there")).distinct()
    bad = F.when(F.col("page").isNull() | (F.col("page") < 0), "page").when(~F.coalesce(F.col("id").rlike(REFERENCE), F.lit(False)), "id").when(F.col("there").isNull(), "missing")
    return targets.select(*ENTRY).distinct().join(there, ENTRY, "left").withColumn("reason", bad).where("reason is not null").select(*ENTRY, "reason")


def removed(annotations: DataFrame, targets: DataFrame) -> DataFrame:
    """annotations (doc_id, page, id, ...) less the targets (doc_id, page, id), with what goes along: popups of what is
    removed (kind Popup, parent: its id), wherever they stand. Answers to it stay and answer nothing: their in_reply_to is
    null. A target named twice is one; a document with a refused target stays as it is."""
    good = targets.select(*ENTRY).distinct().join(refused_targets(annotations, targets).select("doc_id").distinct(), "doc_id", "left_anti")
    gone = good.select("doc_id", F.col("id").alias("parent")).distinct()
    popups = annotations.where("kind = 'Popup'").join(gone, ["doc_id", "parent"], "left_semi").select(*ENTRY)
    doomed = good.union(popups).distinct()
    kept = annotations.join(doomed, ENTRY, "left_anti")
    ids = doomed.select("doc_id", F.col("id").alias("in_reply_to"), F.lit(True).alias("lost")).distinct()
    return kept.join(ids, ["doc_id", "in_reply_to"], "left").withColumn("in_reply_to", F.when(F.col("lost").isNull(), F.col("in_reply_to"))).select(annotations.columns)


def moved(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """annotations (doc_id, page, id, x0, y0, x1, y1, turn) after changes (doc_id, page, id, dx, dy, quarters): a box is moved,
    then turned about its centre by quarters of a circle clockwise, which its turn (0 to 270) keeps. Of changes to one
    annotation the moves and quarters add up."""
    sums = changes.groupBy(*ENTRY).agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.sum("quarters").alias("quarters"))
    both = annotations.join(sums, ENTRY, "left").na.fill(0, ["dx", "dy", "quarters"])
    cx, cy = (F.col("x0") + F.col("x1")) / 2 + F.col("dx"), (F.col("y0") + F.col("y1")) / 2 + F.col("dy")
    across = F.pmod("quarters", F.lit(2)) == 1
    half: Column = lambda a, b: F.when(across, F.col(f"{b}1") - F.col(f"{b}0")).otherwise(F.col(f"{a}1") - F.col(f"{a}0")) / 2
    w, h = half("x", "y"), half("y", "x")
    made = {"x0": cx - w, "x1": cx + w, "y0": cy - h, "y1": cy + h, "turn": F.pmod(F.col("turn") + F.col("quarters") * 90, F.lit(360)).cast("int")}
    return both.select(*[made.get(c, F.col(c)).alias(c) for c in annotations.columns])


def violations(wanted: DataFrame, produced: DataFrame) -> DataFrame:
    """(doc_id, page, id, problem) of what differs between the version that was wanted and the one that was produced, both
    (doc_id, page, id, ...): an entry is `lost`, `gained`, `changed`, or there more or less often (`count`)."""
    rest = [c for c in wanted.columns if c not in ENTRY]
    facts = lambda df, name: df.groupBy(*ENTRY).agg(F.sort_array(F.collect_list(F.to_json(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in rest]), {"ignoreNullFields": "false"}))).alias(name))
    both = facts(wanted, "a").join(facts(produced, "b"), ENTRY, "full")
    problem = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "gained").when(F.size("a") != F.size("b"), "count").when(F.col("a") != F.col("b"), "changed")
    return both.withColumn("problem", problem).where("problem is not null").select(*ENTRY, "problem")


def accepted(wanted: DataFrame, produced: DataFrame) -> DataFrame:
    """(doc_id, problems) of every document of either version: how many entries aren't as they were wanted. A document is
    accepted with none; a page or a document that is missing as a whole shows by its entries."""
    every = wanted.select("doc_id").union(produced.select("doc_id")).distinct()
    bad = violations(wanted, produced).groupBy("doc_id").agg(F.count("*").alias("problems"))
    return every.join(bad, "doc_id", "left").na.fill(0, ["problems"])
