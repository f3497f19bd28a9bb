"""Edit histories and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.groups import walk_groups


def fold_journal(events: DataFrame) -> DataFrame:
    """(doc, seq, kept, cursor) after each (doc, ord, action) in order of ord: how many entries stand, and the cursor.

    An append drops what was undone; undo and redo move the cursor within bounds. Each step depends on all before it,
    so a document's actions are streamed in the order of ord.
    """

    def fold(actions):
        kept = cursor = 0
        for a in actions:
            if a.action == "append":
                kept = cursor = cursor + 1
            elif a.action == "undo":
                cursor = max(0, cursor - 1)
            elif a.action == "redo":
                cursor = min(kept, cursor + 1)
            yield a.doc, a.ord, kept, cursor

    return walk_groups(events.select("doc", "ord", "action"), "doc", ["ord"], fold, "doc long, ord long, kept long, cursor long")


def retained(snapshots: DataFrame, budget: int, newest: int = 2) -> DataFrame:
    """Add kept to (doc, ord, bytes): the newest ones always, then as many as fit the budget from the newest back."""
    back = Window.partitionBy("doc").orderBy(F.desc("ord"))
    used = F.sum("bytes").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return snapshots.withColumn("kept", (F.row_number().over(back) <= newest) | (used <= budget))


def cleanup(stored: DataFrame, *references: DataFrame, complete: bool = True) -> DataFrame:
    """The keys that nothing refers to. Refused where the inventory of references is incomplete."""
    if not complete:
        raise ValueError("the inventory is incomplete; nothing is removed")
    left = stored
    for keys in references:
        left = left.join(keys.select("key"), "key", "left_anti")
    return left


def recent(opened: DataFrame, owner: list[str], identity: list[str], order: list[Column], cap: int = 25) -> DataFrame:
    """The newest entry of each identity, with starred true if any of them was, and the newest `cap` of each owner."""
    w = Window.partitionBy(*owner, *identity).orderBy(*order)
    starred = F.max("starred").over(Window.partitionBy(*owner, *identity))
    one = opened.withColumns({"starred": starred, "__rn": F.row_number().over(w)}).where("__rn = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*owner).orderBy(*order))).where(F.col("rank") <= cap).drop("__rn")


def restorable(journals: DataFrame, schema: int) -> DataFrame:
    """Add sound to journals (schema, entries, cursor): whether the schema is the one that can be read, and the cursor is
    a whole number within the entries."""
    sound = (F.col("schema") == schema) & (F.col("cursor") >= 0) & (F.col("cursor") <= F.col("entries")) & (F.col("cursor") == F.floor("cursor"))
    return journals.withColumn("sound", F.coalesce(sound, F.lit(False)))


def document_cleanup(drafts: DataFrame, opened: DataFrame, others: DataFrame, complete: bool = True) -> DataFrame:
    """(manifest, key) of the keys that may go with each draft (manifest, key): those that no other draft, no open
    document (key) and no other window (key) refers to. Refused where the inventory is incomplete."""
    if not complete:
        raise ValueError("the inventory is incomplete; nothing is removed")
    own = drafts.select("manifest", "key").distinct()
    alone = own.groupBy("key").agg(F.count("*").alias("n"), F.first("manifest").alias("manifest")).where("n = 1").select("manifest", "key")
    return cleanup(alone, opened, others)


def newest_first(drafts: DataFrame, owner: list[str], order: list[Column]) -> DataFrame:
    """Add place: 1 for the newest draft of each owner."""
    return drafts.withColumn("place", F.row_number().over(Window.partitionBy(*owner).orderBy(*order)))
