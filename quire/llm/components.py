"""Connected components of a link table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_narrow


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, broadcast_rows: int = 100_000) -> DataFrame:
    """(node, label) for every node of the links; label is the smallest node reachable.

    A round takes each node's smallest label among its neighbours, then that label's own label, so a chain of n links
    needs about log n rounds. The minimum is pre-aggregated before each shuffle. Labels are few against nodes, and only
    those that have a smaller label themselves are looked up: they are broadcast where a count finds them few, so that the
    members of a very large component needn't meet in one task. The other joins read plain exchanges of checkpointed
    tables, which adaptive execution splits where a node has very many links. Only counts come to the driver. Rows with a
    null end are ignored; no links give no rows.
    """
    x, y = F.col(a), F.col(b)
    there = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(x.alias("a"), y.alias("b"))
    both = cut_narrow(there.union(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_narrow(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    for _ in range(rounds):
        other = labels.select(F.col("node").alias("b"), "label")
        near = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        pulled = cut_narrow(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        own = pulled.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moves = cut_narrow(pulled.select("label").distinct().join(own, "label").where("up <> label"))
        n_moves = moves.count()
        changed = pulled.where("old <> label").count()
        if n_moves:
            few = F.broadcast(moves) if n_moves <= broadcast_rows else moves
            labels = cut_narrow(pulled.join(few, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        else:
            labels = pulled.select("node", "label")
        if not changed and not n_moves:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
