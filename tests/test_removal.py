"""Removal and moves of annotations, and spoilt outputs that are refused."""

import random

from pyspark.sql import functions as F
from quire.operators import removal

NOTE = "doc_id long, page int, id string, kind string, parent string, in_reply_to string, contents string, x0 double, y0 double, x1 double, y1 double, turn int"


def note(doc, page, id, kind="Text", parent=None, reply=None, contents="c", box=(0.0, 0.0, 10.0, 4.0), turn=0):
    return (doc, page, id, kind, parent, reply, contents, *box, turn)


def test_removal_takes_popups_along_and_leaves_answers(spark):
    rows = [note(1, 0, "1R"), note(1, 0, "2R", "Popup", "1R"), note(1, 1, "3R", "Popup", "1R"), note(1, 0, "4R", reply="1R"), note(1, 0, "5R"), note(1, 1, "1R"), note(2, 0, "1R"), note(3, 0, "7R2")]
    df = spark.createDataFrame(rows, NOTE)
    targets = spark.createDataFrame([(1, 0, "1R"), (1, 0, "1R"), (2, 0, "9R"), (2, 0, "1R"), (3, 0, "7R2"), (4, -1, "1R"), (4, 0, "x")], "doc_id long, page int, id string")
    assert sorted(map(tuple, removal.refused_targets(df, targets).collect())) == [(2, 0, "9R", "missing"), (4, -1, "1R", "page"), (4, 0, "x", "id")]
    left = sorted((r.doc_id, r.page, r.id, r.in_reply_to) for r in removal.removed(df, targets).collect())
    assert left == [(1, 0, "4R", None), (1, 0, "5R", None), (1, 1, "1R", None), (2, 0, "1R", None)]
    assert removal.removed(df, targets).columns == df.columns


def test_moves_and_turns(spark):
    df = spark.createDataFrame([note(1, 0, "1R"), note(1, 0, "2R", turn=270), note(1, 0, "3R")], NOTE)
    changes = spark.createDataFrame([(1, 0, "1R", 5.0, 1.0, 0), (1, 0, "2R", 0.0, 0.0, 1), (1, 0, "2R", 1.0, 0.0, -4)], "doc_id long, page int, id string, dx double, dy double, quarters int")
    got = {r.id: (r.x0, r.y0, r.x1, r.y1, r.turn) for r in removal.moved(df, changes).collect()}
    assert got == {"1R": (5.0, 1.0, 15.0, 5.0, 0), "2R": (4.0, -3.0, 8.0, 7.0, 0), "3R": (0.0, 0.0, 10.0, 4.0, 0)}
    four = changes.limit(0).union(spark.createDataFrame([(1, 0, "1R", 0.0, 0.0, 1)] * 4, changes.schema))
    assert removal.violations(df, removal.moved(df, four)).count() == 0


def test_spoilt_outputs_are_refused(spark):
    rng = random.Random(3)
    rows = [note(d, p, f"{k}R", contents=f"{d}{p}{k}") for d in range(6) for p in range(2) for k in range(3)]
    wanted = spark.createDataFrame(rows, NOTE)
    rng.shuffle(rows)
    good = spark.createDataFrame(rows, NOTE)
    assert {(r.doc_id, r.problems) for r in removal.accepted(wanted, good).collect()} == {(d, 0) for d in range(6)}
    spoilt = good.where("not (doc_id = 0 and page = 1 and id = '2R')").withColumn("contents", F.when(F.expr("doc_id = 1 and page = 0 and id = '0R'"), F.lit(None)).otherwise(F.col("contents")))
    spoilt = spoilt.union(spark.createDataFrame([note(2, 0, "99R"), note(3, 0, "0R", contents="300"), note(9, 0, "1R")], NOTE)).where("doc_id <> 4")
    got = {tuple(r) for r in removal.violations(wanted, spoilt).collect()}
    assert got == {(0, 1, "2R", "lost"), (1, 0, "0R", "changed"), (2, 0, "99R", "gained"), (3, 0, "0R", "count"), (9, 0, "1R", "gained")} | {(4, p, f"{k}R", "lost") for p in range(2) for k in range(3)}
    assert {r.doc_id: r.problems for r in removal.accepted(wanted, spoilt).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 6, 5: 0, 9: 1}
