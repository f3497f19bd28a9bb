"""Queries of reading order, block text, reflow, tables without rules and structure edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import reading
from quire.plans.model_queries import _boxes
from quire.plans.record_queries import TREE_SQL, tree
from quire.plans.text_queries import docs
from quire.sources.tables import table


def s6_find_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark")
    return t.select("item_id", F.md5(reading.find_tokens(F.concat(F.lit("  ﬁ\t\n "), "text", F.lit(" Ｘ "))).cast("binary")).alias("tokens"))


S6_SQL = r"SELECT item_id, md5('fi ' || regexp_replace(lower(text), '\s+', ' ', 'g') || ' x') AS tokens FROM benchmark"


def s7_block_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running text of documents whose lines are hyphenated before every `ion`."""
    broken = F.regexp_replace("text", "([a-z])ion", "$1-\nion")
    units = reading.block_units(broken)
    return docs(spark, sf_dir).select("doc_id", F.length(units).alias("n"), tx.whole_word_count(units, "the").alias("hits"))


S7_SQL = r"""WITH b AS (SELECT doc_id, regexp_replace(text, '([a-z])ion', '\1-' || chr(10) || 'ion', 'g') AS t FROM documents), u AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[-‐­]\n(\p{Ll})', '\1', 'g'), '[ \n]+', ' ', 'g') AS t FROM b)
SELECT doc_id, length(t) AS n, len(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}\p{M}_]+'), lambda x: x = 'the')) AS hits FROM u"""


def t13_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a turn as units: a third run from the right, a third from the left, a third has no direction."""
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("ord", "w"))
    d = F.when(F.length("w") % 3 == 0, "rtl").when(F.length("w") % 3 == 1, "ltr")
    return reading.reading_places(units.select("conv_id", "turn", "ord", d.alias("direction"), (F.col("turn") % 2 == 1).alias("rtl_base")), ["conv_id", "turn"]).select("conv_id", "turn", "ord", "place")


T13_SQL = """WITH u AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) - 1 AS ord, length(unnest(string_split(text, ' '))) % 3 AS k FROM conversations),
d AS (SELECT *, CASE k WHEN 0 THEN 'rtl' WHEN 1 THEN 'ltr' END AS d, CASE WHEN turn % 2 = 1 THEN 'rtl' ELSE 'ltr' END AS base FROM u),
n AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), base) AS a, coalesce(first_value(d IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), base) AS z FROM d),
r AS (SELECT *, coalesce(d, CASE WHEN a = z THEN a ELSE base END) AS e FROM n), t AS (SELECT *, CASE WHEN lag(e, 1, '') OVER (PARTITION BY conv_id, turn ORDER BY ord) <> e THEN 1 ELSE 0 END AS t FROM r),
s AS (SELECT *, sum(t) OVER (PARTITION BY conv_id, turn ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT conv_id, turn, ord, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE base WHEN 'rtl' THEN -run ELSE run END, CASE e WHEN 'rtl' THEN -ord ELSE ord END) - 1 AS place FROM s"""


def t15_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reading.reflowed(docs(spark, sf_dir), 60)
    return made.select("doc_id", F.size("lines").alias("lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("md5"))


def k6_text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    pieces = line.select(F.col("l_suppkey").alias("page"), F.dayofyear("l_shipdate").alias("row"), (F.col("l_quantity") * 10 + F.col("l_discount")).alias("x"), F.col("l_partkey").cast("string").alias("text"))
    return reading.text_columns(pieces)


def k7_stream_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    row = F.floor(F.col("n") / 2).cast("int")
    return reading.stream_tables(b.select("page", row.alias("row"), (row * 20.0).alias("top"), (row * 20.0 + 12).alias("bottom"), (F.col("x0") + (F.col("n") % 2) * 60).alias("x0"), (F.col("x1") + (F.col("n") % 2) * 60).alias("x1"), "text"), dealt_out=True)


def g4_edited_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of even number are unwrapped, customers of the last segment renamed, orders of large price moved to a region."""
    nodes = tree(spark, sf_dir).select("key", "parent", F.substring("key", 1, 1).alias("role"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edits = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(text("n", "n_nationkey").alias("key"), F.lit("unwrap").alias("action"), F.lit(None).cast("string").alias("value"))
    edits = edits.union(table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(text("c", "c_custkey"), F.lit("role"), F.lit("Sect")))
    edits = edits.union(table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(text("o", "o_orderkey"), F.lit("move"), F.lit("r0")))
    return reading.edited(nodes, edits)


G4_SQL = f"""WITH {TREE_SQL}, m AS (SELECT 'c' || c_custkey AS key FROM customer WHERE c_mktsegment = 'MACHINERY'), o AS (SELECT 'o' || o_orderkey AS key FROM orders WHERE o_totalprice > 300000),
u AS (SELECT 'n' || n_nationkey AS key, 'r' || n_regionkey AS "to" FROM nation WHERE n_nationkey % 2 = 0)
SELECT t.key, CASE WHEN o.key IS NOT NULL THEN 'r0' WHEN u.key IS NOT NULL THEN u."to" ELSE parent END AS parent, CASE WHEN m.key IS NOT NULL THEN 'Sect' ELSE left(t.key, 1) END AS role
FROM tree t LEFT JOIN m ON m.key = t.key LEFT JOIN o ON o.key = t.key LEFT JOIN u ON u.key = t.parent WHERE t.key NOT IN (SELECT key FROM u)"""

QUERIES = {
    "s6_find_tokens": s6_find_tokens, "s7_block_units": s7_block_units, "t13_reading_order": t13_reading_order, "t15_reflow": t15_reflow, "k6_text_columns": k6_text_columns,
    "k7_stream_tables": k7_stream_tables, "g4_edited_structure": g4_edited_structure,
}
ORACLE_SQL = {"s6_find_tokens": S6_SQL, "s7_block_units": S7_SQL, "t13_reading_order": T13_SQL, "g4_edited_structure": G4_SQL}
