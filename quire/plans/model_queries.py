"""Queries over a document's model: layers, outlines, bindings, annotations, versions, regions and pages in sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import numbers as nm
from quire.operators import forms, geometry, model, pages, sequential
from quire.operators.groups import dealt_by_rows
from quire.plans.record_queries import COMMENTS_SQL, TREE_SQL, comments, tree
from quire.sources.tables import table


def l1_layer_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    layers = part.select(F.col("p_partkey").alias("layer"), (F.col("p_size") > 10).alias("base_on"), (F.col("p_size") % 7 == 0).alias("on"), (F.col("p_size") % 5 == 0).alias("off"), F.when(F.col("p_size") == 50, F.lit(True)).alias("view"))
    policy = F.get(F.array(*[F.lit(p) for p in ("AnyOn", "AllOn", "AnyOff", "AllOff")]), (F.col("l_orderkey") % 4).cast("int"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("content"), F.col("l_partkey").alias("layer"), policy.alias("policy"))
    return model.layer_visibility(layers, members)


L1_SQL = """WITH s AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN TRUE WHEN p_size % 5 = 0 THEN FALSE WHEN p_size % 7 = 0 THEN TRUE ELSE p_size > 10 END AS s FROM part),
a AS (SELECT l_orderkey AS content, bool_or(s IS NULL) AS strange, bool_or(s) AS o, bool_and(s) AS a FROM lineitem LEFT JOIN s ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT content, CASE WHEN strange THEN NULL WHEN content % 4 = 0 THEN o WHEN content % 4 = 1 THEN a WHEN content % 4 = 2 THEN NOT a ELSE NOT o END AS visible FROM a"""


def l2_outline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.outline_counts(tree(spark, sf_dir).withColumn("open", F.col("ord") % 3 != 0))


L2_SQL = f"""WITH RECURSIVE {TREE_SQL}, p AS (SELECT key, parent AS up, TRUE AS shown FROM tree WHERE parent IS NOT NULL
 UNION ALL SELECT p.key, t.parent, p.shown AND t.ord % 3 <> 0 FROM p JOIN tree t ON p.up = t.key WHERE t.parent IS NOT NULL),
s AS (SELECT up AS key, count(*) AS total, count(*) FILTER (shown) AS visible FROM p GROUP BY up)
SELECT key, coalesce(total, 0) AS total, coalesce(visible, 0) AS visible, CASE WHEN ord % 3 <> 0 THEN coalesce(visible, 0) ELSE -coalesce(visible, 0) END AS count FROM tree LEFT JOIN s USING (key)"""


def l3_bound_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders")
    fields = order.select(F.col("o_custkey").cast("string").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("value"))
    leaves = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.concat(F.lit("/form/"), F.col("c_custkey").cast("string")).alias("path"), F.lit("O").alias("stored"))
    return model.bound_sync(fields, leaves)


L3_SQL = """WITH f AS (SELECT o_custkey, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) AS v FROM orders GROUP BY o_custkey)
SELECT '/form/' || c_custkey AS path, CASE WHEN o_custkey IS NULL THEN 'skipped' WHEN coalesce(v, '') = 'O' THEN 'unchanged' ELSE 'changed' END AS status, CASE WHEN o_custkey IS NULL OR coalesce(v, '') = 'O' THEN 'O' ELSE coalesce(v, '') END AS value
FROM customer LEFT JOIN f ON c_custkey = o_custkey"""


def c5a_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns that ask by a question mark go, and with them what answers them; every fourth turn is a popup."""
    notes = comments(spark, sf_dir)
    records = notes.select("id", F.when(F.col("ts") % 4 == 3, "Popup").otherwise("Text").alias("kind"), F.when(F.col("ts") % 4 == 3, F.col("parent")).alias("parent"), F.when(F.col("ts") % 4 != 3, F.col("parent")).alias("reply_to"))
    return model.cascade(records, notes.where("ts = 1 and conv_id % 3 = 0").select("id"))


C5A_SQL = f"""WITH RECURSIVE {COMMENTS_SQL}, r AS (SELECT id, ts % 4 = 3 AS popup, parent FROM n), s AS (SELECT id FROM n WHERE ts = 1 AND conv_id % 3 = 0),
e AS (SELECT parent AS a, id AS b FROM r WHERE parent IS NOT NULL UNION ALL SELECT id, parent FROM r WHERE popup),
g AS (SELECT id FROM s UNION SELECT e.b FROM g JOIN e ON e.a = g.id)
SELECT DISTINCT id FROM g"""


def l6_bytes_fate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    k = F.col("turn") % 3
    after = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit("+"))).otherwise(F.concat(F.lit("-"), "text"))
    return t.select("conv_id", "turn", model.bytes_fate(F.encode("text", "utf-8"), F.encode(after, "utf-8")).alias("fate"))


L6_SQL = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'unchanged' WHEN turn % 3 = 1 OR starts_with('-' || text, text) THEN 'appended' ELSE 'rewritten' END AS fate FROM conversations"


def l7_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as objects that begin on their day; asked for is where each one's day less ten lies."""
    order = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("offset"))
    found = model.enclosing(order.withColumnRenamed("o_orderkey", "object"), order.select("o_custkey", (F.col("offset") - 10).alias("offset"), F.col("o_orderkey").alias("id")), ["o_custkey"])
    return found.select(F.col("id").alias("o_orderkey"), "at")


L7_SQL = """WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS day FROM orders)
SELECT a.o_orderkey, coalesce((SELECT arg_max(b.o_orderkey, (b.day, b.o_orderkey)) FROM o b WHERE b.o_custkey = a.o_custkey AND b.day <= a.day - 10)::VARCHAR, 'byte ' || (a.day - 10)) AS at FROM o a"""


def i5b_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    words = line.select("l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("word"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y")).dropDuplicates(["l_suppkey", "word"])
    n = F.sequence(F.lit(1), F.lit(5))
    regions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.explode(n).alias("region")).select("l_suppkey", "region", F.lit(0).alias("x0"), F.lit(0).alias("y0"), (F.col("region") * 8).alias("x1"), (F.col("region") + (F.col("l_suppkey") % 3)).alias("y1"))
    found = model.smallest_region(words, regions, ["l_suppkey"])
    return found.groupBy("l_suppkey", "region").agg(F.count("*").alias("words"))


I5B_SQL = """WITH w AS (SELECT l_suppkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS word, any_value(l_quantity) AS x, any_value(l_discount * 100) AS y, count(DISTINCT l_quantity) AS k FROM lineitem GROUP BY ALL),
r AS (SELECT s_suppkey, unnest(range(1, 6)) AS n FROM supplier), q AS (SELECT s_suppkey, n, n * 8 AS x1, n + s_suppkey % 3 AS y1 FROM r)
SELECT l_suppkey, coalesce((SELECT min(n) FROM q WHERE s_suppkey = l_suppkey AND x BETWEEN 0 AND x1 AND y BETWEEN 0 AND y1), -1) AS region, count(*) AS words FROM w GROUP BY ALL"""


def u8_trust_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as certificates: each is issued by the one of half its number; anchors are the largest parts."""
    part = table(spark, sf_dir, "part")
    edges = part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))
    return model.distances(part.where("p_size >= 49").select(F.col("p_partkey").alias("node")), edges)


U8_SQL = """WITH RECURSIVE d AS (SELECT p_partkey AS node, 0 AS distance FROM part WHERE p_size >= 49 UNION SELECT node // 2, distance + 1 FROM d JOIN part ON p_partkey = node WHERE distance < 8 AND node > 0)
SELECT node, min(distance) AS distance FROM d GROUP BY node"""


def v8_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    new = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return model.upserted(s, new, "s_suppkey")


V8_SQL = "WITH n AS (SELECT c_custkey AS s_suppkey, c_name AS s_name FROM customer WHERE c_acctbal > 5000) SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n) UNION ALL SELECT * FROM n"


def p14_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as documents of as many pages as they have lines, one behind the other."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("pages"))
    both = table(spark, sf_dir, "orders").join(line, "o_orderkey").select("o_custkey", "o_orderkey", "pages")
    return pages.merged_documents(both, ["o_custkey"], "o_orderkey")


P14_SQL = """WITH l AS (SELECT l_orderkey, count(*) AS pages FROM lineitem GROUP BY ALL)
SELECT o_custkey, o_orderkey, pages, coalesce(sum(pages) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM orders JOIN l ON o_orderkey = l_orderkey"""


def p23_two_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landscape pages without notes become two halves."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return pages.halves(line, F.col("l_quantity") > 25, F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "part")


P23_SQL = "SELECT l_orderkey, l_linenumber, unnest(CASE WHEN l_quantity > 25 AND l_returnflag <> 'R' THEN ['left', 'right'] ELSE ['whole'] END) AS part FROM lineitem"


def f1_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fields: a checked box where a line was returned, else the chosen states, or the order's key as text."""
    line = table(spark, sf_dir, "lineitem")
    listed = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linestatus")).alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    chosen = F.when(F.col("l_orderkey") % 2 == 0, F.col("a"))
    return listed.select("l_orderkey", forms.field_text(F.col("l_orderkey").cast("string"), chosen, F.col("b")).alias("value"))


F1_SQL = """SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN '✓' WHEN l_orderkey % 2 = 0 THEN array_to_string(list_sort(list_distinct(list(l_linestatus))), ', ') ELSE l_orderkey::VARCHAR END AS value FROM lineitem GROUP BY l_orderkey"""


def f15_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of texts, and of the same 400 times over."""
    n = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", nm.size_text(n).alias("size"), nm.size_text(n * 400).alias("many"), nm.percent_text(n / 5000).alias("share"))


SIZE_SQL = "CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN round({n} / 1024, 1) < 1024 THEN format('{{:,.1f}}', round({n} / 1024, 1)) || ' KB' ELSE format('{{:,.1f}}', round({n} / 1048576, 1)) || ' MB' END"
F15_SQL = f"""WITH n AS (SELECT doc_id, strlen(text) AS n, strlen(text) * 400 AS m FROM documents)
SELECT doc_id, {SIZE_SQL.format(n="n")} AS size, {SIZE_SQL.format(n="m")} AS many, format('{{:,}}', round(n / 5000 * 100, 0)::BIGINT) || '%' AS share FROM n"""


def i3_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.floor("l_extendedprice").cast("int") % 256).alias("r"), (F.col("l_partkey") % 256).cast("int").alias("g"), (F.col("l_quantity").cast("int") * 5).alias("b"))
    rgb = [F.col(x) for x in "rgb"]
    return c.groupBy("l_orderkey").agg(F.sum(nm.luma(*rgb)).alias("scan"), F.sum(nm.luma(*rgb, (77, 150, 29))).alias("compare"))


I3_SQL = """WITH c AS (SELECT l_orderkey, floor(l_extendedprice)::BIGINT % 256 AS r, l_partkey % 256 AS g, l_quantity::BIGINT * 5 AS b FROM lineitem)
SELECT l_orderkey, sum((299 * r + 587 * g + 114 * b) // 1000) AS scan, sum((77 * r + 150 * g + 29 * b) // 256) AS compare FROM c GROUP BY l_orderkey"""


def i6_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.confidence_report(table(spark, sf_dir, "events").withColumnRenamed("value", "confidence"), ["user_id"])


I6_SQL = "SELECT user_id, count(*) AS words, count(*) FILTER (value < 60) AS low, bool_or(value < 10) AS doubtful FROM events GROUP BY user_id"


def m5_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and lengths of an order's chain in centimetres: 72 points are 2.54 of them."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("l_linenumber + l_extendedprice / 1e9").alias("ord"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))
    made = geometry.chains(p, ["l_orderkey"], mode="perimeter")
    unit = 72 / 2.54
    return made.select("l_orderkey", F.round(F.col("length") / unit, 6).alias("length_cm"), nm.significant(F.col("length") / unit).alias("decimals"))


M5_SQL = """WITH q AS (SELECT l_orderkey, l_quantity AS x, l_tax AS y, lead(l_quantity) OVER w AS nx, lead(l_tax) OVER w AS ny FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber + l_extendedprice / 1e9)),
s AS (SELECT l_orderkey, sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)) / (72 / 2.54) AS l FROM q GROUP BY l_orderkey HAVING count(*) > 1)
SELECT l_orderkey, round(l, 6) AS length_cm, CASE WHEN l >= 1000 THEN 0 WHEN l >= 100 THEN 1 WHEN l >= 1 THEN 2 ELSE 3 END AS decimals FROM s"""


def k5_line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 100).alias("x0"), (F.col("l_extendedprice") / 100 + 40).alias("x1"), F.lit(10.0).alias("size"), F.col("l_partkey").cast("string").alias("text"))
    return model.line_segments(p, ["l_orderkey"]).select("l_orderkey", "segment", "text")


K5_SQL = """WITH p AS (SELECT l_orderkey, l_extendedprice / 100 AS x, l_partkey FROM lineitem), f AS (SELECT *, CASE WHEN x - lag(x + 40) OVER (PARTITION BY l_orderkey ORDER BY x) > 12 THEN 1 ELSE 0 END AS new FROM p),
s AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY x ROWS UNBOUNDED PRECEDING) AS segment FROM f) SELECT l_orderkey, segment, string_agg(l_partkey::VARCHAR, ' ' ORDER BY x) AS text FROM s GROUP BY l_orderkey, segment"""


def u5e_table_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of two lines a row."""
    line = table(spark, sf_dir, "lineitem")
    named = F.array(F.concat(F.col("l_orderkey").cast("string"), F.lit("-1")))
    cells = line.select(
        F.col("l_orderkey").alias("table"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_discount") > 0.05, "TH").otherwise("TD").alias("role"),
        F.when(F.col("l_tax") > 0.04, "Row").alias("scope"), F.when(F.col("l_tax") > 0.02, named).otherwise(F.array().cast("array<string>")).alias("headers"),
        F.floor((F.col("l_linenumber") - 1) / 2).cast("int").alias("row"), F.expr("l_linenumber + l_extendedprice / 1e9").alias("ord"), F.lit(1).alias("row_span"), F.when(F.col("l_quantity") > 45, 2).otherwise(1).alias("col_span"),
    )
    return model.table_rule(cells)


U5E_SQL = """WITH c AS (SELECT l_orderkey AS t, l_linenumber AS n, l_discount > 0.05 AS th, l_tax > 0.04 AS scope, l_tax > 0.02 AS heads, (l_linenumber - 1) // 2 AS r, CASE WHEN l_quantity > 45 THEN 2 ELSE 1 END AS w FROM lineitem),
a AS (SELECT t, bool_or(heads) AS named FROM c GROUP BY t), r AS (SELECT t, r, sum(w) AS w FROM c GROUP BY ALL), u AS (SELECT t FROM r GROUP BY t HAVING count(DISTINCT w) > 1)
SELECT t AS "table", 'headers' AS reason, 0 AS count FROM c GROUP BY t HAVING NOT bool_or(th)
UNION ALL SELECT t, 'scope', count(*) FROM c JOIN a USING (t) WHERE th AND NOT scope AND NOT (n = 1 AND named) GROUP BY t
UNION ALL SELECT t, 'regular', count(*) FROM c JOIN u USING (t) WHERE NOT th AND NOT heads GROUP BY t"""


def f23_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("l_linenumber + l_extendedprice / 1e9").alias("ord"), F.concat(F.lit("Field "), F.col("l_returnflag")).alias("label"))
    return sequential.unique_names(line, "l_orderkey", "label", "ord")


F23_SQL = """WITH r AS (SELECT l_orderkey, 'Field ' || l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber + l_extendedprice / 1e9) AS k FROM lineitem)
SELECT l_orderkey, label, label || CASE WHEN k = 1 THEN '' ELSE ' ' || k END AS "unique" FROM r"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as boxes on a page, in order of price; dealt out by page."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.expr("l_linenumber + l_extendedprice / 1e9"))
    line = dealt_by_rows(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("n", F.row_number().over(w) - 1)
    return line.select(F.col("l_orderkey").alias("page"), "n", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 30).alias("x1"), (F.col("n") * 12 + F.col("l_discount") * 100).alias("y0"), (F.col("n") * 12 + 10.0).alias("y1"), (10 + F.col("l_tax") * 10).alias("size"), F.lit(12.0).alias("leading"), F.col("l_linestatus").alias("font"), F.col("l_partkey").cast("string").alias("text"))


def t3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    direction = F.when(F.col("text").endswith("7"), "vertical").otherwise("horizontal")
    return sequential.merged_paragraphs(b.select("page", F.col("n").alias("block"), "x0", "x1", "size", "font", direction.alias("orientation"), F.array("y0", F.col("y0") + 4).alias("baselines")), dealt_out=True)


def t7_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return sequential.export_lines(b.select("page", F.col("n").alias("ord"), "text", F.col("x0").alias("x"), F.floor("y0").cast("double").alias("y"), F.lit(20.0).alias("size"), F.lit(8.0).alias("width")))


def i5_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return sequential.suppressed(b.select("page", F.col("n").alias("word"), "x0", (F.col("y0") % 20).alias("y0"), "x1", (F.col("y0") % 20 + 10).alias("y1"), F.col("size").alias("confidence")), dealt_out=True)


def u5b_regular_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return sequential.regular_tables(b.select(F.col("page").alias("table"), F.floor(F.col("n") / 2).cast("int").alias("row"), F.col("n").alias("ord"), F.lit(1).alias("row_span"), F.when(F.col("x0") > 45, 2).otherwise(1).alias("col_span")))


U5B_SQL = """WITH n AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber + l_extendedprice / 1e9) - 1 AS n, l_quantity AS q FROM lineitem),
r AS (SELECT page, n // 2 AS row, sum(CASE WHEN q > 45 THEN 2 ELSE 1 END) AS wide FROM n GROUP BY ALL) SELECT page AS "table", min(wide) = max(wide) AS regular FROM r GROUP BY page"""


def d11_varied_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as words of pages of forty."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.floor(F.col("p_partkey") / 40).alias("page"), F.col("p_partkey").cast("int").alias("ord"), F.col("p_name").alias("word"), (F.col("p_size") > 40).alias("bold"), (F.col("p_size") < 3).alias("italic"), F.lit(10.0).alias("size"))
    return sequential.varied_selection(words, 10)


QUERIES = {
    "l1_layer_visibility": l1_layer_visibility, "l2_outline_counts": l2_outline_counts, "l3_bound_sync": l3_bound_sync, "c5a_cascade": c5a_cascade, "l6_bytes_fate": l6_bytes_fate, "l7_enclosing": l7_enclosing,
    "i5b_regions": i5b_regions, "u8_trust_distances": u8_trust_distances, "v8_upsert": v8_upsert, "p14_merge": p14_merge, "p23_two_up": p23_two_up, "f1_field_values": f1_field_values, "f15_sizes": f15_sizes,
    "i3_luma": i3_luma, "i6_low_confidence": i6_low_confidence, "m5_scaled": m5_scaled, "k5_line_segments": k5_line_segments, "u5e_table_rule": u5e_table_rule, "f23_unique_names": f23_unique_names,
    "t3_paragraphs": t3_paragraphs, "t7_export_lines": t7_export_lines, "i5_suppressed": i5_suppressed, "u5b_regular_tables": u5b_regular_tables, "d11_varied_selection": d11_varied_selection,
}
ORACLE_SQL = {
    "u5b_regular_tables": U5B_SQL,
    "l1_layer_visibility": L1_SQL, "l2_outline_counts": L2_SQL, "l3_bound_sync": L3_SQL, "c5a_cascade": C5A_SQL, "l6_bytes_fate": L6_SQL, "l7_enclosing": L7_SQL, "i5b_regions": I5B_SQL,
    "u8_trust_distances": U8_SQL, "v8_upsert": V8_SQL, "p14_merge": P14_SQL, "p23_two_up": P23_SQL, "f1_field_values": F1_SQL, "f15_sizes": F15_SQL, "i3_luma": I3_SQL, "i6_low_confidence": I6_SQL,
    "m5_scaled": M5_SQL, "k5_line_segments": K5_SQL, "u5e_table_rule": U5E_SQL, "f23_unique_names": F23_SQL,
}
