"""Queries of exchange formats, orientations, verdicts, reading order, regions and checks of what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import dates
from quire.operators import compare, exchange, geometry, graph, journal, layout, model, pages, rules
from quire.plans.record_queries import TREE_SQL, glyphs, tree
from quire.plans.text_queries import docs
from quire.sources.tables import table


def r5_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of fifty customers written as delimited text, with quotes and line ends inside fields, and read again."""
    c = table(spark, sf_dir, "customer")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(';"'), "c_name", F.lit(' says ""hi"";\n"'), F.lit(";"), "c_mktsegment", F.lit(";\r\n"))
    text = c.select(F.floor(F.col("c_custkey") / 50).alias("batch"), "c_custkey", line.alias("line")).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "line"))).alias("l"))
    rows = exchange.parsed_csv(text.select("batch", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("t")), "batch", "t")
    return rows.select("batch", "row", F.size("fields").alias("fields"), F.col("fields")[0].alias("first"), F.col("fields")[1].alias("second"), F.col("fields")[3].alias("last"))


R5_SQL = """SELECT c_custkey // 50 AS batch, row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS "row", 4 AS fields, c_custkey::VARCHAR AS first, c_name || ' says "hi";' || chr(10) AS second, '' AS last FROM customer"""


def r6_csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a delimited text of ragged rows, as a table: how many cells are numeric or missing."""
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(";"), F.format_string("%.2f", F.round("o_totalprice", 2)), F.when(F.col("o_orderkey") % 2 == 0, F.lit(";x,y")).otherwise(""))
    text = o.groupBy("o_custkey").agg(F.array_join(F.concat(F.array(F.lit("key;price;note")), F.collect_list(line)), "\n").alias("t"))
    cells = exchange.csv_tables(text, "o_custkey", "t")
    return cells.groupBy("o_custkey").agg(F.count("*").alias("cells"), F.count(F.when(F.col("numeric"), 1)).alias("numeric"), F.count(F.when(F.col("value") == "", 1)).alias("missing"))


R6_SQL = """SELECT o_custkey, 3 * (count(*) + 1) AS cells, 2 * count(*) AS numeric, count(*) FILTER (o_orderkey % 2 <> 0) AS missing FROM orders GROUP BY o_custkey"""


def r11_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    colour = F.when(F.col("turn") % 2 == 0, "#AABBCC").otherwise("red")
    made = t.select("conv_id", F.to_json(F.struct((F.col("turn") - 1).alias("page"), F.col("role").alias("kind"), F.col("text").alias("contents"), colour.alias("colour"))).alias("json"))
    found = exchange.annotations(made, "json", F.lit(5))
    return found.groupBy("conv_id").agg(F.count(F.when(~F.col("skipped"), 1)).alias("kept"), F.count(F.when(F.col("skipped"), 1)).alias("skipped"), F.count(F.when(F.col("colour") == "#aabbcc", 1)).alias("coloured"), F.sum(F.length("contents")).alias("letters"))


R11_SQL = """SELECT conv_id, count(*) FILTER (turn BETWEEN 1 AND 5) AS kept, count(*) FILTER (NOT turn BETWEEN 1 AND 5) AS skipped, count(*) FILTER (turn % 2 = 0) AS coloured, sum(length(text)) AS letters FROM conversations GROUP BY conv_id"""


def r12_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    xml = F.concat(F.lit('<x:m xmlns:x="u:x" xmlns:d="u:d"><d:title>'), "p_name", F.lit("</d:title><d:kind>"), "p_type", F.lit("</d:kind></x:m>"))
    return p.select("p_partkey", exchange.packet_value(xml, "title").alias("title"), exchange.packet_value(xml, "kind").alias("kind"))


R12_SQL = "SELECT p_partkey, p_name AS title, p_type AS kind FROM part"


def f18_escaped_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    text = F.concat(F.lit("("), "p_name", F.lit("\\"), F.when(F.col("p_partkey") % 2 == 0, "é").otherwise(""))
    return part.select("p_partkey", F.length(exchange.escaped_string(text)).alias("n"), F.left(exchange.escaped_string(text), F.lit(3)).alias("start"))


F18_SQL = r"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 6 + 4 * (length(p_name) + 3) ELSE length(p_name) + 6 END AS n, CASE WHEN p_partkey % 2 = 0 THEN '<FE' ELSE '(\(' END AS start FROM part"


def t5_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's direction from its angle, and each block's: the first vertical or reversed one, else skewed if any."""
    angle = F.radians((F.floor("l_extendedprice").cast("int") % 4) * 90 + F.floor(F.col("l_discount") * 100 + 0.5))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("l_linenumber + l_extendedprice / 1e9").alias("ord"), layout.line_orientation(angle).alias("k"))
    return layout.block_orientation(lines, ["l_orderkey"], "ord", "k")


T5_SQL = """WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber + l_extendedprice / 1e9) AS n, radians((floor(l_extendedprice)::BIGINT % 4) * 90 + floor(l_discount * 100 + 0.5)) AS a FROM lineitem),
k AS (SELECT *, CASE WHEN cos(a) >= 0.98 THEN 'horizontal' WHEN cos(a) <= -0.98 THEN 'reversed' WHEN abs(sin(a)) >= 0.98 THEN 'vertical' ELSE 'skewed' END AS k FROM a)
SELECT l_orderkey, coalesce(arg_min(k, n) FILTER (k IN ('vertical', 'reversed')), CASE WHEN bool_or(k = 'skewed') THEN 'skewed' ELSE 'horizontal' END) AS block FROM k GROUP BY l_orderkey"""


def t14_editability(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey") % 10
    verdict = F.when(n == 1, "not-editable").when(k.isin(1, 2), "rotated").when(k == 3, "skewed").when(k == 4, "type3").when(F.col("p_brand").endswith("5"), "substituted").when(F.col("p_brand").isin("Brand#11", "Brand#21", "Brand#31"), "editable").otherwise("substituted")
    return table(spark, sf_dir, "part").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


T14_SQL = """SELECT CASE WHEN p_size = 1 THEN 'not-editable' WHEN p_partkey % 10 IN (1, 2) THEN 'rotated' WHEN p_partkey % 10 = 3 THEN 'skewed' WHEN p_partkey % 10 = 4 THEN 'type3' WHEN ends_with(p_brand, '5') THEN 'substituted'
 WHEN p_brand IN ('Brand#11', 'Brand#21', 'Brand#31') THEN 'editable' ELSE 'substituted' END AS verdict, count(*) AS n FROM part GROUP BY 1"""


def t19_line_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of part names from glyph advances: a glyph's is 400 plus its code, in thousandths of the size."""
    g = glyphs(spark, sf_dir)
    advance = g.select("ch").distinct().select("ch", (F.ascii("ch") + 400).alias("advance"))
    return layout.line_widths(g, advance, ["p_partkey"]).select("p_partkey", F.round("width", 4).alias("width"))


T19_SQL = "SELECT p_partkey, round(sum((ascii(c) + 400) * 10.0 / 1000), 4) AS width FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part) WHERE c <> '' GROUP BY p_partkey"


def g2_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders below each customer in reading order, as a digest, and where the customer stands in the whole order."""
    leaves = graph.preorder(tree(spark, sf_dir)).where("depth = 3").withColumn("above", F.expr("substring(path, 1, length(path) - 13)"))
    listed = leaves.groupBy("above").agg(F.sort_array(F.collect_list(F.struct("path", "key"))).alias("l"))
    return listed.select("above", F.size("l").alias("n"), F.md5(F.array_join(F.transform("l", lambda x: x["key"]), ",")).alias("order"))


G2_SQL = """SELECT lpad(n_regionkey::VARCHAR, 12, '0') || '/' || lpad(n_nationkey::VARCHAR, 12, '0') || '/' || lpad(c_custkey::VARCHAR, 12, '0') AS above, count(*) AS n, md5(string_agg('o' || o_orderkey, ',' ORDER BY o_orderkey)) AS "order"
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey, c_custkey"""


def l4_data_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree(spark, sf_dir)
    placed = graph.preorder(nodes)
    return placed.join(nodes.select(F.col("parent").alias("key")).where("key is not null").distinct(), "key", "left_anti").select("key", "path")


L4_SQL = f"""WITH RECURSIVE {TREE_SQL}, w AS (SELECT key, lpad(ord::VARCHAR, 12, '0') AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.key, w.path || '/' || lpad(t.ord::VARCHAR, 12, '0') FROM w JOIN tree t ON t.parent = w.key)
SELECT key, path FROM w WHERE key NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)"""


def p9_flat_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries to depth 2 in reading order; those without a page (here those of three letters) are counted."""
    placed = graph.preorder(tree(spark, sf_dir)).where("depth < 3")
    own = placed.withColumn("page", F.when(F.length("key") != 3, F.lit(1)))
    return own.groupBy("depth").agg(F.count("page").alias("entries"), F.count(F.when(F.col("page").isNull(), 1)).alias("skipped"))


P9_SQL = """WITH k AS (SELECT 'r' || r_regionkey AS key, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer)
SELECT depth, count(*) FILTER (length(key) <> 3) AS entries, count(*) FILTER (length(key) = 3) AS skipped FROM k GROUP BY depth"""


def p15_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages picked from other documents with a turn: those that exist get places in order, the others are refused."""
    size = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pages"))
    picks = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 9).alias("page"), F.expr("l_linenumber + l_extendedprice / 1e9").alias("ord"), ((F.col("l_suppkey") * 90) % 360).alias("turn"))
    return pages.composed(picks, size, ["l_orderkey"]).select("l_orderkey", "page", "turn", "place")


P15_SQL = """WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, l_partkey % 9 AS page, l_linenumber + l_extendedprice / 1e9 AS o, (l_suppkey * 90) % 360 AS turn FROM lineitem)
SELECT l_orderkey, page, turn, CASE WHEN page < n THEN row_number() OVER (PARTITION BY l_orderkey, page < n ORDER BY o) - 1 END AS place FROM p JOIN s USING (l_orderkey)"""


# What a sweep takes out of a text, by category.
SWEEP = {"tabs": "\t", "double spaces": "  +", "trailing spaces": " +(?=\n|$)", "pipes": r" \| "}


def u1_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sweep finds and removes by category; the sweep of the result must find nothing."""
    text = docs(spark, sf_dir).select("doc_id", "text")
    clean = F.col("text")
    for pattern in SWEEP.values():
        clean = F.regexp_replace(clean, pattern, " " if pattern in ("\t", "  +", r" \| ") else "")
    for pattern in reversed(SWEEP.values()):
        clean = F.regexp_replace(clean, pattern, " " if pattern != SWEEP["trailing spaces"] else "")
    after = text.withColumn("clean", clean)
    counts = [F.struct(F.lit(k).alias("category"), F.regexp_count("text", F.lit(p)).alias("found"), F.regexp_count("clean", F.lit(p)).alias("left")) for k, p in SWEEP.items()]
    return after.select(F.explode(F.array(*counts)).alias("c")).groupBy("c.category").agg(F.sum("c.found").alias("found"), F.sum("c.left").alias("left"))


U1_SQL = r"""WITH c AS (SELECT unnest(['tabs', 'double spaces', 'trailing spaces', 'pipes']) AS category, unnest([len(regexp_extract_all(text, '\t')), len(regexp_extract_all(text, '  +')), len(regexp_extract_all(text || chr(10), ' +\n')), len(regexp_extract_all(text, ' \| '))]) AS found FROM documents)
SELECT category, sum(found) AS found, 0 AS left FROM c GROUP BY category"""


def u3_redaction_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts under two marks on each part's name: glyphs whose centres lie from 20 to 80, and from 100 to 140."""
    g = glyphs(spark, sf_dir).withColumns({"y0": F.lit(0.0), "y1": F.lit(10.0)})
    mark = lambda n, a, b: F.struct(F.lit(n).alias("mark"), F.lit(a).alias("x0"), F.lit(0.0).alias("y0"), F.lit(b).alias("x1"), F.lit(10.0).alias("y1"))
    marks = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(mark(1, 20.0, 80.0), mark(2, 100.0, 140.0))).alias("m")).select("p_partkey", "m.*")
    return rules.redaction_needles(g, marks, ["p_partkey"])


U3_SQL = """WITH s AS (SELECT p_partkey, trim(substring(p_name, 3, 6)) AS needle FROM part UNION SELECT p_partkey, trim(substring(p_name, 11, 4)) FROM part) SELECT * FROM s WHERE length(needle) > 1"""


def v3_restorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's journal: every third is of another schema, and its cursor may lie beyond its entries."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("entries"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("cursor"))
    return journal.restorable(e.withColumn("schema", F.when(F.col("user_id") % 3 == 0, 1).otherwise(2)), 2)


V3_SQL = """SELECT user_id, count(*) AS entries, max(json_extract_string(props, '$.k')::BIGINT) AS cursor, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 2 END AS schema,
 user_id % 3 <> 0 AND max(json_extract_string(props, '$.k')::BIGINT) BETWEEN 0 AND count(*) AS sound FROM events GROUP BY user_id"""


def v7_draft_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = journal.newest_first(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return found.select("user_id", "event_id", "place")


V7_SQL = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events"


def c3_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = exchange.flipped(F.col("l_quantity"), F.col("l_quantity") + 5, F.lit(842))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(low).alias("low"), F.max(high).alias("high"))


C3_SQL = "SELECT l_orderkey, min(842 - l_quantity - 5) AS low, max(842 - l_quantity) AS high FROM lineitem GROUP BY l_orderkey"


def d3_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page positions of a document and the one after it, up to the longer one."""
    count = docs(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).alias("pages"))
    return pages.positions(count, count.select((F.col("doc_id") - 1).alias("doc_id"), "pages"), "doc_id")


D3_SQL = """WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), b AS (SELECT coalesce(a.doc_id, b.doc_id - 1) AS doc_id, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS m FROM p a FULL JOIN p b ON b.doc_id = a.doc_id + 1),
e AS (SELECT doc_id, n, m, unnest(range(greatest(n, m))) AS position FROM b) SELECT doc_id, position, CASE WHEN position >= m THEN 'left' WHEN position >= n THEN 'right' ELSE 'both' END AS side FROM e"""


def d7_grey_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and worst tile difference of two greys a pixel, and whether shapes differ, by page."""
    a, b = F.floor("l_extendedprice").cast("int") % 256, F.floor(F.col("l_extendedprice") * (1 - F.col("l_tax"))).cast("int") % 256
    wide = F.when(F.col("l_suppkey") % 3 == 0, 620).otherwise(601)
    p = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 5).alias("y"), a.alias("a"), b.alias("b"), F.lit(600).alias("aw"), F.lit(800).alias("ah"), wide.alias("bw"), F.lit(800).alias("bh"))
    made = compare.grey_difference(p, ["l_suppkey"])
    return made.select("l_suppkey", F.round("mean", 8).alias("mean"), F.round("worst", 8).alias("worst"), "shape_differs")


D7_SQL = """WITH p AS (SELECT l_suppkey, floor(l_quantity / 16)::BIGINT AS tx, (l_linenumber * 5) // 16 AS ty, abs(floor(l_extendedprice)::BIGINT % 256 - floor(l_extendedprice * (1 - l_tax))::BIGINT % 256) AS d FROM lineitem), t AS (SELECT l_suppkey, tx, ty, sum(d) AS d, count(*) AS n FROM p GROUP BY ALL)
SELECT l_suppkey, round(sum(d) / sum(n) / 255, 8) AS mean, round(max(d / n / 255), 8) AS worst, l_suppkey % 3 = 0 AS shape_differs FROM t GROUP BY l_suppkey"""


def d10_font_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate by median score, and the runner-up."""
    found = compare.best_match(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "l_discount")
    return found.withColumn("score", F.round("score", 6))


D10_SQL = """WITH m AS (SELECT l_suppkey, l_returnflag, median(l_discount) AS s FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, l_returnflag) AS k FROM m)
SELECT l_suppkey, max(l_returnflag) FILTER (k = 1) AS best, round(max(s) FILTER (k = 1), 6) AS score, max(l_returnflag) FILTER (k = 2) AS second FROM r GROUP BY l_suppkey"""


def k3_rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that cross, directly or through others, on a supplier's page: horizontal ones at a day, vertical ones at a
    price. How many groups there are, and how large the largest is."""
    line = table(spark, sf_dir, "lineitem")
    day = F.datediff("l_shipdate", F.lit("1990-01-01"))
    flat = line.where("l_returnflag = 'R'").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), day.alias("y"), F.floor(F.col("l_extendedprice") / 20).alias("x0"))
    tall = line.where("l_returnflag = 'A'").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("b"), F.floor(F.col("l_extendedprice") / 20).alias("x"), day.alias("y0"))
    flat, tall = flat.withColumn("x1", F.col("x0") + 60), tall.withColumn("y1", F.col("y0") + 60)
    met = geometry.crossing_rules(flat, tall, ["l_suppkey"], 60)
    groups = graph.linked_groups(met.select((F.col("l_suppkey") * 10_000_000 + F.col("a")).alias("a"), (F.col("l_suppkey") * 10_000_000 + F.col("b")).alias("b")))
    sizes = groups.groupBy((F.floor(F.col("first") / 10_000_000)).alias("l_suppkey"), "first").agg(F.count("*").alias("n"))
    return sizes.groupBy("l_suppkey").agg(F.count("*").alias("groups"), F.max("n").alias("largest"))


K3_SQL = """WITH RECURSIVE l AS (SELECT l_suppkey AS s, l_suppkey * 10000000 + l_orderkey * 10 + l_linenumber AS id, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS d, floor(l_extendedprice / 20)::BIGINT AS p, l_returnflag AS f FROM lineitem),
m AS (SELECT DISTINCT a.id AS a, b.id AS b FROM l a JOIN l b ON a.s = b.s AND a.f = 'R' AND b.f = 'A' AND b.p BETWEEN a.p AND a.p + 60 AND a.d BETWEEN b.d AND b.d + 60),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), c AS (SELECT a AS node, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.node),
g AS (SELECT node, min(r) AS first FROM c GROUP BY node), n AS (SELECT first // 10000000 AS l_suppkey, first, count(*) AS n FROM g GROUP BY ALL)
SELECT l_suppkey, count(*) AS groups, max(n) AS largest FROM n GROUP BY l_suppkey"""


def k4_text_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters whose centres lie in boxes of 30 by 30 laid from 15 on, by part; every second letter stands a line lower."""
    g = glyphs(spark, sf_dir).withColumn("y0", F.col("ord") % 2 * 40.0).withColumn("y1", F.col("y0") + 10)
    return geometry.text_in_boxes(g, ["p_partkey"], 30.0, 30.0, x=15.0)


K4_SQL = """WITH g AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ''), 1) - 1 AS o, unnest(string_split(p_name, '')) AS ch FROM part), c AS (SELECT *, o * 10 + 5 + CASE WHEN ch = 'a' THEN 1 ELSE 0 END AS c FROM g WHERE ch <> ' ')
SELECT p_partkey, floor((c - 15) / 30)::BIGINT AS "column", CASE WHEN o % 2 = 1 THEN 1 ELSE 0 END AS "row", string_agg(ch, '' ORDER BY o) AS text FROM c WHERE c >= 15 GROUP BY ALL"""


def r9_form_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as form data, with parentheses to escape, and read again."""
    entry = F.concat(F.lit("<< /T (o"), F.col("o_orderkey").cast("string"), F.lit(r"\(x\)) /V ("), "o_orderpriority", F.lit(r"\\) >>"))
    text = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(entry), " ").alias("t"))
    found = text.select("o_custkey", F.explode(exchange.field_entries(F.col("t"))).alias("f"))
    return found.select("o_custkey", "f.name", "f.value")


R9_SQL = r"SELECT o_custkey, 'o' || o_orderkey || '(x)' AS name, o_orderpriority || '\' AS value FROM orders"


def f8_review_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "'D:'yyyyMMddHHmmss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format("o_orderdate", "'D:'yyyyMMdd'x'")).otherwise("soon")
    return order.select("o_orderkey", dates.review_seconds(text).alias("seconds"))


F8_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN epoch(o_orderdate)::BIGINT ELSE 0 END AS seconds FROM orders"


def i5a_edge_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at most two characters near the edges of pages 50 wide."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").cast("string").alias("text"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 1).alias("x1"))
    return model.edge_marks(line, F.lit(50.0)).groupBy("l_suppkey").agg(F.count(F.when(~F.col("mark"), 1)).alias("kept"), F.count(F.when(F.col("mark"), 1)).alias("dropped"))


I5A_SQL = "SELECT l_suppkey, count(*) FILTER (NOT m) AS kept, count(*) FILTER (m) AS dropped FROM (SELECT l_suppkey, length(l_partkey::VARCHAR) <= 2 AND (l_quantity < 1.5 OR l_quantity + 1 > 48.5) AS m FROM lineitem) GROUP BY l_suppkey"


def v6_document_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as drafts that own keys, each fourth order its own, else three orders one; open documents and other windows
    refer to some."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).otherwise(F.floor(F.col("o_orderkey") / 3)).alias("key"))
    drafts = o.select(F.col("o_custkey").alias("manifest"), "key")
    return journal.document_cleanup(drafts, o.where("o_orderstatus = 'P'").select("key"), o.where("o_orderpriority like '1%'").select("key"))


V6_SQL = """WITH o AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE o_orderkey // 3 END AS key FROM orders)
SELECT min(o_custkey) AS manifest, key FROM o GROUP BY key HAVING count(DISTINCT o_custkey) = 1 AND NOT bool_or(o_orderstatus = 'P') AND NOT bool_or(starts_with(o_orderpriority, '1'))"""


def t16_font_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = [("Bold", True, False), ("Italic", False, True), ("Regular", False, False)]
    return table(spark, sf_dir, "part").select("p_partkey", exchange.best_face(F.col("p_size") > 25, F.col("p_partkey") % 2 == 1, faces).alias("face"))


T16_SQL = "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Bold' WHEN p_partkey % 2 = 1 THEN 'Italic' ELSE 'Regular' END AS face FROM part"

QUERIES = {
    "r9_form_data": r9_form_data, "f8_review_dates": f8_review_dates, "i5a_edge_marks": i5a_edge_marks, "v6_document_cleanup": v6_document_cleanup, "t16_font_match": t16_font_match,
    "r5_csv_rows": r5_csv_rows, "r6_csv_tables": r6_csv_tables, "r11_annotations": r11_annotations, "r12_packets": r12_packets, "f18_escaped_strings": f18_escaped_strings, "t5_orientation": t5_orientation, "t14_editability": t14_editability,
    "t19_line_widths": t19_line_widths, "g2_reading_order": g2_reading_order, "l4_data_leaves": l4_data_leaves, "p9_flat_outline": p9_flat_outline, "p15_compose": p15_compose, "u1_sanitize": u1_sanitize,
    "u3_redaction_needles": u3_redaction_needles, "v3_restorable": v3_restorable, "v7_draft_order": v7_draft_order, "c3_flipped": c3_flipped, "d3_positions": d3_positions, "d7_grey_pages": d7_grey_pages,
    "d10_font_match": d10_font_match, "k3_rule_groups": k3_rule_groups, "k4_text_in_boxes": k4_text_in_boxes,
}
ORACLE_SQL = {
    "r9_form_data": R9_SQL, "f8_review_dates": F8_SQL, "i5a_edge_marks": I5A_SQL, "v6_document_cleanup": V6_SQL, "t16_font_match": T16_SQL,
    "r5_csv_rows": R5_SQL, "r6_csv_tables": R6_SQL, "r11_annotations": R11_SQL, "r12_packets": R12_SQL, "f18_escaped_strings": F18_SQL, "t5_orientation": T5_SQL, "t14_editability": T14_SQL, "t19_line_widths": T19_SQL,
    "g2_reading_order": G2_SQL, "l4_data_leaves": L4_SQL, "p9_flat_outline": P9_SQL, "p15_compose": P15_SQL, "u1_sanitize": U1_SQL, "u3_redaction_needles": U3_SQL, "v3_restorable": V3_SQL, "v7_draft_order": V7_SQL, "c3_flipped": C3_SQL,
    "d3_positions": D3_SQL, "d7_grey_pages": D7_SQL, "d10_font_match": D10_SQL, "k3_rule_groups": K3_SQL, "k4_text_in_boxes": K4_SQL,
}
