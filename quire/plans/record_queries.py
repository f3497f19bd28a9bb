"""Queries over records: threads, structure, graphs, journals, geometry, grey levels, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import compare, forms, geometry, graph, journal, layout, model, rules
from quire.operators.groups import parts_by_rows
from quire.sources.tables import table

# A line's place in its order; line numbers repeat, so prices settle ties.
LINE_ORDER_SQL = "l_linenumber + l_extendedprice / 1e9"

# A turn as a comment: it answers the turn before.
COMMENTS_SQL = "n AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, turn AS ts, conv_id, role, text FROM conversations)"


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    return t.select(key.alias("id"), F.when(F.col("turn") > 0, key - 1).alias("parent"), F.col("turn").alias("ts"), F.col("turn").alias("ord"), "conv_id", "role", "text")


def c1_comment_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.threads(comments(spark, sf_dir))


C1_SQL = f"""WITH RECURSIVE {COMMENTS_SQL}, t AS (SELECT id AS root, id, 0 AS depth, ts FROM n WHERE parent IS NULL UNION ALL SELECT t.root, n.id, t.depth + 1, n.ts FROM t JOIN n ON n.parent = t.id)
SELECT root, id, depth, row_number() OVER (PARTITION BY root ORDER BY ts, id) - 1 AS place FROM t WHERE depth > 0"""


def c1_thread_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn is a review, every fourth a mark, and every seventh belongs to a group and begins a thread."""
    k = F.col("ts")
    state = F.when(k % 4 == 3, F.when(F.col("conv_id") % 2 == 0, "Marked").otherwise("Unmarked")).when(k % 3 == 2, F.when(k % 2 == 0, "Accepted").otherwise("Rejected"))
    notes = comments(spark, sf_dir).withColumns({"reply_type": F.when(k % 7 == 6, "Group").otherwise("R"), "author": F.col("role"), "state": state, "state_model": F.when(k % 4 == 3, "Marked")})
    return graph.thread_states(notes)


C1S_SQL = f"""WITH RECURSIVE {COMMENTS_SQL}, g AS (SELECT *, parent IS NULL OR ts % 7 = 6 AS top FROM n),
t AS (SELECT id AS root, id, ts, role, FALSE AS below, conv_id FROM g WHERE top UNION ALL SELECT t.root, g.id, g.ts, g.role, TRUE, g.conv_id FROM t JOIN g ON g.parent = t.id AND NOT g.top),
s AS (SELECT *, ts % 4 = 3 AS mark, ts % 4 <> 3 AND ts % 3 = 2 AS review FROM t WHERE below)
SELECT root, count(*) AS records, max_by(CASE WHEN ts % 2 = 0 THEN 'Accepted' ELSE 'Rejected' END, ts) FILTER (review) AS state, max_by(role, ts) FILTER (review) AS author, max(ts) FILTER (review) AS at, coalesce(bool_or(mark AND conv_id % 2 = 0), FALSE) AS marked FROM s GROUP BY root"""


def d8_annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.kind_counts(table(spark, sf_dir, "conversations"), "role", ["system"])


D8_SQL = "SELECT role, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY role"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, parent, ord): regions hold nations, nations customers, customers orders."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_nationkey").cast("long"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.col("c_custkey"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderkey"))
    return r.union(n).union(c).union(o)


TREE_SQL = """tree AS (SELECT 'r' || r_regionkey AS key, NULL AS parent, r_regionkey::BIGINT AS ord FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey FROM orders)"""


def g1_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.preorder(tree(spark, sf_dir))


G1_SQL = f"""WITH RECURSIVE {TREE_SQL}, w AS (SELECT key, 0 AS depth, lpad(ord::VARCHAR, 12, '0') AS path FROM tree WHERE parent IS NULL
 UNION ALL SELECT t.key, w.depth + 1, w.path || '/' || lpad(t.ord::VARCHAR, 12, '0') FROM w JOIN tree t ON t.parent = w.key) SELECT key, depth, path FROM w"""


def g3_node_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order stands on the page of its last digit; what pages every node of the tree has below it."""
    nodes = tree(spark, sf_dir)
    found = graph.pages_below(nodes, nodes.where("key like 'o%'").select("key", (F.col("ord") % 10).cast("int").alias("page")))
    return found.select("key", F.array_join("pages", ",").alias("pages"))


G3_SQL = f"""WITH RECURSIVE {TREE_SQL}, w AS (SELECT key, parent, ord % 10 AS page FROM tree WHERE starts_with(key, 'o') UNION SELECT t.key, t.parent, w.page FROM w JOIN tree t ON t.key = w.parent)
SELECT key, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM (SELECT DISTINCT key, page FROM w) GROUP BY key"""


def g5_resolved_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of parts: each number maps to its half, but some to a standard role of their own, and 1 to P."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    target = F.when(k <= 1, F.lit("P")).when(k % 7 == 3, F.concat(F.lit("H"), (k % 6 + 1).cast("string"))).otherwise(F.floor(k / 2).cast("string"))
    return graph.resolved_roles(part.select(k.cast("string").alias("role"), target.alias("target")))


G5_SQL = """WITH RECURSIVE m AS (SELECT p_partkey AS k, CASE WHEN p_partkey <= 1 THEN 'P' WHEN p_partkey % 7 = 3 THEN 'H' || (p_partkey % 6 + 1) END AS role FROM part),
w AS (SELECT k AS start, k FROM m UNION ALL SELECT w.start, w.k // 2 FROM w JOIN m ON m.k = w.k WHERE m.role IS NULL)
SELECT w.start::VARCHAR AS role, coalesce(max(m.role), min(w.k)::VARCHAR) AS final FROM w LEFT JOIN m ON m.k = w.k GROUP BY w.start"""


def g6_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the customers of the first market segment over orders and parts to suppliers."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    line = table(spark, sf_dir, "lineitem")
    text = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = table(spark, sf_dir, "orders").select(text("c", "o_custkey").alias("src"), text("o", "o_orderkey").alias("dst"))
    edges = edges.union(line.select(text("o", "l_orderkey"), text("p", "l_partkey"))).union(line.select(text("p", "l_partkey"), text("s", "l_suppkey")))
    return graph.reachable(c, edges)


G6_SQL = """WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c)),
p AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT * FROM o)), s AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT * FROM p))
SELECT 'c' || c_custkey AS node, 0 AS distance FROM c UNION ALL SELECT 'o' || o_orderkey, 1 FROM o UNION ALL SELECT 'p' || l_partkey, 2 FROM p UNION ALL SELECT 's' || l_suppkey, 3 FROM s"""


def u5_structure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the headings of a customer's document, their lines as list items of various soundness."""
    o = table(spark, sf_dir, "orders")
    level = F.substring("o_orderpriority", 1, 1)
    heads = o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), F.lit(None).cast("string").alias("parent"), F.col("o_orderkey").alias("ord"), F.when(level == "5", "H").otherwise(F.concat(F.lit("H"), level)).alias("role"))
    line = table(spark, sf_dir, "lineitem")
    parts = parts_by_rows(o, line)
    line = line.select("l_orderkey", "l_linenumber").repartition(parts, "l_orderkey").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").repartition(parts, "l_orderkey"), "l_orderkey")
    kinds = F.array(*[F.lit(r) for r in ("LI", "L", "Figure", "TD", "LBody", "TR", "P")])
    items = line.select(F.col("o_custkey").alias("doc_id"), F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber").alias("key"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.get(kinds, F.col("l_linenumber") - 1).alias("role"))
    nodes = heads.union(items).withColumns({"alt": F.lit(""), "actual": F.lit(None).cast("string")})
    return rules.run_rules(nodes, parts).groupBy("rule", "reason").agg(F.count("*").alias("n"))


U5_SQL = """WITH h AS (SELECT o_custkey AS d, o_orderkey AS k, left(o_orderpriority, 1) AS p FROM orders), n AS (SELECT *, p::INT AS l, lag(p::INT) OVER (PARTITION BY d ORDER BY k) AS was FROM h WHERE p <> '5'),
i AS (SELECT ['LI', 'L', 'Figure', 'TD', 'LBody', 'TR', 'P'][l_linenumber] AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'heading' AS rule, 'first' AS reason, count(*) AS n FROM n WHERE was IS NULL AND l <> 1 HAVING count(*) > 0
UNION ALL SELECT 'heading', 'skip', count(*) FROM n WHERE l > was + 1 HAVING count(*) > 0
UNION ALL SELECT 'heading', 'mixed', count(*) FROM (SELECT d FROM h GROUP BY d HAVING bool_or(p = '5') AND bool_or(p <> '5')) HAVING count(*) > 0
UNION ALL SELECT 'figure', 'no-text', count(*) FROM i WHERE role = 'Figure' HAVING count(*) > 0
UNION ALL SELECT 'nesting', CASE role WHEN 'LI' THEN 'item-outside-list' WHEN 'LBody' THEN 'part-outside-item' WHEN 'TD' THEN 'cell-outside-row' ELSE 'row-outside-table' END, count(*) FROM i WHERE role IN ('LI', 'LBody', 'TD', 'TR') GROUP BY role
UNION ALL SELECT 'nesting', 'no-body', count(*) FROM i WHERE role = 'LI' HAVING count(*) > 0"""


# What an event of a kind does to a user's document.
ACTIONS = {"click": "append", "view": "append", "purchase": "append", "signup": "redo", "logout": "undo", "login": "append", "error": "undo"}


def v1_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    e = table(spark, sf_dir, "events")
    return journal.fold_journal(e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), F.coalesce(kinds[F.col("event_type")], F.lit("undo")).alias("action")))


V1_SQL = """WITH RECURSIVE e AS (SELECT user_id AS doc, event_id AS ord, CASE WHEN event_type IN ('click', 'view', 'purchase', 'login') THEN 'append' WHEN event_type = 'signup' THEN 'redo' ELSE 'undo' END AS action,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT doc, 0::BIGINT AS ord, 0::BIGINT AS k, 0::BIGINT AS kept, 0::BIGINT AS cursor FROM e GROUP BY doc
 UNION ALL SELECT e.doc, e.ord, e.k, CASE WHEN action = 'append' THEN cursor + 1 ELSE kept END, CASE action WHEN 'append' THEN cursor + 1 WHEN 'undo' THEN greatest(0, cursor - 1) ELSE least(kept, cursor + 1) END FROM f JOIN e ON e.doc = f.doc AND e.k = f.k + 1)
SELECT doc, ord, kept, cursor FROM f WHERE k > 0"""


def v4_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), F.floor(F.abs("value") * 100).cast("long").alias("bytes"))
    return journal.retained(e, 100_000)


V4_SQL = """WITH e AS (SELECT user_id AS doc, event_id AS ord, floor(abs(value) * 100)::BIGINT AS bytes FROM events)
SELECT doc, ord, bytes, row_number() OVER (PARTITION BY doc ORDER BY ord DESC) <= 2 OR sum(bytes) OVER (PARTITION BY doc ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) <= 100000 AS kept FROM e"""


def v5_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no returned line of a large quantity and no line of a very small one refers to."""
    line = table(spark, sf_dir, "lineitem")
    stored = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    refer = lambda cond: line.where(cond).select(F.col("l_partkey").alias("key"))
    return journal.cleanup(stored, refer("l_returnflag = 'R' and l_quantity > 45"), refer("l_quantity < 2"))


V5_SQL = "SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 OR l_quantity < 2)"


def l5_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("starred", F.col("value") > 90)
    found = journal.recent(e, ["user_id"], ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 3)
    return found.select("user_id", "event_type", "event_id", "starred", "rank")


L5_SQL = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn, max(value > 90) OVER (PARTITION BY user_id, event_type) AS starred FROM events),
r AS (SELECT user_id, event_type, event_id, starred, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM e WHERE rn = 1) SELECT * FROM r WHERE rank <= 3"""


def l8_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as objects, lines of the largest quantities as references; one brand needs none."""
    objects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("kind"))
    references = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("key"))
    return model.orphans(objects, references, ["Brand#11"])


L8_SQL = "SELECT p_partkey AS key, p_brand AS kind FROM part WHERE p_brand <> 'Brand#11' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)"


def m1_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of orders' lines as points; null where the ring crosses itself."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(LINE_ORDER_SQL).alias("ord"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    made = geometry.chains(p, ["l_orderkey"]).withColumn("area", F.when(~F.isnan("area"), F.col("area")))
    return made.select("l_orderkey", "n", *[F.round(c, 6).alias(c) for c in ("length", "perimeter", "area", "bearing")])


# Rings of points p (k, i, x, y): repeated points go, and a last one that repeats the first; then whether edges meet.
RING_SQL = """d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY k ORDER BY i)),
c AS (SELECT k, x, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS n, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM d WHERE px IS NULL OR px <> x OR py <> y WINDOW w AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i - 1 AS i, x AS ax, y AS ay FROM c WHERE NOT (n > 1 AND i = n AND x = fx AND y = fy)),
e AS (SELECT *, coalesce(lead(ax) OVER w, first_value(ax) OVER w) AS bx, coalesce(lead(ay) OVER w, first_value(ay) OVER w) AS yb, count(*) OVER (PARTITION BY k) AS n FROM r WINDOW w AS (PARTITION BY k ORDER BY i)),
j AS (SELECT a.k, a.ax, a.ay, a.bx, a.yb, b.ax AS cx, b.ay AS cy, b.bx AS dx, b.yb AS yd FROM e a JOIN e b ON a.k = b.k AND b.i >= a.i + 2 AND NOT (a.i = 0 AND b.i = a.n - 1)),
o AS (SELECT *, (bx - ax) * (cy - ay) - (yb - ay) * (cx - ax) AS abc, (bx - ax) * (yd - ay) - (yb - ay) * (dx - ax) AS abd, (dx - cx) * (ay - cy) - (yd - cy) * (ax - cx) AS cda, (dx - cx) * (yb - cy) - (yd - cy) * (bx - cx) AS cdb FROM j),
x AS (SELECT k, bool_or((sign(abc) * sign(abd) < 0 AND sign(cda) * sign(cdb) < 0)
 OR (abc = 0 AND cx BETWEEN least(ax, bx) AND greatest(ax, bx) AND cy BETWEEN least(ay, yb) AND greatest(ay, yb)) OR (abd = 0 AND dx BETWEEN least(ax, bx) AND greatest(ax, bx) AND yd BETWEEN least(ay, yb) AND greatest(ay, yb))
 OR (cda = 0 AND ax BETWEEN least(cx, dx) AND greatest(cx, dx) AND ay BETWEEN least(cy, yd) AND greatest(cy, yd)) OR (cdb = 0 AND bx BETWEEN least(cx, dx) AND greatest(cx, dx) AND yb BETWEEN least(cy, yd) AND greatest(cy, yd))) AS crosses FROM o GROUP BY k)"""

M1_SQL = f"""WITH p AS (SELECT l_orderkey AS k, l_linenumber + l_extendedprice / 1e9 AS i, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), {RING_SQL},
q AS (SELECT k, i, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY k ORDER BY i)),
s AS (SELECT k, count(*) AS n, sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)) AS length, sum(sqrt((coalesce(nx, fx) - x) ** 2 + (coalesce(ny, fy) - y) ** 2)) AS perimeter,
 abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 AS area, max(x) - min(x) AS w, max(y) - min(y) AS h, max(degrees(atan2(ny - y, nx - x))) FILTER (rn = 1) AS b FROM q GROUP BY k)
SELECT s.k AS l_orderkey, n, round(CASE WHEN n = 2 THEN 2 * w + h ELSE length END, 6) AS length, round(CASE WHEN n = 2 THEN 2 * (w + h) ELSE perimeter END, 6) AS perimeter,
 CASE WHEN n = 2 THEN round(w * h, 6) WHEN NOT coalesce(crosses, FALSE) THEN round(area, 6) END AS area, round((b + 360) % 360, 6) AS bearing FROM s LEFT JOIN x ON s.k = x.k WHERE n >= 2"""


def m3_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(LINE_ORDER_SQL).alias("ord"), F.col("l_quantity").alias("x"), F.floor("l_extendedprice").alias("y"))
    return geometry.crosses_itself(p, ["l_orderkey"])


M3_SQL = f"""WITH p AS (SELECT l_orderkey AS k, l_linenumber + l_extendedprice / 1e9 AS i, l_quantity AS x, floor(l_extendedprice) AS y FROM lineitem), {RING_SQL}
SELECT a.k AS l_orderkey, coalesce(crosses, FALSE) AS crosses FROM (SELECT DISTINCT k FROM p) a LEFT JOIN x USING (k)"""


def c5b_rect_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rect = line.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_discount") * 100 + 3).alias("y1"))
    marks = rect.where("l_linenumber = 1").drop("l_linenumber")
    return geometry.overlaps(rect.where("l_linenumber > 1"), marks, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


C5B_SQL = """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 5 AS x1, l_discount * 100 + 3 AS y1 FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber FROM r a WHERE a.l_linenumber > 1 AND EXISTS (SELECT 1 FROM r b WHERE a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0)"""


def k1_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1990-01-01"))
    i = table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("start"), (day + F.floor(F.col("l_quantity") / 10)).alias("stop"))
    return geometry.merged(i, ["l_suppkey"], 1)


K1_SQL = """WITH i AS (SELECT l_suppkey, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS start, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + floor(l_quantity / 10)::BIGINT AS stop FROM lineitem),
f AS (SELECT *, max(stop) OVER (PARTITION BY l_suppkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT l_suppkey, min(start) AS start, max(stop) AS stop, count(*) AS parts FROM g GROUP BY l_suppkey, g"""


def k2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = geometry.clusters(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", 60.0)
    return made.select("c_nationkey", "cluster", "size", F.round("mean", 4).alias("mean"))


K2_SQL = """WITH f AS (SELECT *, CASE WHEN c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) > 60 THEN 1 ELSE 0 END AS new FROM customer),
g AS (SELECT *, sum(new) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal ROWS UNBOUNDED PRECEDING) AS cluster FROM f) SELECT c_nationkey, cluster, count(*) AS size, round(avg(c_acctbal), 4) AS mean FROM g GROUP BY ALL"""


def i1_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.floor(F.col("l_extendedprice") / 50).cast("int") % 256
    return geometry.otsu(table(spark, sf_dir, "lineitem").select("l_returnflag", grey.alias("grey")), ["l_returnflag"])


I1_SQL = """WITH b AS (SELECT l_returnflag, floor(l_extendedprice / 50)::INT % 256 AS g, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(n) OVER u AS w0, sum(n * g) OVER u AS s0, sum(n) OVER (PARTITION BY l_returnflag) AS t, sum(n * g) OVER (PARTITION BY l_returnflag) AS st FROM b WINDOW u AS (PARTITION BY l_returnflag ORDER BY g ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, CASE WHEN t > w0 THEN round(w0::DOUBLE * (t - w0)::DOUBLE * (s0 / w0 - (st - s0) / (t - w0)) ** 2, 4) END AS v FROM c)
SELECT l_returnflag, arg_max(g, v ORDER BY g) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC NULLS LAST, g) AS rn FROM d) WHERE rn = 1 GROUP BY l_returnflag"""


def i2_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_tax") * 1000).alias("y"))
    return geometry.skew(p, ["l_returnflag"], [-5.0, -2.5, 0.0, 2.5, 5.0])


I2_SQL = """WITH p AS (SELECT l_returnflag AS f, l_quantity AS x, l_tax * 1000 AS y, unnest([-5.0, -2.5, 0.0, 2.5, 5.0])::DOUBLE AS angle FROM lineitem),
b AS (SELECT f, angle, floor(y * cos(radians(angle)) - x * sin(radians(angle)) + 0.5)::BIGINT AS b, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT f, angle, b, n AS d FROM b UNION ALL SELECT f, angle, b - 1, -n FROM b), s AS (SELECT f, angle, b, sum(d) AS d FROM e GROUP BY ALL), t AS (SELECT f, angle, sum(d * d) AS score FROM s GROUP BY ALL)
SELECT f AS l_returnflag, angle, score FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY score DESC, angle) AS rn FROM t) WHERE rn = 1"""


def d4_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("int").alias("y"), (F.floor("l_extendedprice") % 256).alias("a"), (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))) % 256).alias("b"))
    return compare.tiles_that_differ(p)


D4_SQL = """WITH p AS (SELECT l_suppkey AS page, l_linenumber AS x, l_quantity::INT AS y, floor(l_extendedprice)::BIGINT % 256 AS a, floor(l_extendedprice * (1 - l_discount))::BIGINT % 256 AS b FROM lineitem)
SELECT page, x // 16 AS tx, y // 16 AS ty, count(*) AS pixels, count(*) FILTER (abs(a - b) > 16) AS differing FROM p GROUP BY ALL"""


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of part names as glyphs, placed on one line: letters 10 wide, a gap of 2 before every `a`."""
    chars = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.posexplode(F.split("p_name", "")).alias("ord", "ch")).where("ch <> ''")
    x0 = F.col("ord") * 10 + F.when(F.col("ch") == "a", 2).otherwise(0)
    return chars.select("p_partkey", "ord", "ch", x0.cast("double").alias("x0"), (F.col("ord") * 10 + 10).cast("double").alias("x1"), F.lit(10.0).alias("size"), F.when(F.col("ch").rlike("[aeiou]"), "Serif").otherwise("Sans").alias("font"))


def t2_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.word_runs(glyphs(spark, sf_dir), ["p_partkey"])
    return found.groupBy("p_partkey", "word").agg(F.count("*").alias("glyphs"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


GLYPH_SQL = """g AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ''), 1) - 1 AS ord, unnest(string_split(p_name, '')) AS ch FROM part),
w AS (SELECT *, ord * 10 + CASE WHEN ch = 'a' THEN 2 ELSE 0 END AS x0, ord * 10 + 10 AS x1 FROM g)"""

T2_SQL = f"""WITH {GLYPH_SQL}, f AS (SELECT *, ch = ' ' AS sp, coalesce(lag(ch = ' ') OVER o, TRUE) OR x0 - lag(x1) OVER o > 1.5 AS apart FROM w WINDOW o AS (PARTITION BY p_partkey ORDER BY ord)),
n AS (SELECT *, sum(CASE WHEN apart AND NOT sp THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY ord ROWS UNBOUNDED PRECEDING) - 1 AS word FROM f)
SELECT p_partkey, word, count(*) AS glyphs, min(x0)::DOUBLE AS x0, max(x1)::DOUBLE AS x1 FROM n WHERE NOT sp GROUP BY ALL"""


def t17_block_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.block_style(glyphs(spark, sf_dir), ["p_partkey"])


T17_SQL = f"""WITH {GLYPH_SQL}, s AS (SELECT p_partkey, CASE WHEN regexp_matches(ch, '[aeiou]') THEN 'Serif' ELSE 'Sans' END AS font, ord FROM w WHERE ch <> ' '),
c AS (SELECT p_partkey, font, count(*) AS n, max(ord) AS o FROM s GROUP BY ALL) SELECT p_partkey, 10.0 AS size, font FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, o) AS rn FROM c) WHERE rn = 1"""


def t18_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(LINE_ORDER_SQL).alias("ord"), F.when(F.col("l_orderkey") % 3 == 0, 50 - F.col("l_quantity")).otherwise(F.lit(0.0)).alias("x0"), F.when(F.col("l_orderkey") % 3 == 1, F.col("l_quantity")).otherwise(F.lit(50.0)).alias("x1"), F.lit(0.0).alias("b0"), F.lit(50.0).alias("b1"), F.when(F.col("l_orderkey") % 2 == 0, 50.0).otherwise(80.0).alias("width"))
    return layout.line_alignment(line, ["l_orderkey"])


T18_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber + l_extendedprice / 1e9 AS o, CASE WHEN l_orderkey % 3 = 0 THEN 50 - l_quantity ELSE 0 END AS x0, CASE WHEN l_orderkey % 3 = 1 THEN l_quantity ELSE 50 END AS x1 FROM lineitem),
p AS (SELECT l_orderkey, abs(x0) <= 1 AS l, abs(x1 - 50) <= 1 AS r, abs((x0 + x1) / 2 - 25) <= 1 AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY o DESC) = 1 AS tail FROM l),
e AS (SELECT l_orderkey, count(*) AS n, bool_and(l) AS l, bool_and(r) AS r, bool_and(c) AS c, bool_and(r OR tail) AS body FROM p GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN n >= 2 AND l AND body AND NOT r THEN 'justify' WHEN n >= 2 AND r AND NOT l THEN 'right' WHEN n >= 2 AND NOT l AND c THEN 'center' WHEN n = 1 AND l_orderkey % 2 = 0 THEN 'center' ELSE 'left' END AS align FROM e"""


def b1_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("protect", "pages", "stamp", "ocr", "compress", "image", "metadata")])
    line = table(spark, sf_dir, "lineitem")
    return forms.batch_plan(line.select(F.col("l_orderkey").alias("rule_set"), (F.col("l_linenumber") - 1).alias("ord"), F.get(kinds, F.col("l_linenumber") - 1).alias("kind")))


B1_SQL = """WITH s AS (SELECT l_orderkey AS rule_set, l_linenumber - 1 AS ord, ['protect', 'pages', 'stamp', 'ocr', 'compress', 'image', 'metadata'][l_linenumber] AS kind, [8, 0, 4, 1, 7, 2, 5][l_linenumber] AS p FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_set ORDER BY p, ord) - 1 AS place FROM s) SELECT rule_set, ord, kind, place, place <> ord AS reordered FROM r"""


def b3_batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    items = d.select((F.crc32(F.col("source").cast("binary")) % 97).cast("long").alias("batch"), F.col("doc_id").alias("item"), F.octet_length("text").cast("long").alias("bytes"), "text")
    return forms.batch_run(items, lambda text: 1000 // text.count("|") if "|" in text else len(text.split()), 40, 200_000).select("batch", "item", "status")


QUERIES = {
    "c1_comment_threads": c1_comment_threads, "c1_thread_states": c1_thread_states, "c5b_rect_overlap": c5b_rect_overlap, "d4_tiles": d4_tiles, "d8_annotation_counts": d8_annotation_counts, "g1_preorder": g1_preorder, "g3_node_pages": g3_node_pages,
    "g5_resolved_roles": g5_resolved_roles, "g6_reachable": g6_reachable, "u5_structure_rules": u5_structure_rules, "v1_journal": v1_journal, "v4_retention": v4_retention, "v5_cleanup": v5_cleanup,
    "l5_recent": l5_recent, "l8_orphans": l8_orphans, "m1_chains": m1_chains, "m3_crossings": m3_crossings, "k1_merged_intervals": k1_merged_intervals, "k2_clusters": k2_clusters, "i1_otsu": i1_otsu,
    "i2_skew": i2_skew, "t2_words": t2_words, "t17_block_style": t17_block_style, "t18_alignment": t18_alignment, "b1_batch_plan": b1_batch_plan, "b3_batch_run": b3_batch_run,
}

ORACLE_SQL = {
    "v1_journal": V1_SQL,
    "c1_comment_threads": C1_SQL, "c1_thread_states": C1S_SQL, "c5b_rect_overlap": C5B_SQL, "d4_tiles": D4_SQL, "d8_annotation_counts": D8_SQL, "g1_preorder": G1_SQL, "g3_node_pages": G3_SQL, "g5_resolved_roles": G5_SQL,
    "g6_reachable": G6_SQL, "u5_structure_rules": U5_SQL, "v4_retention": V4_SQL, "v5_cleanup": V5_SQL, "l5_recent": L5_SQL, "l8_orphans": L8_SQL, "m1_chains": M1_SQL, "m3_crossings": M3_SQL,
    "k1_merged_intervals": K1_SQL, "k2_clusters": K2_SQL, "i1_otsu": I1_SQL, "i2_skew": I2_SQL, "t2_words": T2_SQL, "t17_block_style": T17_SQL, "t18_alignment": T18_SQL, "b1_batch_plan": B1_SQL,
}
