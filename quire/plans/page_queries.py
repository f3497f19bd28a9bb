"""Queries of page-set algebra. Page sets come from documents' pages, and from which parts a supplier ships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import numbers as nm
from quire.operators import pages as pg
from quire.operators.groups import dealt_by_rows
from quire.plans.text_queries import PAGES_SQL, docs
from quire.sources.tables import pages_of, table


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, pages, bytes): a page for each line here, so that documents have many."""
    lines = docs(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).alias("pages"), F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return lines.select("doc_id", "page", "pages", F.octet_length("text").cast("long").alias("bytes"))


LINE_PAGES_SQL = """dp AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page, len(string_split(text, chr(10))) AS pages, strlen(unnest(string_split(text, chr(10)))) AS bytes FROM documents)"""


def p3_format_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_partkey") + 1).cast("int").alias("page"))
    return pg.format_ranges(dealt_by_rows(shipped, "supplier"), ["supplier"])


P3_SQL = """WITH d AS (SELECT DISTINCT l_suppkey AS supplier, l_partkey + 1 AS page FROM lineitem),
i AS (SELECT *, page - row_number() OVER (PARTITION BY supplier ORDER BY page) AS g FROM d),
r AS (SELECT supplier, g, min(page) AS a, max(page) AS b FROM i GROUP BY ALL)
SELECT supplier, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS expr FROM r GROUP BY supplier"""


def p1_parse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ranges that p3 writes stand for."""
    written = p3_format_ranges(spark, sf_dir).withColumn("pages", F.lit(1 << 30))
    return pg.parse_ranges(written, ["supplier"])


P1_SQL = """WITH d AS (SELECT DISTINCT l_suppkey AS supplier, l_partkey + 1 AS page FROM lineitem)
SELECT supplier, row_number() OVER (PARTITION BY supplier ORDER BY page) - 1 AS place, page FROM d"""


def p4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pg.chunks(_doc_pages(spark, sf_dir), 3)
    return made.groupBy("doc_id", "chunk", "name").agg(F.min("page").alias("first"), F.max("page").alias("last"))


P4_SQL = f"""WITH {LINE_PAGES_SQL}, c AS (SELECT *, page // 3 AS chunk, length(((pages + 2) // 3)::VARCHAR) AS w FROM dp)
SELECT doc_id, chunk, 'part-' || lpad((chunk + 1)::VARCHAR, w::INT, '0') AS name, min(page) AS first, max(page) AS last FROM c GROUP BY ALL"""


def p7_split_by_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "orders").select("o_custkey", (F.dayofyear("o_orderdate") - 1).alias("page"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("title"))
    return pg.split_by_bookmarks(marks, ["o_custkey"], 366)


P7_SQL = """WITH m AS (SELECT o_custkey, dayofyear(o_orderdate) - 1 AS page, o_orderkey AS ord, o_orderpriority AS title FROM orders),
f AS (SELECT o_custkey, page, arg_min(title, ord) AS title FROM m GROUP BY ALL),
p AS (SELECT o_custkey, page AS first, coalesce(lead(page) OVER (PARTITION BY o_custkey ORDER BY page), 366) - 1 AS last, title FROM f)
SELECT * FROM p UNION ALL SELECT o_custkey, 0, min(page) - 1, NULL FROM f GROUP BY o_custkey HAVING min(page) > 0"""


def p8_split_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.split_by_size(_doc_pages(spark, sf_dir), 2000)


P8_SQL = f"""WITH RECURSIVE {LINE_PAGES_SQL}, w AS (SELECT doc_id, page, bytes AS used, 0 AS part FROM dp WHERE page = 0
 UNION ALL SELECT d.doc_id, d.page, CASE WHEN w.used > 0 AND w.used + d.bytes > 2000 THEN d.bytes ELSE w.used + d.bytes END, part + CASE WHEN w.used > 0 AND w.used + d.bytes > 2000 THEN 1 ELSE 0 END FROM w JOIN dp d ON d.doc_id = w.doc_id AND d.page = w.page + 1)
SELECT doc_id, page, part FROM w"""


def p11_insert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.insert_plan(_doc_pages(spark, sf_dir), F.least(F.lit(2), F.col("pages")), F.lit(2))


P11_SQL = f"""WITH {LINE_PAGES_SQL} SELECT doc_id, 'own' AS origin, page, CASE WHEN page >= least(2, pages) THEN page + 2 ELSE page END AS place FROM dp
UNION ALL SELECT doc_id, 'new', g, least(2, pages) + g FROM (SELECT DISTINCT doc_id, pages FROM dp), (SELECT unnest([0, 1]) AS g)"""


def p12_replace_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page gives way to the page of another document whose number is a hundred higher."""
    pages = _doc_pages(spark, sf_dir)
    return pg.replaced_pages(pages, pages.where("page % 2 = 1").select("doc_id", "page", (F.col("page") + 100).alias("source_page")))


P12_SQL = f"""WITH {LINE_PAGES_SQL} SELECT doc_id, page, CASE WHEN page % 2 = 1 THEN 'new' ELSE 'own' END AS origin, CASE WHEN page % 2 = 1 THEN page + 100 END AS source_page FROM dp"""


def p13_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _doc_pages(spark, sf_dir)
    fronts = F.ceil(F.col("pages") / 2).cast("int")
    backs = F.col("pages") - fronts
    side = (F.col("page") >= fronts).cast("int")
    sheet = F.when(side == 1, F.col("page") - fronts).otherwise(F.col("page"))
    return pages.select("doc_id", "page", side.alias("side"), pg.interleave_place(side, sheet, fronts, backs, reverse=True).alias("place"))


P13_SQL = f"""WITH {LINE_PAGES_SQL}, s AS (SELECT doc_id, page, (pages + 1) // 2 AS f, pages - (pages + 1) // 2 AS b FROM dp),
t AS (SELECT doc_id, page, CASE WHEN page >= f THEN 1 ELSE 0 END AS side, CASE WHEN page >= f THEN b - 1 - (page - f) ELSE page END AS pos, least(f, b) AS k FROM s)
SELECT doc_id, page, side, CASE WHEN pos < k THEN 2 * pos + side ELSE k + pos END AS place FROM t"""


def _action(name: str, chosen, target=None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pg.page_actions(_doc_pages(spark, sf_dir), name, chosen(), target)

    return query


ODD = "page % 2 = 1"
ACTIONS_SQL = {
    "p16_delete": f"WITH {LINE_PAGES_SQL} SELECT doc_id, page, 0 AS copy, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS place FROM dp WHERE NOT ({ODD})",
    "p16_duplicate": f"WITH {LINE_PAGES_SQL}, c AS (SELECT doc_id, page, unnest(CASE WHEN {ODD} THEN [0, 1] ELSE [0] END) AS copy FROM dp) SELECT doc_id, page, copy, row_number() OVER (PARTITION BY doc_id ORDER BY page, copy) - 1 AS place FROM c",
    "p16_move": f"WITH {LINE_PAGES_SQL} SELECT doc_id, page, 0 AS copy, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN {ODD} THEN 1 WHEN page < 2 THEN 0 ELSE 2 END, page) - 1 AS place FROM dp",
    "p16_reverse": f"WITH {LINE_PAGES_SQL}, r AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS u, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC) AS d FROM dp WHERE {ODD}) SELECT a.doc_id, a.page, 0 AS copy, b.page AS place FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.u = b.d UNION ALL SELECT doc_id, page, 0, page FROM dp WHERE NOT ({ODD})",
}


def p17_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = F.array(*[F.lit(s) for s in ("none", "decimal", "roman", "ROMAN", "letters", "LETTERS")])
    part = table(spark, sf_dir, "part")
    style = F.get(styles, (F.col("p_partkey") % 6).cast("int"))
    return part.select("p_partkey", pg.label_text(style, F.lit("§"), F.col("p_size") * 7).alias("label"))


P17_SQL = """WITH n AS (SELECT p_partkey, p_size * 7 AS n, p_partkey % 6 AS k FROM part),
l AS (SELECT *, repeat('M', (n // 1000)::INT) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][((n // 100) % 10 + 1)::INT] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][((n // 10) % 10 + 1)::INT] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][(n % 10 + 1)::INT] AS r,
  repeat(chr((65 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::INT) AS a FROM n)
SELECT p_partkey, '§' || CASE k WHEN 0 THEN '' WHEN 1 THEN n::VARCHAR WHEN 2 THEN lower(r) WHEN 3 THEN r WHEN 4 THEN lower(a) ELSE a END AS label FROM l"""


def p18_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    found = pg.label_lookup(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.startswith("o_orderpriority", F.lit("1")), F.col("o_orderkey"), "range_start")
    return found.select("o_orderkey", "range_start")


P18_SQL = """SELECT o_orderkey, last_value(CASE WHEN starts_with(o_orderpriority, '1') THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS range_start FROM orders"""


def p19_compressed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled pages: the kind is the style, and the number restarts every five pages."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    at = F.row_number().over(w) - 1
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(at % 10 < 5, "decimal").when(at % 10 < 8, "none").otherwise("roman").alias("style"), F.when(F.col("user_id") % 2 == 0, "A-").otherwise("").alias("prefix"), (at % 5 + 1).alias("number"))
    return pg.label_ranges(events, ["user_id"], ["event_id"])


P19_SQL = """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
v AS (SELECT user_id, event_id, pos, CASE WHEN pos % 10 < 5 THEN 'decimal' WHEN pos % 10 < 8 THEN 'none' ELSE 'roman' END AS style, CASE WHEN user_id % 2 = 0 THEN 'A-' ELSE '' END AS prefix, pos % 5 + 1 AS number FROM e)
SELECT user_id, event_id, style, prefix, CASE WHEN style = 'none' THEN 1 ELSE number END AS number FROM v WHERE pos % 10 IN (0, 5, 8)"""


def p20_sheet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = docs(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).alias("pages"))
    up = [pg.sheet_counts(F.col("pages"), n).alias(f"up{n}") for n in (2, 4, 6)]
    return pages.select("doc_id", *up, pg.sheet_counts(F.col("pages"), 4).alias("booklet"), (F.col("pages") * 6).alias("poster"))


P20_SQL = """WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, (n + 1) // 2 AS up2, (n + 3) // 4 AS up4, (n + 5) // 6 AS up6, (n + 3) // 4 AS booklet, n * 6 AS poster FROM p"""


def p21_booklet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.booklet(docs(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).alias("pages")))


P21_SQL = """WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), s AS (SELECT doc_id, n, ((n + 3) // 4) * 4 AS s, unnest(range((n + 3) // 4)) AS i FROM p),
c AS (SELECT doc_id, i AS sheet, n, unnest(['front', 'front', 'back', 'back']) AS side, unnest([0, 1, 0, 1]) AS cell, unnest([s - 2 * i, 2 * i + 1, 2 * i + 2, s - 2 * i - 1]) AS page FROM s)
SELECT doc_id, sheet, side, cell, CASE WHEN page <= n THEN page END AS page FROM c"""


def p22_blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of(docs(spark, sf_dir))
    return pages.groupBy("doc_id").agg(F.sum((~F.col("text").rlike(r"[\p{L}\p{N}]")).cast("int")).alias("blank"))


P22_SQL = f"""WITH {PAGES_SQL} SELECT doc_id, count(*) FILTER (NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]')) AS blank FROM pages GROUP BY doc_id"""


def d6_sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.sampled(docs(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).alias("pages")), 5)


D6_SQL = """WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
SELECT DISTINCT doc_id, unnest(CASE WHEN n <= 5 THEN range(n) ELSE list_concat([0, n - 1], list_transform([1, 2, 3], lambda k: floor(k * (n - 1) / 5 + 0.5)::BIGINT)) END) AS page FROM p"""


def p6_split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of three pages each."""
    return pg.split_plan(_doc_pages(spark, sf_dir), "every", 3)


P6_SQL = f"""WITH {LINE_PAGES_SQL} SELECT doc_id, page // 3 AS part, 'part-' || lpad((page // 3 + 1)::VARCHAR, length(((max(pages) + 2) // 3)::VARCHAR)::INT, '0') AS name, min(page) AS first, max(page) AS last FROM dp GROUP BY doc_id, page // 3"""


def p16_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _doc_pages(spark, sf_dir).withColumn("rotation", (F.col("page") % 4 * 90).cast("int"))
    return pg.page_actions(pages, "rotate", F.expr(ODD), F.lit(-90))


P16R_SQL = f"WITH {LINE_PAGES_SQL} SELECT doc_id, page, 0 AS copy, page AS place, (page % 4 * 90 + CASE WHEN {ODD} THEN 270 ELSE 0 END) % 360 AS rotation FROM dp"


def f13_bates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("DOC-"), nm.padded(F.col("o_orderkey"), 4)).alias("bates"))


F13_SQL = "SELECT o_orderkey, 'DOC-' || lpad(o_orderkey::VARCHAR, greatest(4, length(o_orderkey::VARCHAR))::INT, '0') AS bates FROM orders"

QUERIES = {
    "p1_parse_ranges": p1_parse_ranges, "p3_format_ranges": p3_format_ranges, "p4_chunks": p4_chunks, "p7_split_by_bookmarks": p7_split_by_bookmarks, "p8_split_by_size": p8_split_by_size,
    "p11_insert_plan": p11_insert_plan, "p12_replace_plan": p12_replace_plan, "p13_interleave": p13_interleave, "p16_delete": _action("delete", lambda: F.expr(ODD)),
    "p16_duplicate": _action("duplicate", lambda: F.expr(ODD)), "p16_move": lambda s, d: pg.page_actions(_doc_pages(s, d), "move", F.expr(ODD), F.lit(2)), "p16_reverse": _action("reverse", lambda: F.expr(ODD)),
    "p17_page_labels": p17_page_labels, "p18_label_lookup": p18_label_lookup, "p19_compressed_labels": p19_compressed_labels, "p20_sheet_counts": p20_sheet_counts, "p21_booklet": p21_booklet,
    "p22_blank_pages": p22_blank_pages, "d6_sampled_pages": d6_sampled_pages, "p6_split_plan": p6_split_plan, "p16_rotate": p16_rotate, "f13_bates": f13_bates,
}

ORACLE_SQL = ACTIONS_SQL | {
    "p1_parse_ranges": P1_SQL, "p3_format_ranges": P3_SQL, "p4_chunks": P4_SQL, "p7_split_by_bookmarks": P7_SQL, "p11_insert_plan": P11_SQL, "p12_replace_plan": P12_SQL,
    "p13_interleave": P13_SQL, "p17_page_labels": P17_SQL, "p18_label_lookup": P18_SQL, "p19_compressed_labels": P19_SQL, "p20_sheet_counts": P20_SQL, "p21_booklet": P21_SQL,
    "p22_blank_pages": P22_SQL, "d6_sampled_pages": D6_SQL, "p6_split_plan": P6_SQL, "p8_split_by_size": P8_SQL, "p16_rotate": P16R_SQL, "f13_bates": F13_SQL,
}
