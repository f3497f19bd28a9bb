"""Queries of pages built from glyphs, of annotations that are removed or moved, of files, of text set in boxes and of pages in pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import file_audit, reflow, removal, scans, text_page
from quire.operators.groups import dealt
from quire.sources.tables import table


def t1_text_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts set letter by letter, each a block, twenty a page, with a gap after each fifth: paragraphs."""
    part = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    n = F.col("k") % 20
    y = n * 12.0 + F.floor(n / 5) * 40
    glyph = part.select(F.floor(F.col("k") / 20).alias("page"), n.cast("int").alias("block"), y.alias("y"), F.posexplode(F.split("p_name", "")).alias("ord", "ch"))
    x = F.col("ord") * 6.0
    glyphs = glyph.select("page", "block", F.lit(0).alias("line"), "ord", "ch", x.alias("x0"), (F.col("y") - 8).alias("y0"), (x + 6).alias("x1"), F.col("y").alias("y1"), x.alias("ox"), F.col("y").alias("oy"), F.lit(10.0).alias("size"), F.lit("Body").alias("font"), F.col("y").alias("baseline"))
    made = text_page.text_page(glyphs, glyphs.select("page").distinct().withColumn("width", F.lit(9999.0)))
    return made.select("page", "paragraph", "text", "lines", "x0", "x1", "y0", "y1", "font", "size", "leading", "align")


T1_SQL = """WITH p AS (SELECT p_partkey // 20 AS page, p_partkey % 20 AS n, p_name AS t FROM part), q AS (SELECT *, n // 5 AS paragraph, n * 12.0 + n // 5 * 40 AS y, length(t) AS len FROM p),
a AS (SELECT page, paragraph, string_agg(t, chr(10) ORDER BY n) AS text, count(*) AS lines, max(len) * 6.0 AS x1, min(y) - 8 AS y0, max(y) AS y1, max(len) AS longest, arg_max(len, n) AS tail, min(len) FILTER (n % 5 < 4) AS short FROM q GROUP BY ALL)
SELECT page, paragraph, text, lines, 0.0 AS x0, x1, y0, y1, 'Body' AS font, 10.0 AS size, 12.0 AS leading, CASE WHEN lines > 1 AND short = longest AND tail < longest THEN 'justify' ELSE 'left' END AS align FROM a"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as annotations: each fourth is the popup of the turn before, others answer it."""
    t = table(spark, sf_dir, "conversations")
    id_ = lambda n: F.concat((n + 1).cast("string"), F.lit("R"))
    popup, turn = F.col("turn") % 4 == 3, F.col("turn")
    return t.select(
        F.col("conv_id").alias("doc_id"), F.lit(0).alias("page"), id_(turn).alias("id"), F.when(popup, "Popup").otherwise("Text").alias("kind"), F.when(popup, id_(turn - 1)).alias("parent"), F.when(~popup & (turn > 0), id_(turn - 1)).alias("in_reply_to"),
        (turn * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (turn * 10.0 + F.length("text")).alias("x1"), F.lit(8.0).alias("y1"), (turn % 4 * 90).cast("int").alias("turn"), F.length("text").alias("n"),
    )


def c5_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations less those whose text is of a length divisible by three, popups going along; checked against a version
    that has all others (one document in ten is spoilt)."""
    notes = _notes(spark, sf_dir)
    targets = notes.where("n % 3 = 0 and kind = 'Text'").select("doc_id", "page", "id")
    wanted = removal.removed(notes, targets)
    spoilt = wanted.where("not (doc_id % 10 = 0 and id = '1R')")
    left = wanted.groupBy("doc_id").agg(F.count("*").alias("left"), F.count("in_reply_to").alias("answers"))
    return removal.accepted(wanted, spoilt).join(left, "doc_id").select("doc_id", "left", "answers", "problems")


C5_SQL = """WITH n AS (SELECT conv_id AS doc_id, turn, turn % 4 = 3 AS popup, length(text) % 3 = 0 AND turn % 4 <> 3 AS target FROM conversations),
a AS (SELECT n.*, coalesce(b.target, FALSE) AS above FROM n LEFT JOIN n b ON b.doc_id = n.doc_id AND b.turn = n.turn - 1), k AS (SELECT *, lag(gone, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY turn) AS lost FROM (SELECT *, target OR (popup AND above) AS gone FROM a))
SELECT doc_id, count(*) AS "left", count(*) FILTER (NOT popup AND turn > 0 AND NOT lost) AS answers, count(*) FILTER (doc_id % 10 = 0 AND turn = 0) AS problems FROM k WHERE NOT gone GROUP BY doc_id"""


def c6_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations moved to the right by their turn, those of odd number turned by a quarter, each third by two more."""
    notes = _notes(spark, sf_dir)
    k = F.regexp_extract("id", r"\d+", 0).cast("int")
    one = notes.select("doc_id", "page", "id", k.cast("double").alias("dx"), F.lit(-1.5).alias("dy"), (k % 2).alias("quarters"))
    two = notes.where(k % 3 == 0).select("doc_id", "page", "id", F.lit(0.0).alias("dx"), F.lit(0.5).alias("dy"), F.lit(2).alias("quarters"))
    return removal.moved(notes, one.union(two)).select("doc_id", "id", "x0", "y0", "x1", "y1", "turn")


C6_SQL = """WITH n AS (SELECT conv_id AS doc_id, (turn + 1) AS k, turn * 10.0 + length(text) / 2.0 + turn + 1 AS cx, 4.0 - 1.5 + CASE WHEN (turn + 1) % 3 = 0 THEN 0.5 ELSE 0 END AS cy, length(text) / 2.0 AS w, 4.0 AS h, turn % 4 * 90 AS r FROM conversations),
q AS (SELECT *, k % 2 + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS q FROM n), z AS (SELECT *, CASE WHEN q % 2 = 1 THEN h ELSE w END AS a, CASE WHEN q % 2 = 1 THEN w ELSE h END AS b FROM q)
SELECT doc_id, k || 'R' AS id, cx - a AS x0, cy - b AS y0, cx + a AS x1, cy + b AS y1, ((r + q * 90) % 360)::INT AS turn FROM z"""

def u2_file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inside files, with an octal string in each fourth, a chained revision in each fifth and a loose object in
    each second, searched for two words and every trace."""
    k = F.col("doc_id")
    some = lambda of, text: F.when(k % of == 0, text).otherwise("")
    head = F.concat(F.lit("%PDF-1.7\n1 0 obj << /Type /Catalog >> endobj\n"), some(4, "(se\\143ret) "), some(5, "/Prev 9 "), some(2, "\n7 0 obj (x) endobj"), some(3, " /Annots [] "), F.lit("\ntrailer << /Root 1 0 R >>\nstartxref\n9\n"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(head, "text"), "UTF-8").alias("content"))
    return file_audit.audited_files(files, ["the", "secret"]).select("doc_id", "check", "severity", "n", "term")


U2F_SQL = """WITH d AS (SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS the, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END + (length(text) - length(replace(text, 'secret', ''))) // 6 AS secret FROM documents),
f AS (SELECT doc_id, 'residual-text' AS "check", 'content' AS severity, the AS n, 1 AS term FROM d WHERE the > 0 UNION ALL SELECT doc_id, 'residual-text', 'content', secret, 2 FROM d WHERE secret > 0
UNION ALL SELECT doc_id, 'residual-text', 'info', 0, (the = 0)::INT + (secret = 0)::INT FROM d WHERE the = 0 OR secret = 0),
c AS (SELECT doc_id, unnest(['previous-revision', 'orphan-object', 'compressed', 'metadata', 'xmp', 'attachment', 'annotation', 'javascript', 'names']) AS "check", unnest([5, 2, 0, 0, 0, 0, 3, 0, 0]) AS k FROM d)
SELECT * FROM f UNION ALL SELECT doc_id, "check", CASE WHEN k > 0 AND doc_id % greatest(k, 1) = 0 THEN CASE "check" WHEN 'annotation' THEN 'warning' ELSE 'content' END ELSE 'info' END, CASE WHEN k > 0 AND doc_id % greatest(k, 1) = 0 THEN 1 ELSE 0 END, NULL FROM c"""


def t15_reflowed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set in boxes of a height that takes about half of them, with ideographs in each third, in smaller sizes until
    they fit or 6 is reached."""
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.regexp_replace("text", "[aeiou]", "\u5b57")).otherwise(F.col("text"))
    blocks = table(spark, sf_dir, "documents").select(k.alias("block"), text.alias("text"), F.lit(300.0).alias("width"), F.when(k % 5 > 0, F.length("text") * 0.25 + 20).alias("height"), F.lit(10.0).alias("size"))
    face = reflow.Face({" ": 0.25, "i": 0.25, "l": 0.25, "t": 0.3, "m": 0.8, "w": 0.75, "\u5b57": 1.0})
    made = reflow.reflowed_blocks(blocks, face, least=6.0, hyphenate=True)
    return made.select("block", "size", "overflow", F.size("lines").alias("lines"), F.md5(F.array_join(F.transform("lines", lambda x: x["text"]), "\n").cast("binary")).alias("md5"))


CORNERS = ("8 + 4 * (k % 2)", "8 + 4 * (k // 2 % 2)", "68 - 4 * (k % 3)", "8 + 4 * (k % 2)", "72 - 4 * (k // 3 % 2)", "52 - 4 * (k % 2)", "8 + 4 * (k // 5 % 3)", "48 - 4 * (k // 7 % 2)")


def i4_page_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A light page drawn askew for each supplier, in 80 by 60 pixels; the corners that are found, to the next multiple of
    four, which is where they were drawn."""
    own = dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_suppkey").alias("k")), "page")
    drawn = own.select("page", *[F.expr(c.replace("//", "div")).cast("int").alias(f"c{n}") for n, c in enumerate(CORNERS)])
    x, y = F.col("x"), F.col("y")
    inside = F.lit(True)
    for n in range(0, 8, 2):
        ax, ay, bx, by = (F.col(f"c{(n + d) % 8}") for d in range(4))
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    grid = drawn.select("*", F.explode(F.sequence(F.lit(0), F.lit(79))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("y"))
    found = scans.page_corners(grid.select("page", "x", "y", F.when(inside, 220).otherwise(40).alias("grey")))
    place = lambda n: F.round(F.col("corners")[n // 2][n % 2] / 4).cast("int") * 4
    return found.select("page", *[place(n).alias(f"c{n}") for n in range(8)])


I4_SQL = f"""SELECT page, {", ".join(f"({c})::INT AS c{n}" for n, c in enumerate(CORNERS))} FROM (SELECT s_suppkey AS page, s_suppkey AS k FROM supplier)"""


QUERIES = {"t1_text_page": t1_text_page, "c5_removed": c5_removed, "c6_moved": c6_moved, "u2_file_audit": u2_file_audit, "t15_reflowed_blocks": t15_reflowed_blocks, "i4_page_corners": i4_page_corners}
ORACLE_SQL = {"t1_text_page": T1_SQL, "c5_removed": C5_SQL, "c6_moved": C6_SQL, "u2_file_audit": U2F_SQL, "i4_page_corners": I4_SQL}
