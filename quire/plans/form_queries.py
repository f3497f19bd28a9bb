"""Queries of form data files, comment files, text export and the order of display."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import comments, form_files, text_export
from quire.operators.groups import parts_by_rows, slices, spread
from quire.plans.text_queries import docs
from quire.sources.tables import table


def r9_form_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a form data file: an order is an object that the fields refer to, with three fields below it,
    one of them UTF-16 in hexadecimal; read again."""
    order = table(spark, sf_dir, "orders")
    n = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1).cast("string")
    total = F.concat(F.lit("<FEFF"), F.hex(F.encode(F.concat(F.col("o_totalprice").cast("int").cast("string"), F.lit(" €")), "UTF-16BE")), F.lit(">"))
    kids = F.concat(F.lit("<</T(status)/V/"), "o_orderstatus", F.lit(">> << /T (due \\(\\163\\)) % kept\n/V ("), "o_orderpriority", F.lit(") >> << /T <746F74616C> /V "), total, F.lit(" >>"))
    one = F.concat(n, F.lit(" 0 obj << /T (o"), F.col("o_orderkey").cast("string"), F.lit(") /Kids [ "), kids, F.lit(" ] >> endobj"))
    listed = order.select("o_custkey", n.alias("n"), one.alias("one")).groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat("n", F.lit(" 0 R"))), " ").alias("refs"), F.array_join(F.collect_list("one"), "\n").alias("objects"))
    text = F.concat(F.lit(f"{form_files.HEADER}\n1 0 obj\n<< /FDF << /Fields [ "), "refs", F.lit(" ] >> >>\nendobj\n"), "objects", F.lit("\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n"))
    found = form_files.form_fields(listed.select(F.col("o_custkey").alias("file"), F.encode(text, "UTF-8").alias("content")))
    return found.select("file", "name", "kind", "value", "problem")


R9F_SQL = """SELECT o_custkey AS file, 'o' || o_orderkey || '.status' AS name, 'state' AS kind, o_orderstatus AS value, NULL::VARCHAR AS problem FROM orders
UNION ALL SELECT o_custkey, 'o' || o_orderkey || '.due (s)', 'text', o_orderpriority, NULL FROM orders
UNION ALL SELECT o_custkey, 'o' || o_orderkey || '.total', 'text', trunc(o_totalprice)::INT || ' €', NULL FROM orders"""


def r9_form_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as fields of every kind, written to form data files and read back."""
    t = table(spark, sf_dir, "conversations")
    k = F.col("turn") % 4
    kind = F.when(k == 0, "text").when(k == 1, "flag").when(k == 2, "state").otherwise("list")
    value = F.when(k == 0, F.concat("text", F.lit(" (\\) \u00e9\n"))).when(k == 1, (F.length("text") % 2 == 0).cast("string")).when(k == 2, F.concat("role", F.lit(" #1")))
    fields = t.select(F.col("conv_id").alias("file"), F.col("turn").cast("int").alias("place"), F.concat(F.lit("f."), F.col("turn").cast("string")).alias("name"), kind.alias("kind"), value.alias("value"), F.when(k == 3, F.split("text", " ")).alias("items"))
    back = form_files.form_fields(form_files.form_file(fields))
    return back.select("file", "place", "name", "kind", "value", F.array_join("items", "|").alias("items"))


R9R_SQL = r"""SELECT conv_id AS file, turn::INT AS place, 'f.' || turn AS name, ['text', 'flag', 'state', 'list'][turn % 4 + 1] AS kind,
  CASE turn % 4 WHEN 0 THEN text || ' (\) é' || chr(10) WHEN 1 THEN (length(text) % 2 = 0)::VARCHAR WHEN 2 THEN role || ' #1' END AS value, CASE WHEN turn % 4 = 3 THEN array_to_string(string_split(text, ' '), '|') END AS items FROM conversations"""


def r11_comment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as comment threads: the first turn is a mark, later ones answer the one before, each fifth is a review
    state; written as XFDF and read back."""
    t = table(spark, sf_dir, "conversations")
    first, review = F.col("turn") == 0, F.col("turn") % 5 == 4
    no = lambda kind: F.lit(None).cast(kind)
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    x = (F.col("conv_id") % 100).cast("double")
    made = t.select(
        F.col("conv_id").alias("file"), F.col("turn").cast("int").alias("ord"), name(F.col("turn")).alias("name"), F.when(first & (F.col("conv_id") % 2 == 0), "Highlight").otherwise("Text").alias("subtype"),
        (F.col("conv_id") % 7).cast("int").alias("page"), F.array(x, F.lit(20.0), x + 100.25, F.lit(40.5)).alias("rect"), F.concat("text", F.lit(' <&"')).alias("contents"), F.col("role").alias("title"),
        F.lit("2024-01-01T00:00:00Z").alias("modified"), F.concat(F.lit("D:202401010000"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("Z")).alias("created"), F.lit("#a1b2c3").alias("colour"), F.lit(0.5).alias("opacity"),
        no("double").alias("width"), F.when(first, F.array(*[x, F.lit(40.5), x + 100.25, F.lit(40.5), x, F.lit(20.0), x + 100.25, F.lit(20.0)])).alias("coords"), no("array<array<double>>").alias("strokes"), no("array<double>").alias("ends"),
        F.when(~first, name(F.col("turn") - 1)).alias("parent"), F.when(review, "Accepted").alias("state"), no("string").alias("state_model"),
    )
    marks, counts = comments.read_comments(comments.comment_files(made))
    letters = F.aggregate("replies", F.lit(0).cast("long"), lambda acc, r: acc + F.length(r["contents"]))
    told = marks.select("file", "name", "kind", "page", "colour", F.md5("contents").alias("contents"), F.size("replies").alias("replies"), letters.alias("letters"), F.col("review.state").alias("state"), F.round(F.col("boxes")[0][2], 3).alias("right"))
    return told.join(counts.select("file", "marks", "skipped"), "file")


R11C_SQL = """WITH t AS (SELECT *, turn % 5 = 4 AS review FROM conversations)
SELECT conv_id AS file, 'c0' AS name, CASE WHEN conv_id % 2 = 0 THEN 'highlight' ELSE 'note' END AS kind, (conv_id % 7)::INT AS page, '#a1b2c3' AS colour, md5(max(text || ' <&"') FILTER (turn = 0)) AS contents,
  count(*) FILTER (turn > 0 AND NOT review) AS replies, coalesce(sum(length(text) + 4) FILTER (turn > 0 AND NOT review), 0)::BIGINT AS letters, CASE WHEN bool_or(review) THEN 'Accepted' END AS state,
  (conv_id % 100) + 100.25 AS "right", 1 AS marks, 0 AS skipped FROM t GROUP BY conv_id"""


def _set_words(texts: DataFrame) -> DataFrame:
    """The words of documents laid out: a line of text is a line 20 points high, a letter 5 wide, a page 40 lines. They come
    a page after the other, in order.

    Where a word begins is a running sum along its line, so long lines cost no more than their words.
    """

    def parts(texts: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The parts of all texts, the text that each is of, and its place there."""
        split = pc.split_pattern(texts, mark)
        count = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(texts)), count)
        return pc.list_flatten(split), of, np.arange(len(of)) - (np.cumsum(count) - count)[of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines, doc, line = parts(batch.column("text"), "\n")
            words, of, k = parts(lines, " ")
            page = pc.add(pc.multiply(batch.column("doc_id").take(pa.array(doc)), 100_000), pa.array(line // 40)).take(pa.array(of))
            length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(length + 1) - (length + 1)
            x = (before - before[np.arange(len(of)) - k]) * 5.0
            columns = [page, pa.array(line[of] * 100_000 + k), words, pa.array(x), pa.array(line[of] * -20.0), pa.array(np.full(len(of), 20.0)), pa.array(length * 5.0)]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "ord", "text", "x", "y", "size", "width"])

    return texts.select("doc_id", "text").mapInArrow(run, "page long, ord long, text string, x double, y double, size double, width double")


def t8_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out word by word, read line by line, and written as text files with page rules."""
    own = docs(spark, sf_dir)
    parts = parts_by_rows(own, rows=1 << 12)
    right = F.col("text").rlike(text_export.FROM_RIGHT)  # they are rare, and take a second look
    texts = spread(own.select("doc_id", "text"), parts, "doc_id")
    lines = text_export.line_texts(_set_words(texts.where(~right)), together=True, turned=False).union(text_export.line_texts(_set_words(texts.where(right)), together=True))
    dealt_out = lines.withColumn("doc_id", F.floor(F.col("page") / 100_000)).repartition(parts, "doc_id")
    held = text_export.texts_of_lines(dealt_out, ["doc_id", "page"]).select("doc_id", F.col("page") % 100_000, "text")
    whole = own.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.size(F.split("text", "\n")) - 1) / 40))).alias("page"), F.lit(None).cast("string").alias("text"))
    pages = whole.repartition(parts, "doc_id").union(held).groupBy("doc_id", "page").agg(F.max("text").alias("text"))
    made = text_export.text_files(pages.withColumn("page", F.col("page").cast("int")))
    return made.select("doc_id", F.md5(F.col("content").cast("binary")).alias("md5"), F.size("empty_pages").alias("empty"), "characters")


T8F_SQL = r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
f AS (SELECT doc_id, line // 40 AS page, line, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM l),
g AS (SELECT *, line - lag(line) OVER (PARTITION BY doc_id, page ORDER BY line) AS gap FROM f WHERE t <> ''),
p AS (SELECT doc_id, page, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap > 1 THEN chr(10) || chr(10) ELSE chr(10) END || t, '' ORDER BY line) AS t FROM g GROUP BY ALL),
a AS (SELECT DISTINCT doc_id, page FROM f), w AS (SELECT a.doc_id, a.page, coalesce(t, '') AS t FROM a LEFT JOIN p USING (doc_id, page))
SELECT doc_id, md5(chr(65279) || string_agg(CASE WHEN page = 0 THEN '' ELSE chr(10) || chr(10) || '----- ' || (page + 1) || ' -----' || chr(10) || chr(10) END || t, '' ORDER BY page) || chr(10)) AS md5,
  count(*) FILTER (t = '') AS empty, sum(length(t) + len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]')))::BIGINT AS characters FROM w GROUP BY doc_id"""


def t13_display_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns as units of a right-to-left paragraph, their classes taken from their lengths."""
    kinds = ["L", "R", "AL", "EN", "AN", "ES", "ET", "CS", "ON"]
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("ord", "w"))
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.length("w") % 9 + 1)
    return text_export.display_places(units.select("conv_id", "turn", "ord", kind.alias("class")), ["conv_id", "turn"]).select("conv_id", "turn", "ord", "place")


T13D_SQL = """WITH u AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) - 1 AS ord, ['L', 'R', 'AL', 'EN', 'AN', 'ES', 'ET', 'CS', 'ON'][length(unnest(string_split(text, ' '))) % 9 + 1] AS c FROM conversations),
a AS (SELECT * REPLACE (CASE WHEN c = 'EN' AND last_value(CASE WHEN c IN ('L', 'R', 'AL') THEN c END IGNORE NULLS) OVER p = 'AL' THEN 'AN' ELSE c END AS c) FROM u WINDOW p AS (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT * REPLACE (CASE c WHEN 'AL' THEN 'R' ELSE c END AS c) FROM a),
d AS (SELECT *, lag(c) OVER w AS x, lead(c) OVER w AS y FROM b WINDOW w AS (PARTITION BY conv_id, turn ORDER BY ord)),
e AS (SELECT conv_id, turn, ord, CASE WHEN x = y AND ((c = 'ES' AND x = 'EN') OR (c = 'CS' AND x IN ('EN', 'AN'))) THEN x ELSE c END AS c FROM d),
f AS (SELECT * REPLACE (CASE WHEN c = 'ET' AND 'EN' IN (coalesce(last_value(CASE WHEN c <> 'ET' THEN c END IGNORE NULLS) OVER p, '-'), coalesce(first_value(CASE WHEN c <> 'ET' THEN c END IGNORE NULLS) OVER n, '-')) THEN 'EN' ELSE c END AS c) FROM e
  WINDOW p AS (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT * REPLACE (CASE WHEN c IN ('ES', 'ET', 'CS') THEN 'ON' WHEN c = 'EN' AND last_value(CASE WHEN c IN ('L', 'R') THEN c END IGNORE NULLS) OVER p = 'L' THEN 'L' ELSE c END AS c) FROM f WINDOW p AS (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT * REPLACE (CASE WHEN c <> 'ON' THEN c WHEN last_value(CASE WHEN c <> 'ON' THEN c END IGNORE NULLS) OVER p = 'L' AND first_value(CASE WHEN c <> 'ON' THEN c END IGNORE NULLS) OVER n = 'L' THEN 'L' ELSE 'R' END AS c) FROM g
  WINDOW p AS (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r AS (SELECT *, sum(CASE WHEN c = 'R' OR x = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY ord) AS run FROM (SELECT *, lag(c, 1, 'R') OVER (PARTITION BY conv_id, turn ORDER BY ord) AS x FROM h))
SELECT conv_id, turn, ord, row_number() OVER (PARTITION BY conv_id, turn ORDER BY run DESC, ord) - 1 AS place FROM r"""

QUERIES = {
    "r9_form_files": r9_form_files, "r9_form_round_trip": r9_form_round_trip, "r11_comment_files": r11_comment_files, "t8_text_files": t8_text_files, "t13_display_places": t13_display_places,
}
ORACLE_SQL = {
    "r9_form_files": R9F_SQL, "r9_form_round_trip": R9R_SQL, "r11_comment_files": R11C_SQL, "t8_text_files": T8F_SQL, "t13_display_places": T13D_SQL,
}
