"""Queries of scalar functions: numbers, dates, form fields and calculations, on values that the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import dates as dt
from quire.functions import numbers as nm
from quire.functions import text as tx
from quire.operators import forms, rules
from quire.sources.tables import table

# The stops of the zoom, in percent.
ZOOM = [10, 25, 50, 75, 100, 125, 150, 200, 300, 400]

# A price as people write it, in a style that depends on the line: plain, comma, grouped either way, with a tail, and so on.
WRITTEN = """CASE l_linenumber WHEN 1 THEN cents WHEN 2 THEN replace(cents, '.', ',') WHEN 3 THEN concat('1.', right(concat('000', whole), 3), ',', right(cents, 2))
 WHEN 4 THEN concat('1,', right(concat('000', whole), 3), '.', right(cents, 2)) WHEN 5 THEN concat(whole, ' kg') WHEN 6 THEN concat('-', whole) ELSE concat('=', whole) END"""


def written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, t)."""
    line = table(spark, sf_dir, "lineitem")
    cents = F.format_string("%.2f", F.col("l_extendedprice"))
    return line.select("l_orderkey", "l_linenumber", cents.alias("cents"), F.floor("l_extendedprice").cast("string").alias("whole")).select("l_orderkey", "l_linenumber", F.expr(WRITTEN).alias("t"))


NUMBERS_SQL = f"""c AS (SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) AS cents, floor(l_extendedprice)::BIGINT::VARCHAR AS whole FROM lineitem),
n AS (SELECT l_orderkey, l_linenumber, {WRITTEN} AS t FROM c)"""


def f2_form_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by their own marks, and as fields of the style with points for groups and a comma."""
    return written_numbers(spark, sf_dir).select("l_orderkey", "l_linenumber", nm.form_number(F.col("t")).alias("value"), nm.form_number(F.col("t"), F.lit(2)).alias("styled"))


F2_SQL = rf"""WITH {NUMBERS_SQL}, k AS (SELECT *, regexp_extract(t, '^\s*([-+]?)(\d[\d.,''’]*|[.,]\d+)', 2) AS k, regexp_extract(t, '^\s*([-+]?)(\d[\d.,''’]*|[.,]\d+)', 1) AS s FROM n),
b AS (SELECT *, regexp_replace(k, '[''’]', '', 'g') AS b FROM k), m AS (SELECT *, length(b) - length(replace(b, ',', '')) AS commas, length(b) - length(replace(b, '.', '')) AS points FROM b),
d AS (SELECT *, (commas > 0 AND points > 0) OR commas + points = 1 AS dec FROM m),
v AS (SELECT *, CASE WHEN k <> '' THEN CASE WHEN s = '-' THEN -1 ELSE 1 END * (coalesce(nullif(regexp_replace(CASE WHEN dec THEN regexp_extract(b, '^(.*)[.,]', 1) ELSE b END, '[.,]', '', 'g'), ''), '0') || '.' || CASE WHEN dec THEN coalesce(nullif(regexp_extract(b, '[.,]([^.,]*)$', 1), ''), '0') ELSE '0' END)::DOUBLE END AS value FROM d)
SELECT l_orderkey, l_linenumber, value, CASE WHEN regexp_matches(k, '^(?:\d+|[1-9]\d{{0,2}}(?:\.\d{{3}})+)(?:,\d+)?$') THEN CASE WHEN s = '-' THEN -1 ELSE 1 END * replace(replace(k, '.', ''), ',', '.')::DOUBLE ELSE value END AS styled FROM v"""


def f3_cell_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nm.with_cells(written_numbers(spark, sf_dir), "t").drop("t")


F3_SQL = f"""WITH {NUMBERS_SQL}, s AS (SELECT *, regexp_replace(t, '^-', '') AS b FROM n),
v AS (SELECT *, CASE WHEN regexp_matches(t, '^-?[0-9]+([.,][0-9]+)*$') AND length(regexp_replace(t, '[^0-9]', '', 'g')) <= 15 AND NOT regexp_matches(b, '^0[0-9]') THEN try_cast(CASE
 WHEN contains(b, '.') AND contains(b, ',') AND regexp_matches(b, '^[0-9]{{1,3}}(,[0-9]{{3}})+\\.[0-9]+$') THEN replace(t, ',', '')
 WHEN contains(b, '.') AND contains(b, ',') AND regexp_matches(b, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+,[0-9]+$') THEN replace(replace(t, '.', ''), ',', '.')
 WHEN contains(b, '.') AND contains(b, ',') THEN NULL
 WHEN len(regexp_extract_all(b, '[.,]')) > 1 AND regexp_matches(b, '^[0-9]{{1,3}}(,[0-9]{{3}})+$|^[0-9]{{1,3}}(\\.[0-9]{{3}})+$') THEN regexp_replace(t, '[.,]', '', 'g')
 WHEN len(regexp_extract_all(b, '[.,]')) > 1 OR regexp_matches(b, '^[0-9]{{1,3}}[.,][0-9]{{3}}$') THEN NULL ELSE replace(t, ',', '.') END AS DOUBLE) END AS value FROM s),
f AS (SELECT *, regexp_matches(t, '^[=+\\-@\t\r]') AND value IS NULL AS formula FROM v), g AS (SELECT *, CASE WHEN formula THEN '''' || t ELSE t END AS g FROM f)
SELECT l_orderkey, l_linenumber, value, formula, CASE WHEN contains(g, ',') OR contains(g, '"') THEN '"' || replace(g, '"', '""') || '"' ELSE g END AS field FROM g"""


def f6_pdf_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders")
    zone = F.get(F.array(*[F.lit(z) for z in ("Z", "", "+03'00'", "-0530")]), (F.col("o_orderkey") % 4).cast("int"))
    text = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), zone)
    return order.select("o_orderkey", text.alias("t")).select("o_orderkey", "t", dt.pdf_date_text(dt.pdf_date(F.col("t"))).alias("utc"))


F6_SQL = """WITH z AS (SELECT o_orderkey, o_orderdate AS d, ['Z', '', '+03''00''', '-0530'][o_orderkey % 4 + 1] AS z, [0, 0, 180, -330][o_orderkey % 4 + 1] AS m FROM orders)
SELECT o_orderkey, 'D:' || strftime(d, '%Y%m%d%H%M%S') || z AS t, 'D:' || strftime(d - to_minutes(m), '%Y%m%d%H%M%S') || 'Z' AS utc FROM z"""


def f9_display_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d.M.yy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return order.select("o_orderkey", text.alias("t")).select("o_orderkey", "t", dt.display_to_iso(F.col("t")).alias("iso"))


F9_SQL = """WITH p AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN day(d) || '.' || month(d) || '.' || strftime(d, '%y') ELSE strftime(d, '%m/%d/%Y') END AS t,
 CASE WHEN k < 2 THEN strftime(d, '%Y-%m-%d') WHEN day(d) <= 12 THEN strftime(d, '%Y-%d-%m') END AS iso FROM p"""


def f9_date_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates shown by three pictures and read back, and read by a picture that isn't theirs."""
    order = table(spark, sf_dir, "orders")
    k, iso = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd")
    pictures = ("DD/MM/YYYY", "D.M.YY", "YYYY MM (D)")
    each = lambda f: F.when(k == 0, f(pictures[0])).when(k == 1, f(pictures[1])).otherwise(f(pictures[2]))
    shown = order.select("o_orderkey", iso.alias("iso"), each(lambda p: dt.iso_to_picture(iso, p)).alias("shown"))
    back = F.when(k == 0, dt.picture_to_iso(F.col("shown"), pictures[0])).when(k == 1, dt.picture_to_iso(F.col("shown"), pictures[1])).otherwise(dt.picture_to_iso(F.col("shown"), pictures[2]))
    return shown.select("o_orderkey", "shown", back.alias("back"), dt.picture_to_iso(F.col("shown"), "MM/DD/YYYY").alias("other"))


F9P_SQL = """WITH p AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN day(d) || '.' || month(d) || '.' || strftime(d, '%y') ELSE strftime(d, '%Y %m (') || day(d) || ')' END AS shown, strftime(d, '%Y-%m-%d') AS back,
 CASE WHEN k = 0 AND day(d) <= 12 THEN strftime(d, '%Y-%d-%m') END AS other FROM p"""

CALCULATIONS = [("net", "quantity * (line + 1) - 3"), ("third", "net / 3"), ("back", "third * 3 + 0.25"), ("most", "max(third, -(2) + missing.name)"), ("odd", "net / (line - 1)")]


def f11_calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calculations that build on each other; a third that were rounded could not be made whole again."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("line"))
    return forms.calculated(line, CALCULATIONS).select("l_orderkey", "line", *[t for t, _ in CALCULATIONS])


F11_TEXT = "regexp_replace(regexp_replace(printf('%.2f', {x}), '0+$', ''), '\\.$', '')"
F11_SQL = f"""WITH n AS (SELECT l_orderkey, l_linenumber AS line, (l_quantity * (l_linenumber + 1) - 3)::DOUBLE AS n FROM lineitem)
SELECT l_orderkey, line, {F11_TEXT.format(x="n")} AS net, {F11_TEXT.format(x="n / 3")} AS third, {F11_TEXT.format(x="n + 0.25")} AS back, {F11_TEXT.format(x="greatest(n / 3, -2)")} AS most, CASE WHEN line = 1 THEN '0' ELSE {F11_TEXT.format(x="n / (line - 1)")} END AS odd FROM n"""


def f12_field_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    fields = part.select(
        "p_partkey", F.when(k == 0, "choice").when(k == 1, "checkbox").otherwise("text").alias("kind"), F.when(k == 1, "false").when(k == 2, " ").otherwise(F.col("p_brand")).alias("value"),
        (F.col("p_size") == 1).alias("read_only"), F.lit(True).alias("required"), F.when(k == 3, 5).otherwise(100).alias("max_length"), F.array(F.lit("Brand#11"), F.lit("Brand#12")).alias("options"),
    )
    return rules.field_problems(fields).select("p_partkey", "problem")


F12_SQL = """SELECT p_partkey, CASE WHEN p_size = 1 THEN 'read-only' WHEN k = 1 THEN 'required' WHEN k = 2 THEN 'required' WHEN k = 3 AND length(p_brand) > 5 THEN 'too-long'
 WHEN k = 0 AND p_brand NOT IN ('Brand#11', 'Brand#12') THEN 'not-an-option' END AS problem FROM (SELECT *, p_partkey % 4 AS k FROM part)"""


def f14_header_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"page": F.col("l_linenumber").cast("string"), "total": F.lit("7"), "date": F.date_format("l_shipdate", "yyyy-MM-dd"), "file": F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.filled_template(F.lit("{file} {page}/{total} {date} {other}"), values).alias("header"))


F14_SQL = "SELECT l_orderkey, l_linenumber, 'o' || l_orderkey || ' ' || l_linenumber || '/7 ' || strftime(l_shipdate, '%Y-%m-%d') || ' {other}' AS header FROM lineitem"


def f16_limit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = nm.limit_verdict(F.size(F.split("text", "\n")), F.octet_length("text"), warn=5_000, view=20_000)
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"))


F16_SQL = """SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 2000 THEN 'too many pages' WHEN strlen(text) > 314572800 THEN 'too large' WHEN strlen(text) > 20000 THEN 'view only' WHEN strlen(text) > 5000 THEN 'warn' ELSE 'ok' END AS verdict FROM documents"""


def f17_zoom_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("p_size") * 8
    return table(spark, sf_dir, "part").select("p_partkey", nm.zoom_stop(at, ZOOM, up=True).alias("next"), nm.zoom_stop(at, ZOOM, up=False).alias("previous"))


F17_SQL = """WITH s AS (SELECT [10, 25, 50, 75, 100, 125, 150, 200, 300, 400] AS s) SELECT p_partkey, coalesce(list_min(list_filter(s, lambda z: z > p_size * 8)), 400) AS next, coalesce(list_max(list_filter(s, lambda z: z < p_size * 8)), 10) AS previous FROM part, s"""


def f20_column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") % 2000 + 1).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", nm.column_letters(n).alias("letters"))


F20_SQL = """WITH n AS (SELECT p_partkey, (p_partkey % 2000 + 1)::INT AS n FROM part)
SELECT p_partkey, (CASE WHEN n > 702 THEN chr((65 + (n - 703) // 676)::INT) ELSE '' END) || (CASE WHEN n > 26 THEN chr((65 + ((n - 27) // 26) % 26)::INT) ELSE '' END) || chr((65 + (n - 1) % 26)::INT) AS letters FROM n"""


def f21_hex_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem")
    return c.groupBy("l_orderkey").agg(F.max("l_discount").alias("r"), F.max("l_tax").alias("g"), F.max(F.col("l_quantity") / 50).alias("b")).select("l_orderkey", nm.hex_colour(F.col("r") * 10, F.col("g") * 10, F.col("b")).alias("colour"))


F21_SQL = """WITH c AS (SELECT l_orderkey, max(l_discount) * 10 AS r, max(l_tax) * 10 AS g, max(l_quantity / 50) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, printf('#%02x%02x%02x', least(greatest(round(r * 255), 0), 255)::INT, least(greatest(round(g * 255), 0), 255)::INT, least(greatest(round(b * 255), 0), 255)::INT) AS colour FROM c"""


def f24_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length(F.regexp_replace(F.base64(F.encode("text", "utf-8")), "[\r\n]", "")).alias("base64_length"))


F24_SQL = "SELECT doc_id, sha256(text) AS sha256, length(base64(encode(text))) AS base64_length FROM documents"


def r10_form_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.form_json(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("json")))


R10_SQL = """SELECT event_id, k AS name, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"""


def m6_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", nm.significant(F.col("c_acctbal")).alias("decimals"))


M6_SQL = "SELECT c_custkey, CASE WHEN abs(c_acctbal) >= 1000 THEN 0 WHEN abs(c_acctbal) >= 100 THEN 1 WHEN abs(c_acctbal) >= 1 THEN 2 ELSE 3 END AS decimals FROM customer"

QUERIES = {
    "f2_form_number": f2_form_number, "f3_cell_number": f3_cell_number, "f6_pdf_date": f6_pdf_date, "f9_display_date": f9_display_date, "f9_date_pictures": f9_date_pictures, "f11_calculations": f11_calculations,
    "f12_field_validation": f12_field_validation, "f14_header_template": f14_header_template, "f16_limit_verdict": f16_limit_verdict, "f17_zoom_stops": f17_zoom_stops,
    "f20_column_letters": f20_column_letters, "f21_hex_colour": f21_hex_colour, "f24_digests": f24_digests, "r10_form_json": r10_form_json, "m6_significant": m6_significant,
}

ORACLE_SQL = {
    "f2_form_number": F2_SQL, "f3_cell_number": F3_SQL, "f6_pdf_date": F6_SQL, "f9_display_date": F9_SQL, "f9_date_pictures": F9P_SQL, "f11_calculations": F11_SQL, "f12_field_validation": F12_SQL,
    "f14_header_template": F14_SQL, "f16_limit_verdict": F16_SQL, "f17_zoom_stops": F17_SQL, "f20_column_letters": F20_SQL, "f21_hex_colour": F21_SQL, "f24_digests": F24_SQL,
    "r10_form_json": R10_SQL, "m6_significant": M6_SQL,
}
