"""Queries of find and replace on text as it is set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import aligned
from quire.plans.text_queries import PAGES_SQL, docs
from quire.sources.tables import pages_of


def _as_set(text):
    """Texts as a page sets them: fi as a ligature, é as two code points, `the` with a soft hyphen, words broken before ion."""
    ligatures = F.replace(F.replace(text, F.lit("fi"), F.lit("\ufb01")), F.lit("\u00e9"), F.lit("e\u0301"))
    return F.regexp_replace(F.regexp_replace(ligatures, "the", "th\u00ade"), "([a-z])ion", "$1-\nion")


def s7_folded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search compares in each document, set with ligatures, accents of their own and broken words."""
    units = aligned.folded_blocks(docs(spark, sf_dir).withColumn("text", _as_set(F.col("text"))), ["doc_id"])
    return units.select("doc_id", F.md5(F.col("folded").cast("binary")).alias("md5"), F.size("sources").alias("n"))


_FOLDED = r"replace(lower(replace(trim(regexp_replace(regexp_replace(text, '-\n(\p{Ll})', '\1', 'g'), '\s+', ' ', 'g')), 'I', chr(1))), chr(1), 'I')"
S7U_SQL = f"SELECT doc_id, md5({_FOLDED}) AS md5, length({_FOLDED}) AS n FROM documents"


def s8_aligned_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of three needles in those texts: all, aligned, and the characters of the source that aligned ones cover."""
    blocks = docs(spark, sf_dir).withColumn("text", _as_set(F.col("text"))).select("doc_id", "text")
    found = aligned.searched(blocks, ["doc_id"], [("in", False), ("The", True), ("\u00e9", False)])
    covered = F.sum(F.when(F.col("aligned"), F.col("stop") - F.col("start")).otherwise(0))
    return found.groupBy("doc_id", "needle").agg(F.count("*").alias("found"), F.count(F.when(F.col("aligned"), 1)).alias("aligned"), covered.alias("covered"))


S8_SQL = r"""WITH t AS (SELECT doc_id, regexp_replace(text, '-\n(\p{Ll})', '\1', 'g') AS t FROM documents),
c AS (SELECT doc_id, 'in' AS needle, len(regexp_extract_all(t, '(?i)in')) AS found, len(regexp_extract_all(t, '(?i)in')) - len(regexp_extract_all(t, 'fi[nN]')) AS aligned,
  2 * (len(regexp_extract_all(t, '(?i)in')) - len(regexp_extract_all(t, 'fi[nN]'))) AS covered FROM t
UNION ALL SELECT doc_id, 'The', len(list_filter(w, lambda x: lower(x) = 'the')), len(list_filter(w, lambda x: lower(x) = 'the')),
  3 * len(list_filter(w, lambda x: lower(x) = 'the')) + len(list_filter(w, lambda x: x = 'the')) FROM (SELECT doc_id, regexp_split_to_array(t, '[^\p{L}\p{N}\p{M}_]+') AS w FROM t)
UNION ALL SELECT doc_id, 'é', len(regexp_extract_all(t, '[éÉ]')), len(regexp_extract_all(t, '[éÉ]')), 2 * len(regexp_extract_all(t, 'é')) + len(regexp_extract_all(t, 'É')) FROM t)
SELECT doc_id, needle, found, aligned, covered FROM c WHERE found > 0"""


def s10_replace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page one block, each third not editable; `the` becomes `The`, whole words."""
    blocks = pages_of(docs(spark, sf_dir)).withColumn("editable", F.col("page") % 3 != 1)
    report = aligned.replace_report(blocks, ["doc_id"], "the", "The", whole_word=True)
    return report.select("doc_id", "found", "replaced", "skipped", "unchanged", F.array_join("changed_pages", ",").alias("changed_pages"), F.array_join("skipped_pages", ",").alias("skipped_pages"))


S10R_SQL = rf"""WITH {PAGES_SQL},
w AS (SELECT doc_id, page, page % 3 <> 1 AS able, regexp_split_to_array(regexp_replace(text, '-\n(\p{{Ll}})', '\1', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_]+') AS w FROM pages),
n AS (SELECT doc_id, page, able, len(list_filter(w, lambda x: lower(x) = 'the')) AS found, len(list_filter(w, lambda x: x = 'The')) AS same FROM w)
SELECT doc_id, sum(found)::BIGINT AS found, coalesce(sum(found - same) FILTER (able), 0)::BIGINT AS replaced, coalesce(sum(found) FILTER (NOT able), 0)::BIGINT AS skipped, coalesce(sum(same) FILTER (able), 0)::BIGINT AS unchanged,
  coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (able AND found > same), '') AS changed_pages, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (NOT able), '') AS skipped_pages
FROM n WHERE found > 0 GROUP BY doc_id"""

QUERIES = {"s7_folded_units": s7_folded_units, "s8_aligned_matches": s8_aligned_matches, "s10_replace_report": s10_replace_report}
ORACLE_SQL = {"s7_folded_units": S7U_SQL, "s8_aligned_matches": S8_SQL, "s10_replace_report": S10R_SQL}
