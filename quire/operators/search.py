"""Search over pages, and replacement of what it finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.expressions import FormError


def search(pages: DataFrame, needle: str, match_case: bool = False) -> DataFrame:
    """(doc_id, page, start, length, snippet, snippet_start), non-overlapping, left to right; no rows for an empty needle.

    Offsets are code points. Each page is scanned in its own row; only matches are exploded.
    """
    if not needle:
        return search(pages, "-").where(F.lit(False))
    pattern = tx.re.escape(needle) if match_case else tx.needle_pattern(needle)
    n = len(needle)
    found = pages.where(F.col("text").rlike(pattern)).select("doc_id", "page", "text", F.explode(tx.match_starts(F.col("text"), pattern, n)).alias("start"))
    lead = F.when(F.col("start") > tx.SNIPPET, 1).otherwise(0)
    before = F.col("start") - F.greatest(F.col("start") - tx.SNIPPET, F.lit(0))
    return found.select("doc_id", "page", "start", F.lit(n).alias("length"), tx.snippet(F.col("text"), F.col("start"), n).alias("snippet"), (before + lead).alias("snippet_start"))


def replace_plan(docs: DataFrame, word: str, replacement: str) -> DataFrame:
    """(doc_id, found, unchanged, replaced): whole words in any case; one that is already the replacement is unchanged."""
    if tx.re.search(tx.FORBIDDEN, replacement):
        raise FormError("the replacement holds a character that text can't show")
    edge = r"[\p{L}\p{N}\p{M}_]"
    exact = F.regexp_count("text", F.lit(rf"(?<!{edge}){tx.re.escape(replacement)}(?!{edge})"))
    found = tx.whole_word_count(F.col("text"), word)
    same = F.when(F.lit(replacement).rlike(f"^{tx.needle_pattern(word)}$"), exact).otherwise(0)
    return docs.select("doc_id", found.alias("found"), same.alias("unchanged")).withColumn("replaced", F.col("found") - F.col("unchanged"))


def replaced(docs: DataFrame, word: str, replacement: str) -> DataFrame:
    """docs with the word replaced wherever it stands whole."""
    edge = r"[\p{L}\p{N}\p{M}_]"
    pattern = rf"(?<!{edge}){tx.needle_pattern(word)}(?!{edge})"
    return docs.withColumn("text", F.regexp_replace("text", pattern, replacement.replace("\\", "\\\\").replace("$", "\\$")))
