"""Tables, and the document model derived from them: pages and lines of `documents.text`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_A_PAGE = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text): every line, from 0, empty ones too."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def pages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text): runs of LINES_A_PAGE lines, from 0. Made inside each row, so nothing is shuffled."""
    lines = F.split("text", "\n")
    count = F.ceil(F.size(lines) / LINES_A_PAGE).cast("int")
    page = lambda p: F.array_join(F.slice(lines, p * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)), "\n")
    return docs.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), page)).alias("page", "text"))
