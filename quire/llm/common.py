"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from quire.sources.shared import shared_folder

# Fixed value: the white space that separates words, \x20 and \x09-\x0D, as a character class.
SPACE = r"[ \t-\r]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this run, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_narrow(df: DataFrame) -> DataFrame:
    """cut() for a table of a few numbers a row: one file a core at most, as loops would write very many small ones."""
    return cut(df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)))


def text_of(column: Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(column.cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text that is not null, in order."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))


def lower_ascii(text: Column) -> Column:
    """A text with A-Z in lower case and all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once: what stands in a lambda several times is otherwise worked out as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """df's rows as one struct, `row`, beside the columns an operator works on; `row.*` gives them back. So no name of
    df's can clash with one of the operator's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def with_columns_over(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; those of df that have the same names (in any case) go."""
    taken = {name.lower() for name in columns}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def id_remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo `of`: a fixed way to hold documents out. A null id gives 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)), F.lit(0))
