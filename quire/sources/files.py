"""Readers of raw files: texts of unknown encoding, and delimited text with ragged rows and stray quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, text) of every file: UTF-16 by its mark, else UTF-8 if sound, else Windows-1254."""
    raw = spark.read.format("binaryFile").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *decoded(c)) for p, c in zip(b["path"], b["content"], strict=True)], columns=["path", "encoding", "text"])

    return raw.select("path", "content").mapInPandas(run, "path string, encoding string, text string")


def decoded(content: bytes) -> tuple[str, str]:
    if content[:2] == b"\xff\xfe":
        return "utf-16le", content[2:].decode("utf-16-le", "replace")
    if content[:2] == b"\xfe\xff":
        return "utf-16be", content[2:].decode("utf-16-be", "replace")
    try:
        return "utf-8", content.removeprefix(b"\xef\xbb\xbf").decode()
    except UnicodeDecodeError:
        return "windows-1254", content.decode("cp1254", "replace")


def csv_rows(text: str, delimiter: str) -> list[list[str]]:
    """Rows of fields: a quote opens a field only at its start, two quotes are one, any line end ends a row."""
    rows, row, field, quoted, at = [], [], "", False, 0
    while at < len(text):
        c = text[at]
        at += 1
        if quoted:
            if c == '"' and text[at : at + 1] == '"':
                field += c
                at += 1
            elif c == '"':
                quoted = False
            else:
                field += c
        elif c == '"' and not field:
            quoted = True
        elif c == delimiter:
            row.append(field)
            field = ""
        elif c in "\r\n":
            at += c == "\r" and text[at : at + 1] == "\n"
            rows.append([*row, field])
            row, field = [], ""
        else:
            field += c
    return [*rows, [*row, field]] if field or row else rows


def sniff_delimiter(text: str) -> str:
    """Comma, semicolon or tab: the one that makes most fields of the first line, by far if the first five lines agree
    (lines end with \\n or \\r\\n; empty ones don't count)."""
    best, top = ",", -1
    lines = [line for line in re.split(r"\r?\n", text, maxsplit=5)[:5] if line]
    for d in ",;\t":
        counts = [len(next(iter(csv_rows(line, d)), [])) for line in lines]
        first = counts[0] if counts else 0
        score = first + 100 * (len(set(counts)) == 1) if first > 1 else 0
        if score > top:
            best, top = d, score
    return best


def as_table(rows: list[list[str]], most_columns: int = 1_000, most_cells: int = 2_000_000) -> list[list[str]]:
    """Rows as wide as the widest, missing cells empty; refused beyond the bounds of columns and cells."""
    width = max(map(len, rows), default=0)
    if width > most_columns or len(rows) * width > most_cells:
        raise ValueError(f"a table of {len(rows)} rows and {width} columns is too large")
    return [row + [""] * (width - len(row)) for row in rows]


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, fields) of delimited files; each file is read whole, by the encoding and delimiter it seems to have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, text in zip(b["path"], b["text"], strict=True):
                rows = csv_rows(text, sniff_delimiter(text))
                yield pd.DataFrame({"path": p, "row": range(len(rows)), "fields": rows})

    return read_texts(spark, path).mapInPandas(run, "path string, row int, fields array<string>")


def write_delimited(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Text files of delimited rows, with formulas guarded and fields quoted only where they must be."""
    from quire.functions.numbers import csv_field

    fields = [F.coalesce(csv_field(F.col(f"`{c}`").cast("string"), delimiter), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(delimiter, *fields).alias("value")).write.text(path)
