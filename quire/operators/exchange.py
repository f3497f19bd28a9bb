"""Delimited text, annotation data, XML packets and escaped strings, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import BLANK
from quire.sources.files import as_table, csv_rows, sniff_delimiter

MOST_ROWS = 20_000  # of a table that is shown


def parsed_csv(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, fields) of a column of whole delimited texts, by the delimiter each seems to have."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, numbers, fields = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = csv_rows(t or "", sniff_delimiter(t or ""))
                keys += [k] * len(rows)
                numbers += range(len(rows))
                fields += rows
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(numbers, pa.int32()), pa.array(fields, pa.list_(pa.string()))], names=[key, "row", "fields"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, row int, fields array<string>")


def csv_tables(df: DataFrame, key: str, text: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """(key, row, column, head, value, numeric) of the cells of whole delimited texts: the first row is the head, missing
    cells are empty, and cells below it are numeric as a script's numbers are: with a point or one comma, in hexadecimal,
    octal or binary, or blank but not empty. Of a text of over most_rows rows the first are kept, as csv_notes() tells.
    Tables too wide or too large are refused."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bare = (t or "").removeprefix("\ufeff")
                cells = [(r, c, r == 0, v) for r, row in enumerate(as_table(list(csv_rows(bare, sniff_delimiter(bare)))[:most_rows])) for c, v in enumerate(row)]
                if cells:
                    row, column, head, value = zip(*cells, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(cells), b.column(0).type), pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(head), pa.array(value, pa.string())], names=[key, "row", "column", "head", "value"])

    made = df.select(key, text).mapInArrow(run, f"{key} {kind}, row int, column int, head boolean, value string")
    bare = F.regexp_replace(F.regexp_replace("value", "^([^,]*),", "$1."), rf"\A{BLANK}+|{BLANK}+\z", "")
    number = bare.rlike(r"\A([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)?\z")
    return made.withColumn("numeric", ~F.col("head") & (F.col("value") != "") & number)


def csv_notes(df: DataFrame, key: str, text: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """(key, rows, kept) of the delimited texts that have more rows than csv_tables() keeps."""
    counts = parsed_csv(df, key, text).groupBy(key).agg(F.count("*").alias("rows"))
    return counts.where(F.col("rows") > most_rows).withColumn("kept", F.lit(most_rows))


def annotations(df: DataFrame, column: str, pages: Column) -> DataFrame:
    """Add page, kind, contents, colour and skipped to rows of annotation JSON: a page out of bounds or none is skipped,
    and a colour that isn't #rrggbb is the default yellow."""
    a = F.from_json(column, "struct<page:int,kind:string,contents:string,colour:string>")
    colour = F.when(a["colour"].rlike("^#[0-9a-fA-F]{6}$"), F.lower(a["colour"])).otherwise("#ffff00")
    good = F.coalesce((a["page"] >= 0) & (a["page"] < pages), F.lit(False))
    return df.withColumns({"page": a["page"], "kind": a["kind"], "contents": a["contents"], "colour": colour, "skipped": ~good})


def packet_value(xml: Column, name: str) -> Column:
    """The text of an element of a metadata packet, whatever its prefix."""
    return F.xpath_string(xml, F.lit(f"//*[local-name()='{name}']"))


def escaped_string(text: Column) -> Column:
    """A form-data string: ASCII in parentheses with escapes, anything else as marked UTF-16 in hexadecimal."""
    ascii_form = F.concat(F.lit("("), F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"([\\()])", r"\\$1"), "\r", r"\\r"), "\n", r"\\n"), F.lit(")"))
    wide = F.concat(F.lit("<FEFF"), F.hex(F.encode(text, "UTF-16BE")), F.lit(">"))
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), ascii_form).otherwise(wide)


def flipped(y0: Column, y1: Column, top: Column) -> tuple[Column, Column]:
    """The lower and upper edge of a rectangle seen from the other side of the page."""
    return top - y1, top - y0


def field_entries(text: Column) -> Column:
    """The (name, value) pairs of form data: `/T (name) /V (value)`, strings unescaped."""
    string = r"\(((?:\\.|[^\\)])*+)\)"
    pattern = F.lit(rf"/T\s*{string}\s*/V\s*{string}")
    plain = lambda x: F.regexp_replace(x, r"\\(.)", "$1")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("value"))
    return F.transform(pairs, lambda p: F.struct(plain(p["name"]).alias("name"), plain(p["value"]).alias("value")))


def best_face(bold: Column, italic: Column, faces: list[tuple[str, bool, bool]]) -> Column:
    """The name of the face (name, bold, italic) that agrees in most styles, the first by name of equals."""
    agrees = lambda b, i: (bold == F.lit(b)).cast("int") + (italic == F.lit(i)).cast("int")
    return F.array_min(F.array(*[F.struct((-agrees(b, i)).alias("s"), F.lit(n).alias("name")) for n, b, i in faces]))["name"]
