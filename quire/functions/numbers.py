"""Column functions over numbers written as text, and numbers written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# How numbers look in the styles that a form field may name, their grouping marks, and their decimal mark.
STYLES = {
    0: (r"^(?:\d+|[1-9]\d{0,2}(?:,\d{3})+)(?:\.\d+)?$", ",", "."),
    1: (r"^\d+(?:\.\d+)?$", "", "."),
    2: (r"^(?:\d+|[1-9]\d{0,2}(?:\.\d{3})+)(?:,\d+)?$", ".", ","),
    3: (r"^\d+(?:,\d+)?$", "", ","),
    4: (r"^(?:\d+|[1-9]\d{0,2}(?:['’]\d{3})+)(?:\.\d+)?$", "'’", "."),
}
# Fixed value: how a number begins that a calculation reads off a text.
NUMBER = r"^\s*([-+]?)(\d[\d.,'’]*|[.,]\d+)"


def form_number(text: Column, style: Column | None = None) -> Column:
    """The leading number of a form value, as a double; null where there is none.

    A text written in the field's style (0 to 4, null for none) is read in it. Otherwise its own marks decide: of both
    the last is the decimal one; a single kind is decimal where it occurs once, and groups where it occurs more often.
    Apostrophes group.
    """
    token = F.regexp_extract(text, NUMBER, 2)
    bare = F.regexp_replace(token, "['’]", "")
    commas, points = F.regexp_count(bare, F.lit(",")), F.regexp_count(bare, F.lit(r"\."))
    decimal = (commas + points == 1) | ((commas > 0) & (points > 0))
    whole = F.when(decimal, F.regexp_extract(bare, r"^(.*)[.,]", 1)).otherwise(bare)
    part = F.when(decimal, F.regexp_extract(bare, r"[.,]([^.,]*)$", 1)).otherwise("")
    number = F.concat_ws(".", F.coalesce(F.nullif(F.regexp_replace(whole, "[.,]", ""), F.lit("")), F.lit("0")), F.coalesce(F.nullif(part, F.lit("")), F.lit("0")))
    if style is not None:
        for k, (shape, groups, mark) in STYLES.items():
            plain = F.translate(F.translate(token, groups, "") if groups else token, mark, ".")
            number = F.when((style == k) & token.rlike(shape), plain).otherwise(number)
    sign = F.when(F.regexp_extract(text, NUMBER, 1) == "-", -1.0).otherwise(1.0)
    return F.when(token != "", sign * number.try_cast("double"))


def cell_number(text: Column) -> Column:
    """The number a table cell holds without doubt, as a double; null where it is text.

    At most 15 digits and no leading zero. With both marks the last is the decimal one and groups hold 1 to 3 digits,
    then 3 each. A single mark before exactly 3 digits, with at most 3 before it, could be either: that is text.
    """
    t = F.trim(text)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    bare = F.regexp_replace(t, "^-", "")
    shape = t.rlike(r"^-?[0-9]+([.,][0-9]+)*$") & (digits <= 15) & ~bare.rlike("^0[0-9]")
    both = bare.contains(".") & bare.contains(",")
    many = F.regexp_count(bare, F.lit("[.,]")) > 1
    english, german = r"^[0-9]{1,3}(,[0-9]{3})+\.[0-9]+$", r"^[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$"
    grouped = r"^[0-9]{1,3}(,[0-9]{3})+$|^[0-9]{1,3}(\.[0-9]{3})+$"
    unclear = bare.rlike(r"^[0-9]{1,3}[.,][0-9]{3}$")
    number = (
        F.when(both & bare.rlike(english), F.replace(t, F.lit(","), F.lit("")))
        .when(both & bare.rlike(german), F.translate(t, ",.", "."))
        .when(both, F.lit(None))
        .when(many & bare.rlike(grouped), F.regexp_replace(t, "[.,]", ""))
        .when(many | unclear, F.lit(None))
        .otherwise(F.translate(t, ",", "."))
    )
    return F.when(shape, number.try_cast("double"))


def is_formula(text: Column, value: Column | None = None) -> Column:
    """Whether a spreadsheet would take a cell for a formula: an opening sign, and not a number. value is the cell's
    number, where it is there already."""
    return text.rlike(r"^[=+\-@\t\r]") & (cell_number(text) if value is None else value).isNull()


def csv_field(text: Column, delimiter: str = ",", formula: Column | None = None) -> Column:
    """A field as written: formulas get an apostrophe, and quotes stand where they are needed."""
    guarded = F.when(is_formula(text) if formula is None else formula, F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(guarded.rlike(f'["\r\n{delimiter}]'), quoted).otherwise(guarded)


def with_cells(rows: DataFrame, text: str, delimiter: str = ",") -> DataFrame:
    """Add value (the cell's number), formula and field (the cell as written), each from the one before."""
    out = rows.withColumn("value", cell_number(F.col(text)))
    out = out.withColumn("formula", is_formula(F.col(text), F.col("value")))
    return out.withColumn("field", csv_field(F.col(text), delimiter, F.col("formula")))


def size_text(n: Column) -> Column:
    """A number of bytes for people: `900 B`, `1.5 KB`, `5.3 MB`; a dash for null and negative ones.

    Kilobytes are rounded before the unit is chosen, so 1,048,575 bytes are 1.0 MB.
    """
    kilo = F.round(n / 1024, 1)
    tenth = lambda x: F.format_string("%,.1f", F.round(x, 1))
    text = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(kilo < 1024, F.concat(tenth(kilo), F.lit(" KB"))).otherwise(F.concat(tenth(n / (1024 * 1024)), F.lit(" MB")))
    return F.when(n.isNull() | (n < 0), F.lit("—")).otherwise(text)


def percent_text(fraction: Column, digits: int = 0) -> Column:
    """A fraction as a percentage: 1.4 is `140%`."""
    return F.concat(F.format_string(f"%,.{digits}f", F.round(fraction * 100, digits).cast("double")), F.lit("%"))


def limit_verdict(pages: Column, size: Column, warn: int, view: int, most_bytes: int = 300 * 1024 * 1024, most_pages: int = 2000) -> Column:
    """Whether a document is too large to open, can only be viewed, is large, or ok."""
    return F.when(pages > most_pages, "too many pages").when(size > most_bytes, "too large").when(size > view, "view only").when(size > warn, "warn").otherwise("ok")


def zoom_stop(at: Column, stops: list[int], up: bool) -> Column:
    """The next stop above (below) a zoom, or the last (first) one beyond them."""
    listed = F.array(*[F.lit(z) for z in stops])
    return F.coalesce(F.array_min(F.filter(listed, lambda z: z > at)), F.lit(max(stops))) if up else F.coalesce(F.array_max(F.filter(listed, lambda z: z < at)), F.lit(min(stops)))


def luma(red: Column, green: Column, blue: Column, weights: tuple[int, int, int] = (299, 587, 114)) -> Column:
    """The grey of a colour: the weighted mean, rounded down. Scans weigh in thousandths, comparisons (77, 150, 29)."""
    return F.floor((weights[0] * red + weights[1] * green + weights[2] * blue) / sum(weights))


def padded(number: Column, width: Column | int) -> Column:
    """Zeros up to a width; longer numbers stay whole."""
    text = number.cast("string")
    width = F.lit(width) if isinstance(width, int) else width
    return F.lpad(text, F.greatest(F.length(text), width), F.lit("0"))


def roman(number: Column) -> Column:
    """Capital Roman numerals, for 1 to 3999."""
    # The digits of each place.
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    parts = [F.repeat(F.lit("M"), F.floor(number / 1000).cast("int"))]
    for place, swap in ((100, "CDM"), (10, "XLC"), (1, "IVX")):
        digits = F.array(*[F.lit(d.translate(str.maketrans("IVX", swap))) for d in ones])
        parts.append(F.get(digits, (F.floor(number / place) % 10).cast("int")))
    return F.concat(*parts)


def letters(number: Column) -> Column:
    """A to Z, then AA to ZZ, then AAA: a letter repeated, as page labels have it."""
    at = (number - 1).cast("int")
    return F.repeat(F.chr(F.lit(65) + at % 26), F.floor(at / 26).cast("int") + 1)


def column_letters(number: Column) -> Column:
    """Spreadsheet columns: 1 is A, 27 is AA, 703 is AAA, and so on; null below 1."""
    n, out, least = number.cast("long"), F.lit(""), 0
    for place in range(14):  # 26 ** 14 is beyond any long
        least += 26**place  # the first number that has this letter
        letter = F.chr(F.lit(65) + F.call_function("div", n - F.lit(least), F.lit(26**place)) % 26)
        out = F.concat(F.when(n >= least, letter).otherwise(""), out)
    return F.when(n >= 1, out)


def significant(value: Column) -> Column:
    """Decimals to show: none from 1000, one from 100, two from 1, else three."""
    size = F.abs(value)
    return F.when(F.isnan(value) | value.isNull() | (size == float("inf")), 0).when(size >= 1000, 0).when(size >= 100, 1).when(size >= 1, 2).otherwise(3)


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    byte = lambda c: F.lpad(F.lower(F.hex(F.least(F.greatest(F.round(c * 255).cast("int"), F.lit(0)), F.lit(255)))), 2, "0")
    return F.concat(F.lit("#"), byte(red), byte(green), byte(blue))


def calculation_text(value: Column) -> Column:
    """A result as form text: an integer as one, else two decimals without trailing zeros."""
    rounded = F.round(value, 2)
    whole = rounded == F.round(value, 0)
    return F.when(whole, rounded.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", rounded), "0+$", ""))
