"""Column functions over dates as documents write them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import BLANK, let

# Fixed value: the shape of a date as documents hold it; all after the year may be left out.
PDF_DATE = r"(?i)^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:Z(?:\d{2}'?(?:\d{2}'?)?)?|([+-])(\d{2})'?(\d{2})?'?)?\z"


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS with a zone such as Z, +02'00' or -0530 as a timestamp in UTC; parts left out are 01 or 00, no zone
    is UTC. The whole trimmed text must be a date, and one that there is; anything else is null."""
    return let(F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", ""), lambda bare: F.when(bare.rlike(PDF_DATE), let(F.regexp_extract(bare, r"\d+", 0), lambda digits: _dated(bare, digits))))


def _dated(bare: Column, digits: Column) -> Column:
    """The timestamp of a text in the shape of a date, whose first digits are given: pairs after the year, as many as there are."""
    zone = F.replace(F.substr(bare, F.length(digits) + 3), F.lit("'"), F.lit(""))
    part = lambda of, k, other, n=2: F.coalesce(F.nullif(F.substring(of, k, n), F.lit("")), F.lit(other)).try_cast("int")
    year, month, day, hour, minute, second = part(digits, 1, "", 4), *(part(digits, k, o) for k, o in ((5, "01"), (7, "01"), (9, "00"), (11, "00"), (13, "00")))
    sign = F.when(F.left(zone, F.lit(1)) == "-", -1).when(F.left(zone, F.lit(1)) == "+", 1).otherwise(0)
    hours, minutes = (F.when(sign != 0, part(zone, k, "00")).otherwise(0) for k in (2, 4))
    there = F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(8,6)"))
    sound = (year >= 1) & (hour < 24) & (minute < 60) & (second < 60) & (hours < 24) & (minutes < 60)
    return F.when(sound, there - F.make_dt_interval(mins=sign * (hours * 60 + minutes)))


def pdf_date_text(ts: Column) -> Column:
    """A timestamp as D:YYYYMMDDHHmmSSZ; null outside the years 1 to 9999."""
    return let(ts, lambda t: F.when(F.year(t).between(1, 9999), F.concat(F.lit("D:"), F.date_format(t, "yyyyMMddHHmmss"), F.lit("Z"))))


def review_seconds(text: Column) -> Column:
    """When a review was, in seconds since the epoch: a PDF date or an ISO time; 0 for anything else."""
    return F.coalesce(F.unix_seconds(F.coalesce(pdf_date(text).cast("timestamp"), F.try_to_timestamp(text))), F.lit(0).cast("long"))


def display_to_iso(text: Column) -> Column:
    """DD/MM/YYYY or DD.MM.YY as YYYY-MM-DD; two-digit years from 70 are 1900s. Only 1 to 12 and 1 to 31 are checked."""
    p = r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})$"
    day, month, year = (F.regexp_extract(text, p, k) for k in (1, 2, 3))
    full = F.when(F.length(year) == 4, year).otherwise(F.concat(F.when(year >= "70", F.lit("19")).otherwise(F.lit("20")), year))
    sound = text.rlike(p) & day.try_cast("int").between(1, 31) & month.try_cast("int").between(1, 12)
    return F.when(sound, F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


# The parts of a date picture, longest first, and what a part takes of a date.
PICTURE = re.compile("YYYY|YY|MM|M|DD|D")


def picture_to_iso(text: Column, picture: str) -> Column:
    """A date as a picture such as DD/MM/YYYY or D.M.YY shows it, as YYYY-MM-DD; null where it doesn't match. Single letters
    take one or two digits; years of two digits from 70 on are 1900s; of a part given twice the last counts. A year, months
    from 1 to 12 and days from 1 to 31 must be there; the calendar isn't asked."""
    width = {"YYYY": r"(\d{4})", "M": r"(\d{1,2})", "D": r"(\d{1,2})"}
    parts = PICTURE.findall(picture)
    pattern = "".join(width.get(p, r"(\d{2})") if PICTURE.fullmatch(p) else re.escape(p) for p in re.split(f"({PICTURE.pattern})", picture))
    bare = F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")
    found = {p[0]: (p, F.regexp_extract(bare, rf"\A{pattern}\z", k + 1).try_cast("int")) for k, p in enumerate(parts)}
    if set(found) != set("YMD"):
        return F.lit(None).cast("string")
    short, year = found["Y"][0] == "YY", found["Y"][1]
    full = F.when(year < 70, 2000 + year).otherwise(1900 + year) if short else year
    month, day = found["M"][1], found["D"][1]
    sound = bare.rlike(rf"\A{pattern}\z") & (full > 0) & month.between(1, 12) & day.between(1, 31)
    digits = lambda n, k: F.lpad(n.cast("string"), k, "0")
    return F.when(sound, F.concat_ws("-", digits(full, 4), digits(month, 2), digits(day, 2)))


def iso_to_picture(text: Column, picture: str) -> Column:
    """The way back: YYYY-MM-DD as a picture shows it; null for anything else."""
    bare = F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")
    year, month, day = F.substring(bare, 1, 4), F.substring(bare, 6, 2), F.substring(bare, 9, 2)
    plain = lambda n: n.try_cast("int").cast("string")
    shown = {"YYYY": year, "YY": F.substring(year, 3, 2), "MM": month, "M": plain(month), "DD": day, "D": plain(day)}
    parts = [shown.get(p, F.lit(p)) for p in re.split(f"({PICTURE.pattern})", picture) if p]
    return F.when(bare.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.concat(*parts) if parts else F.lit(""))
