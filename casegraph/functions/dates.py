"""Dates as printed in documents, as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits

# English month names by their first three letters.
MONTHS = {"jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12"}
YMD = r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})"
DMY = r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"
WORDY = r"([0-9]{1,2})[\s\-_]([\p{L}\p{N}_]+)[\s\-_]([0-9]{2,4})"
SHORT = r"^([0-9]{2})[/-]([0-9]{1,2})[/-]([0-9]{1,2})$"


def _part(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))


def _parts(x: Column, pattern: str, order: tuple[int, int, int]) -> tuple[Column, Column, Column]:
    return tuple(_part(x, pattern, g) for g in order)


def normalise_date(x: Column) -> Column:
    """YYYY-MM-DD, with " (AH)" for years of the Hijri calendar; what can't be read is cut to 10 characters; "—" for nothing."""
    text = F.trim(ascii_digits(F.coalesce(x, F.lit(""))))
    hijri = x.contains("ه") | F.upper(x).contains("AH")
    plain = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_/\-]", " "))

    def dated(pattern: str, order: tuple[int, int, int]) -> Column:
        year, month, day = _parts(plain, pattern, order)
        era = F.when((year.cast("int") < 1500) | hijri, F.lit(" (AH)")).otherwise(F.lit(""))
        return F.concat(_iso(year, month, day), era)

    months = F.create_map(*[F.lit(v) for pair in MONTHS.items() for v in pair])
    month = F.try_element_at(months, F.substring(F.lower(_part(plain, WORDY, 2)), 1, 3))
    year = _part(plain, WORDY, 3)
    full_year = F.when(F.char_length(year) == 2, F.concat(F.lit("20"), year)).otherwise(F.lpad(year, 4, "0"))
    wordy = _iso(full_year, month, _part(plain, WORDY, 1))
    y, m, d = _parts(plain, SHORT, (1, 2, 3))
    short = F.concat(_iso(F.concat(F.lit("14"), y), m, d), F.lit(" (AH)"))
    found = F.coalesce(dated(YMD, (1, 2, 3)), dated(DMY, (3, 2, 1)), wordy, short, F.substring(plain, 1, 10))
    return F.when(text.isin("", "—"), F.lit("—")).otherwise(found)


def date_for_matching(x: Column) -> Column:
    """An ISO date only where day and month can't be mistaken for each other and the year is written out; else null."""
    pattern = r"(?<![0-9])([0-9]{1,2})[\-/.]([0-9]{1,2})[\-/.]([0-9]{2,4})(?![0-9])"
    text = ascii_digits(x)
    first, second, year = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
    a, b, y = (c.try_cast("int") for c in (first, second, year))
    sure = F.when((a > 12) & (b <= 12), _iso(year, second, first)).when((b > 12) & (a <= 12), _iso(year, first, second))
    return F.when(y >= 100, sure)


def date_key(x: Column) -> Column:
    """struct<undated int, iso, raw> that sorts dated texts first; a year alone comes after its days; undated ones last."""
    raw = F.trim(F.coalesce(x, F.lit("")))
    digits = ascii_digits(raw)
    y1, m1, d1 = _parts(digits, YMD, (1, 2, 3))
    y2, m2, d2 = _parts(digits, DMY, (3, 2, 1))
    year = _part(digits, r"(?<![\p{L}\p{N}_])([0-9]{4})(?![\p{L}\p{N}_])", 1)
    iso = F.coalesce(_iso(y1, m1, d1), _iso(y2, m2, d2), F.concat(year, F.lit("-99-99")))
    return F.struct(F.when(iso.isNull(), 1).otherwise(0).alias("undated"), F.coalesce(iso, F.lit("9999-99-99")).alias("iso"), raw.alias("raw"))


def parse_timestamp(x: Column) -> Column:
    """A timestamp text in either of two forms; an offset at its end is dropped, not applied."""
    text = F.regexp_replace(F.trim(x), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, r"\.[0-9]+$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
