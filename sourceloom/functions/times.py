"""Column helpers for time: aware timestamps, ages, dates in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names with their accepted short forms.
MONTHS = {"jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4,
          "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
          "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11,
          "november": 11, "dec": 12, "december": 12}
_AWARE = (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?"
          r"([Zz]|[+-]\d{2}:?\d{2}(:?\d{2})?)$")
_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))


def aware_ts(c: Column) -> Column:
    """UTC timestamp from ISO text that states its offset; null for anything else."""
    text = F.trim(c)
    return F.when(text.rlike(_AWARE), F.try_to_timestamp(F.upper(text)))


def publication_ts(c: Column) -> Column:
    """As ``aware_ts``: a date-only or zone-free label stays null, no zone is invented."""
    return aware_ts(c)


def age_hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def _month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.element_at(table, F.lower(name))


def _date_of(y: Column, m: Column, d: Column) -> Column:
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(m.isNotNull(), F.to_date(F.try_to_timestamp(
        F.concat_ws("-", y, pad(m), pad(d)), F.lit("yyyy-MM-dd"))))


def prose_dates(c: Column) -> Column:
    """Distinct full dates written in prose: ISO, month-day-year, day-month-year."""
    iso = F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\b\d{4}-\d{2}-\d{2}\b"), 0),
                      lambda t: F.to_date(F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))))
    mdy_p = rf"(?iU)\b({_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?[,]?\s+(\d{{4}})\b"
    dmy_p = rf"(?iU)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_NAMES})\.?[,]?\s+(\d{{4}})\b"
    part = lambda t, p, i: F.regexp_extract(t, p, i)
    mdy = F.transform(F.regexp_extract_all(c, F.lit(mdy_p), 0), lambda t: _date_of(
        part(t, mdy_p, 3), _month_number(part(t, mdy_p, 1)), part(t, mdy_p, 2)))
    dmy = F.transform(F.regexp_extract_all(c, F.lit(dmy_p), 0), lambda t: _date_of(
        part(t, dmy_p, 3), _month_number(part(t, dmy_p, 2)), part(t, dmy_p, 1)))
    return F.array_distinct(F.array_compact(F.concat(iso, mdy, dmy)))


def month_day_present(text: Column, day: Column) -> Column:
    """The day of a date is named in the text, with or without the year."""
    names = {n: "|".join(k for k, v in MONTHS.items() if v == n) for n in range(1, 13)}
    month = F.element_at(F.create_map(*[x for n, p in names.items() for x in (F.lit(n), F.lit(p))]),
                         F.month(day))
    dom = F.dayofmonth(day).cast("string")
    pattern = F.concat(F.lit(r"(?iU)\b(?:"), month, F.lit(r")\.?\s+0?"), dom, F.lit(r"\b|\b0?"), dom,
                       F.lit(r"\s+(?:"), month, F.lit(r")\.?\b"))
    return F.coalesce(F.regexp_like(text, pattern), F.lit(False))


def names_a_day(text: Column) -> Column:
    return text.rlike(rf"(?iU)\b(?:{_NAMES})\.?\s+\d{{1,2}}\b|\b\d{{1,2}}\s+(?:{_NAMES})\b")


def capture_ts(c: Column) -> Column:
    """Fourteen-digit archive stamp to UTC timestamp; null when it is not a real time."""
    return F.when(c.rlike(r"^\d{14}$"), F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")))
