"""Days from time texts, lists of them, and the calendar of anchors."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import BLANKS

#: Sign and year, then a month and a day of two digits each, both optional; whatever follows does not count.
TIME_PATTERN = r"^([+-]?[0-9]+)(?:-([0-9]{2})(?:-([0-9]{2}))?)?"
#: The same in parts: a whole day as it is mostly written; a year from 1 to 9999, a month and a day that there are.
_PLAIN = r"^(?!0000)[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$"
_YEAR, _MONTH, _DAY = r"^\+?0*([1-9][0-9]{0,3})(?![0-9])", r"^[+-]?[0-9]+-(0[1-9]|1[0-2])", r"^[+-]?[0-9]+-[0-9]{2}-(0[1-9]|[12][0-9]|3[01])"
#: Number of the day 0001-01-01 before 1970-01-01, and of 9999-12-31 counted from 0001-01-01.
DAYS_TO_EPOCH, LAST_DAY = 719162, 3652058


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_day(text: Column | str) -> Column:
    """Day that a time text stands for, or null.

    A missing, zero or impossible month or day (13, 32) counts as the first; a day that the month lacks (February
    30), a year outside 1..9999 and any other text give null. Never raises, whatever the text.
    """
    raw = _col(text)
    t = F.trim(raw, F.lit(BLANKS))
    part = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    first = F.lit("01")
    slow = F.concat(F.lpad(part(_YEAR), 4, "0"), F.lit("-"), F.coalesce(part(_MONTH), first), F.lit("-"), F.coalesce(part(_DAY), first))
    return F.when(raw.rlike(_PLAIN), raw.try_cast("date")).otherwise(slow.try_cast("date"))


def days_of(texts: Column | str) -> Column:
    """Sorted distinct days of a list of time texts; elements that are no day are left out, null gives an empty list."""
    days = F.filter(F.transform(_col(texts), parse_day), lambda d: d.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(days)), F.array().cast("array<date>"))


def first_day(texts: Column | str) -> Column:
    """Earliest day of a list of time texts, null if it has none."""
    return F.array_min(F.transform(_col(texts), parse_day))


def last_day(texts: Column | str) -> Column:
    """Latest day of a list of time texts, null if it has none."""
    return F.array_max(F.transform(_col(texts), parse_day))


def first_valid_day(texts: Column | str) -> Column:
    """First day in the order of the list."""
    return F.try_element_at(F.filter(F.transform(_col(texts), parse_day), lambda d: d.isNotNull()), F.lit(1))


def list_of_json(text: Column | str) -> Column:
    """``array<string>`` of a JSON list kept as text; bad JSON and other values give null."""
    return F.from_json(_col(text), "array<string>")


def json_of_list(values: Column | str) -> Column:
    """The list as JSON text, for files that keep lists as text; null stays null."""
    return F.to_json(_col(values))


def same_year(day: Column | str, anchor: Column | str) -> Column:
    """Whether both days lie in one year; false, not null, where a day is missing."""
    return F.coalesce(F.year(_col(day)) == F.year(_col(anchor)), F.lit(False))


def scope_year(*days: Column | str) -> Column:
    """Year of the first day present: point in time, then start, then end."""
    return F.coalesce(*(F.year(_col(d)) for d in days))


def anchor_days(years: Sequence[int], month_days: Sequence[str] = ("01-01", "04-01", "07-01", "10-01")) -> list[dt.date]:
    """Anchor dates of the years, in order."""
    return sorted(dt.date.fromisoformat(f"{y:04d}-{md}") for y in years for md in month_days)


def day_number(day: Column | str) -> Column:
    """Days since 0001-01-01."""
    return F.unix_date(_col(day)) + F.lit(DAYS_TO_EPOCH)


def day_text(number: Column | str) -> Column:
    """``YYYY-MM-DD`` of a number of days since 0001-01-01."""
    return F.date_from_unix_date((_col(number) - F.lit(DAYS_TO_EPOCH)).cast("int")).cast("string")


# The same in the portable SQL of the oracle queries.


def sql_day(text: str) -> str:
    """DuckDB expression of ``parse_day``."""
    t = f"trim({text}, ' ' || chr(9) || chr(10) || chr(13))"
    part = lambda k: f"regexp_extract({t}, '{TIME_PATTERN}', {k})"
    year = f"TRY_CAST({part(1)} AS INT)"
    two = lambda k, top: f"CASE WHEN {part(k)} BETWEEN '01' AND '{top}' THEN {part(k)} ELSE '01' END"
    return f"CASE WHEN {year} BETWEEN 1 AND 9999 THEN TRY_CAST(lpad(CAST({year} AS VARCHAR), 4, '0') || '-' || {two(2, 12)} || '-' || {two(3, 31)} AS DATE) END"


def sql_days(texts: str) -> str:
    """DuckDB expression of ``days_of``."""
    return f"COALESCE(list_sort(list_distinct(list_filter(list_transform({texts}, lambda x: {sql_day('x')}), lambda d: d IS NOT NULL))), CAST([] AS DATE[]))"
