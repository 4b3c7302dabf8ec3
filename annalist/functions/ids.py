"""Entity and property ids: one key per letter and number, however it is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that may stand around an id: blanks, and a prefix that ends in a colon or a slash.
_AROUND = r"^[\s\p{Z}\x{FEFF}]*(?:[^\s]*[:/])?"


def _number(col: Column, letter: str) -> Column:
    second = F.substring(col, 2, 1)
    plain = (F.substring(col, 1, 1) == letter) & (second >= "0") & (second <= "9")
    quick = F.when(plain, F.substring(col, 2, 40).try_cast("bigint"))
    pattern = f"{_AROUND}[{letter}{letter.lower()}]0*([0-9]{{1,18}})[\\s\\p{{Z}}\\x{{FEFF}}]*$"
    return F.coalesce(quick, F.regexp_extract(col, pattern, 1).try_cast("bigint"))


def item_number(col: Column | str) -> Column:
    """Number of an item id (``Q42``, `` q042 ``, ``wd:Q42``, ``item/Q42`` all give 42) as BIGINT.

    Null, empty text, words, a bare letter and ids of another letter are no item id and give null, as do numbers
    beyond 18 digits.
    """
    return _number(F.col(col) if isinstance(col, str) else col, "Q")


def property_number(col: Column | str) -> Column:
    """Number of a property id (``P39``, ``wdt:P39``, ``p039``) as BIGINT; null where it is none."""
    return _number(F.col(col) if isinstance(col, str) else col, "P")


def item_id(number: Column | str) -> Column:
    return F.concat(F.lit("Q"), (F.col(number) if isinstance(number, str) else number).cast("string"))


def property_id(number: Column | str) -> Column:
    return F.concat(F.lit("P"), (F.col(number) if isinstance(number, str) else number).cast("string"))


#: Blanks that may stand around a rank.
BLANKS = " \t\n\r\u00a0\u3000\ufeff"


def rank_name(col: Column | str, default: str | None = "normal") -> Column:
    """Lower-case rank without blanks around it; null and empty become ``default``."""
    col = F.col(col) if isinstance(col, str) else col
    plain = F.lower(F.trim(col, F.lit(BLANKS)))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(default))


# The same in the portable SQL of the oracle queries.


def sql_item(col: str) -> str:
    return f"TRY_CAST(regexp_extract({col}, '^\\s*(?:[^\\s]*[:/])?[Qq]0*([0-9]{{1,18}})\\s*$', 1) AS BIGINT)"


def sql_property(col: str) -> str:
    return f"TRY_CAST(regexp_extract({col}, '^\\s*(?:[^\\s]*[:/])?[Pp]0*([0-9]{{1,18}})\\s*$', 1) AS BIGINT)"


def sql_rank(col: str) -> str:
    return f"COALESCE(NULLIF(lower(trim({col}, ' ' || chr(9) || chr(10) || chr(13))), ''), 'normal')"
