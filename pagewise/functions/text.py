"""Text and date formatting helpers (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewise.schema import DATE_PARTS, MONTH_SUFFIX


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Oracle stores '' as NULL: nullif(c, '')."""
    return F.nullif(_c(c), F.lit(""))


def nvl_text(c: Column | str, default: str = " ") -> Column:
    """NVL(c, ' ') with Oracle's empty-string-is-NULL rule."""
    return F.coalesce(blank_to_null(c), F.lit(default))


def date_text(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """TO_CHAR(d, 'YYYY-MM-DD') and friends."""
    return F.date_format(_c(c), fmt)


def month_label(yyyymm: Column | str) -> Column:
    """SUBSTR(dt, 5, 2) || '월' — the month number without the year."""
    return F.concat(F.substring(_c(yyyymm), 5, 2), F.lit(MONTH_SUFFIX))


def korean_date(yyyymmdd: Column | str) -> Column:
    """'YYYY년 MM월 DD일' cut from a YYYYMMDD string (works on the default '00000000')."""
    s = _c(yyyymmdd)
    year, month, day = map(F.lit, DATE_PARTS)
    return F.concat(F.substring(s, 1, 4), year, F.substring(s, 5, 2), month, F.substring(s, 7, 2), day)


def thousands(c: Column | str) -> Column:
    """Integer with ',' thousands separators (the dashboard's number format)."""
    return F.format_number(_c(c), 0)


def authors_text(c: Column | str) -> Column:
    """Authors are stored '^'-separated; shown ', '-separated."""
    return F.replace(_c(c), F.lit("^"), F.lit(", "))


def authors_array(c: Column | str) -> Column:
    return F.split(_c(c), r"\^")


def js_text(c: Column | str) -> Column:
    """String concatenation as a browser does it: NULL prints as 'null'."""
    return F.coalesce(_c(c).cast("string"), F.lit("null"))
