"""Date columns: coercing parsers, calendar fields and cyclic encodings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.functions.text import SPACE, strip

FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss")


def standardize_date(c: Column) -> Column:
    """Date part before the first white space; eight characters without a dash are cut as YYYY-MM-DD, unchecked."""
    head = F.element_at(F.split(strip(c.cast("string")), SPACE), 1)
    cut = F.concat_ws("-", F.substring(head, 1, 4), F.substring(head, 5, 2), F.substring(head, 7, 2))
    return F.when(~F.contains(head, F.lit("-")) & (F.length(head) == 8), cut).otherwise(head)


def parse_date(c: Column, formats: Sequence[str] = FORMATS) -> Column:
    """First format that parses wins, then any ISO date-time; anything else is NULL. Numbers such as 20210105 are accepted.

    Dots between the parts of a date count as dashes. A bare year or month is not a date.
    """
    text = F.regexp_replace(strip(c.cast("string")), r"^(\d{4})\.(\d{1,2})\.(\d{1,2})", "$1-$2-$3")
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"), F.coalesce(text.try_cast("timestamp").cast("date"), text.try_cast("date")))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats], iso)


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def month_key(c: Column) -> Column:
    return F.trunc(c, "MM")


def year_slice(df: DataFrame, d: str, year: int) -> DataFrame:
    """Rows of one year as a range predicate, so that files and row groups can be skipped."""
    return df.where((F.col(d) >= F.lit(date(year, 1, 1))) & (F.col(d) < F.lit(date(year + 1, 1, 1))))


def calendar_columns(d: Column, season: Sequence[int] = (9, 10, 11)) -> dict[str, Column]:
    """Calendar fields, flags and cyclic encodings of a date."""
    month, quarter = F.month(d), F.quarter(d)
    turn = 2.0 * math.pi
    return {
        "year": F.year(d),
        "month": month,
        "quarter": quarter,
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "is_quarter_end": month.isin(3, 6, 9, 12).cast("int"),
        "is_year_end": (month == 12).cast("int"),
        "is_season": month.isin(*season).cast("int"),
        "month_sin": F.sin(turn * month / 12),
        "month_cos": F.cos(turn * month / 12),
        "quarter_sin": F.sin(turn * quarter / 4),
        "quarter_cos": F.cos(turn * quarter / 4),
    }


def calendar_features(df: DataFrame, d: str, season: Sequence[int] = (9, 10, 11)) -> DataFrame:
    return df.withColumns(calendar_columns(F.col(d), season))
