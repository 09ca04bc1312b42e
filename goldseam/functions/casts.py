"""Casts of the Silver layer: lenient ones give null, strict ones fail the query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_PATTERN = r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"


def lenient_date(value: Column) -> Column:
    return value.try_cast("date")


def lenient_time(value: Column) -> Column:
    """``HH:mm`` or ``HH:mm:ss`` as ``HH:mm:ss``; other text, such as a zone suffix, gives null."""
    seconds = F.coalesce(F.nullif(F.split_part(value, F.lit(":"), F.lit(3)), F.lit("")), F.lit("00"))
    clock = F.concat_ws(
        ":",
        F.lpad(F.split_part(value, F.lit(":"), F.lit(1)), 2, "0"),
        F.split_part(value, F.lit(":"), F.lit(2)),
        seconds,
    )
    return F.when(value.rlike(TIME_PATTERN), clock)


def lenient_text(value: Column) -> Column:
    return value.cast("string")


def strict_number(value: Column, source_type: T.DataType | None = None) -> Column:
    """Scale-0 number, half rounded up; text that is no number fails the query.

    An integer column needs no detour through decimal.
    """
    if isinstance(source_type, T.IntegralType):
        return value.cast("bigint")
    return value.cast("decimal(38,0)").cast("bigint")


def strict_boolean(value: Column) -> Column:
    return value.cast("boolean")


def calendar_years(since: Column, until: Column) -> Column:
    """Difference of the year numbers (``datediff(YEAR, ..)`` counts full years)."""
    return F.year(until) - F.year(since)


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * part.cast("double") / whole.cast("double"), digits)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
