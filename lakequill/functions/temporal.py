"""Date and time functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc(field: str, ts: Column) -> Column:
    """date_trunc that keeps a timestamp without zone."""
    return F.date_trunc(field, ts).cast("timestamp_ntz")


def part(field: str, ts: Column) -> Column:
    """EXTRACT with Sunday 0 for dow, 7 for isodow, and decade and century by year.

    second, milliseconds and microseconds are those of the minute, with their
    fractions (numeric); the other fields are whole.
    """
    year, second = F.year(ts), F.date_part(F.lit("second"), ts).cast("decimal(8,6)")
    made = {
        "dow": F.dayofweek(ts) - 1,
        "isodow": F.weekday(ts) + 1,
        "decade": F.floor(year / 10),
        "century": F.floor((year + 99) / 100),
        "second": second,
        "milliseconds": (second * 1000).cast("decimal(8,3)"),
        "microseconds": second * 1000000,
    }
    out = made[field] if field in made else F.date_part(F.lit(field), ts)
    return out if field in ("second", "milliseconds") else out.cast("bigint")


def age(end: Column, start: Column) -> Column:
    """Whole months, days and seconds from start to end, field by field.

    A negative count of days borrows the length of the month before ``end``.
    """
    seconds = (F.hour(end) - F.hour(start)) * 3600 + (F.minute(end) - F.minute(start)) * 60 + F.second(end) - F.second(start)
    short = F.when(seconds < 0, 1).otherwise(0)
    days = F.day(end) - F.day(start) - short
    under = F.when(days < 0, 1).otherwise(0)
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - under
    length = F.day(F.last_day(F.add_months(end.cast("date"), -1)))
    return F.struct(months.alias("months"), F.when(days < 0, days + length).otherwise(days).alias("days"), F.when(seconds < 0, seconds + 86400).otherwise(seconds).alias("seconds"))


def round_to(ts: Column, digits: int) -> Column:
    """TIMESTAMP(digits): to the nearest fraction of a second with so many digits, halves up; no zone."""
    unit = 10 ** (6 - digits)
    shifted = F.unix_micros(ts.cast("timestamp")) + unit // 2
    return F.timestamp_micros(shifted - F.pmod(shifted, F.lit(unit))).cast("timestamp_ntz")
