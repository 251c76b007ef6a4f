"""Scalar functions on columns: clocks, weekdays, offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_minutes(hhmm: Column) -> Column:
    """Minutes after midnight of a clock text such as 0930; 2400 is the end of the day."""
    padded = F.lpad(hhmm, 4, "0")
    return F.substring(padded, 1, 2).cast("int") * 60 + F.substring(padded, 3, 2).cast("int")


def local_hour(hour: Column, place: Column, offsets: dict, default: int) -> Column:
    """(hour + offset of the place) mod 24, never negative."""
    shift = F.lit(default)
    for key, value in offsets.items():
        shift = F.when(place == key, value).otherwise(shift)
    return F.pmod(hour + shift, F.lit(24)).cast("long")


def weekday_numbers(ts: Column) -> dict[str, Column]:
    """The four numberings of weekdays: ISO 1 to 7 from Monday, Sunday 0, Sunday 1, Monday 0."""
    return {"iso": F.weekday(ts) + 1, "sun0": F.dayofweek(ts) - 1, "sun1": F.dayofweek(ts), "mon0": F.weekday(ts)}
