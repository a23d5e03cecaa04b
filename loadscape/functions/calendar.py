"""Calendar attributes of dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar(date: Column) -> dict[str, Column]:
    """day_of_month, month, year, day_of_week (Monday 0), is_weekend, day_of_year, iso_week."""
    return {
        "day_of_month": F.dayofmonth(date), "month": F.month(date), "year": F.year(date), "day_of_week": F.weekday(date),
        "is_weekend": F.weekday(date) >= 5, "day_of_year": F.dayofyear(date), "iso_week": F.weekofyear(date),
    }


def monday_week(date: Column) -> Column:
    """Week of the year counted from the first Monday, 0 before it."""
    return F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / 7).cast("int")


def meteorological_season(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.between(3, 5), "spring").when(m.between(6, 8), "summer").when(m.between(9, 11), "autumn").otherwise("winter")


def astronomical_season(date: Column) -> Column:
    """By the fixed dates 21 March, 21 June, 23 September and 21 December."""
    d = F.month(date) * 100 + F.dayofmonth(date)
    return F.when(d.between(321, 620), "spring").when(d.between(621, 922), "summer").when(d.between(923, 1220), "autumn").otherwise("winter")


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar (the anonymous computus)."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * k, 451)
    n = h + k - 7 * m + 114
    return F.make_date(year.cast("int"), div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def belgian_holiday(date: Column) -> Column:
    """The ten public holidays: six fixed ones, and Easter Sunday and Monday, Ascension, Whit Sunday and Monday."""
    fixed = (F.month(date) * 100 + F.dayofmonth(date)).isin(101, 501, 721, 815, 1101, 1111, 1225)
    return fixed | F.datediff(date, easter(F.year(date))).isin(0, 1, 39, 49, 50)


def day_type(date: Column, holidays: bool = True) -> Column:
    kind = F.when(F.weekday(date) >= 5, "weekend").otherwise("weekday")
    return F.when(belgian_holiday(date), "holiday").otherwise(kind) if holidays else kind


def slot_of(ts: Column, minutes: int = 15) -> Column:
    """Number of the day's slot of so many minutes."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")
