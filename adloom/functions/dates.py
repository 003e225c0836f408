"""Day strings (`yyyyMMdd`)."""

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom import constants as C

SECONDS_PER_DAY = 86_400


def shift_day(day: str, days: int) -> str:
    """A day string moved by a number of days, for choosing partitions."""
    return (datetime.strptime(day, "%Y%m%d") + timedelta(days=days)).strftime("%Y%m%d")


def days_from(day: str, count: int = C.DAYS_READ) -> list[str]:
    """The day and the ones after it, `count` in all."""
    return [shift_day(day, offset) for offset in range(count)]


def add_days(day: Column, days: int | Column) -> Column:
    return F.date_format(F.date_add(F.to_date(day, C.DAY_FORMAT), days), C.DAY_FORMAT)


def day_span(day: Column, count: int) -> Column:
    """Array of `count` day strings from `day` on."""
    start = F.to_date(day, C.DAY_FORMAT)
    days = F.sequence(start, F.date_add(start, count - 1))
    return F.transform(days, lambda d: F.date_format(d, C.DAY_FORMAT))


def day_prefix(datetime_text: Column) -> Column:
    return F.substring(datetime_text, 1, C.DAY_LENGTH)


def date_text(date: Column) -> Column:
    return F.date_format(date, C.DAY_FORMAT)


def epoch_to_date(seconds: Column) -> Column:
    """Date of epoch seconds in the log's zone (eight hours ahead of UTC), whatever the
    session's zone is."""
    days = F.floor((seconds + C.LOG_ZONE_SECONDS) / SECONDS_PER_DAY).cast("int")
    return F.date_from_unix_date(days)


def epoch_to_day(seconds: Column) -> Column:
    """The same as a day string."""
    return date_text(epoch_to_date(seconds))
