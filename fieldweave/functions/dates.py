"""Column builders for dates and times. The zone and the current day are always given."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.functions.values import first_given

DAY = "yyyy-MM-dd"


def day_of_timestamp(column: Column, zone: str = "UTC") -> Column:
    """yyyy-MM-dd of a moment in the zone; the session's zone is UTC."""
    moment = column.cast("timestamp")
    return F.date_format(moment if zone == "UTC" else F.from_utc_timestamp(moment, zone), DAY)


def day_of(column: Column, zone: str = "UTC") -> Column:
    """yyyy-MM-dd of a date that came as text: eleven digits or more are milliseconds since 1970, of
    other texts the first ten characters are taken; missing and 0 give an empty text."""
    number = column.try_cast("bigint")
    return (
        F.when(first_given(column).isNull() | (number == 0), "")
        .when(column.rlike(r"^\d{11,}$"), day_of_timestamp(F.timestamp_millis(number), zone))
        .otherwise(F.substring(column, 1, 10))
    )


def due_label(due: Column, today: dt.date) -> Column:
    """How a due date stands to a day: TBD, Today, Tomorrow, Yesterday, N days overdue, In N days (14 at most), or the date."""
    days = F.date_diff(due, F.lit(today))
    return (
        F.when(due.isNull(), "TBD")
        .when(days == 0, "Today")
        .when(days == 1, "Tomorrow")
        .when(days == -1, "Yesterday")
        .when(days < 0, F.concat((-days).cast("string"), F.lit(" days overdue")))
        .when(days <= 14, F.concat(F.lit("In "), days.cast("string"), F.lit(" days")))
        .otherwise(F.date_format(due, "MMM d, yyyy"))
    )


def clock(column: Column) -> Column:
    """HH:mm:00 of the first one or two digits in a text, with minutes and am or pm (lower or upper case) if they follow at once; else null."""
    # What was found is one text that all that follows is cut from: two digits or one, two behind a colon, two letters.
    found = F.regexp_extract(column, r"[0-9]{1,2}(?::[0-9]{2})?(?:[ \t]*(?:am|pm|AM|PM))?", 0)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hour = F.coalesce(F.substring(found, 1, 2).try_cast("int"), F.substring(found, 1, 1).try_cast("int"))
    minute = F.when(F.instr(found, ":") > 0, F.substring(found, F.instr(found, ":") + 1, F.lit(2)).try_cast("int")).otherwise(F.lit(0))
    half = F.lower(F.substring(found, -2, 2))
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    return F.when(found != "", F.concat(two(hour), F.lit(":"), two(minute), F.lit(":00")))


def moment(date: Column, time: Column, zone: str, default: str = "12:00:00") -> Column:
    """The UTC moment of a day and a clock text in a zone; null if there is no such time."""
    local = F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), F.coalesce(clock(time), F.lit(default))), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.to_utc_timestamp(local, zone)


def iso_utc(column: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ, without fractions of seconds."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")
