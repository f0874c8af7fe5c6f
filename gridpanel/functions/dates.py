"""Calendar helpers. Dates and month labels are strings or dates on columns; lists come as arrays.

Weeks are %Y%W weeks: Monday first, week 0 before the year's first Monday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .indices import _c


def month_start(month) -> Column:
    """First day of a yyyy-MM (or yyyyMM) label."""
    return F.to_date(F.concat(F.substring(F.regexp_replace(_c(month), "-", ""), 1, 6), F.lit("01")), "yyyyMMdd")


def month_label(day) -> Column:
    return F.date_format(_c(day), "yyyy-MM")


def last_day_of(month, delta: int = 0) -> Column:
    return F.last_day(F.add_months(month_start(month), delta))


def previous_months(month, n: int) -> Column:
    """n month labels up to and including the given one."""
    first = month_start(month)
    return F.transform(F.sequence(F.add_months(first, 1 - n), first, F.expr("interval 1 month")), month_label)


def month_range(start, end) -> Column:
    return F.transform(F.sequence(month_start(start), month_start(end), F.expr("interval 1 month")), month_label)


def days_of_month(month) -> Column:
    return F.sequence(month_start(month), F.last_day(month_start(month)))


def day_range(start, end) -> Column:
    """Every day, both ends in."""
    return F.sequence(_c(start), _c(end))


def weekly_range(start, end) -> Column:
    return F.sequence(_c(start), _c(end), F.expr("interval 7 days"))


def previous_days(day, n: int) -> Column:
    return F.sequence(F.date_sub(_c(day), n - 1), _c(day))


def next_days(day, n: int) -> Column:
    return F.sequence(_c(day), F.date_add(_c(day), n - 1))


def is_sunday(day) -> Column:
    return F.dayofweek(_c(day)) == 1


def is_month_end(day) -> Column:
    return _c(day) == F.last_day(_c(day))


def week_end(day, offset: int = 6) -> Column:
    """The day `offset` days after the Monday of the day's week: 6 for Sunday, 5 for Saturday."""
    return F.date_add(F.date_sub(_c(day), F.weekday(_c(day))), offset)


def sundays(start, end) -> Column:
    """Sundays from the end of start's week to the end of end's week."""
    return F.sequence(week_end(start), week_end(end), F.expr("interval 7 days"))


def saturdays(start, end) -> Column:
    """The same for the Saturdays of the weeks."""
    return F.sequence(week_end(start, 5), week_end(end, 5), F.expr("interval 7 days"))


def week_number(day) -> Column:
    """%W of the day."""
    d = _c(day)
    return F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")


def week_label(day) -> Column:
    return F.format_string("%d%02d", F.year(_c(day)), week_number(day))


def week_days(label) -> Column:
    """The seven days of a %Y%W label, in order."""
    first = F.make_date(F.substring(_c(label), 1, 4).cast("int"), F.lit(1), F.lit(1))
    # week 1 begins at the year's first Monday
    monday = F.date_add(first, F.pmod(F.lit(7) - F.weekday(first), F.lit(7)).cast("int"))
    start = F.date_add(monday, ((F.substring(_c(label), 5, 2).cast("int") - 1) * 7).cast("int"))
    return F.sequence(start, F.date_add(start, 6))


def previous_week(label, k: int = 1) -> Column:
    return week_label(F.date_sub(F.element_at(week_days(label), 1), 7 * k))


def last_week_of_month(month, delta: int = 0) -> Column:
    """Label of the day a week before the first day of the next month."""
    return week_label(F.date_sub(F.add_months(month_start(month), delta + 1), 7))


def month_ends(start, end) -> Column:
    return F.transform(F.sequence(F.trunc(_c(start), "MM"), F.trunc(_c(end), "MM"), F.expr("interval 1 month")), F.last_day)


def clock(seconds) -> Column:
    """Hours, minutes and seconds within the day; whole days are left out."""
    s = F.pmod(_c(seconds).cast("long"), F.lit(86400))
    return F.struct(F.floor(s / 3600).cast("int").alias("hours"), F.floor(s % 3600 / 60).cast("int").alias("minutes"), (s % 60).cast("int").alias("seconds"))


def day_of_year_to_month(doy, year: int = 2019, nodata: float = -9999) -> Column:
    """Month of a (possibly fractional) day of a fixed year; null for no data and non-finite values."""
    from .quality import finite

    whole = F.floor(finite(doy, nodata)).cast("int")
    return F.month(F.date_add(F.lit(f"{year}-01-01").cast("date"), whole - 1))


def local_month(epoch_seconds, zone: str = "Asia/Saigon") -> Column:
    """Month of an epoch in a time zone; the session's zone must be UTC."""
    return F.month(F.from_utc_timestamp(F.timestamp_seconds(_c(epoch_seconds)), zone))
