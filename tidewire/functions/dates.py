"""Dates of feeds and of the exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import strip

#: Month letters of futures; candle ranges as (interval, days back or None for the year's start).
MONTH_LETTERS = "FGHJKMNQUVXZ"
RANGES = {"day": (10, 7), "week": (60, 10), "month": (24, 35), "ytd": (24, None)}
MOSCOW = "Europe/Moscow"


def published_at(*raw: Column) -> Column:
    """Timestamp of the first non-empty of several date fields; null if it is not a date.

    Feeds write RFC 822 dates with an optional weekday, or ISO 8601.
    """
    x = F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in raw])
    rfc = F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z]{3,9},\s*", ""), r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(
        F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(x)),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss")),
    )


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def brent_contracts(ts: Column) -> Column:
    """Codes of the contracts of this month and the next two."""
    months = [F.add_months(F.trunc(ts, "month"), i) for i in range(3)]
    return F.array(*[F.concat(F.lit("BR"), F.substring(F.lit(MONTH_LETTERS), F.month(m), F.lit(1)), (F.year(m) % 10).cast("string")) for m in months])


def moscow(ts: Column) -> tuple[Column, Column]:
    """(weekday from Monday 0, minutes since midnight) in Moscow."""
    local = F.from_utc_timestamp(ts, MOSCOW)
    return F.weekday(local), F.hour(local) * 60 + F.minute(local)


def session_by_clock(ts: Column) -> Column:
    """open or closed by the trading calendar: weekdays 10:00-18:50 and 19:00-23:50 Moscow time."""
    weekday, minutes = moscow(ts)
    trades = ((minutes >= 600) & (minutes < 1130)) | ((minutes >= 1140) & (minutes < 1430))
    return F.when((weekday < 5) & trades, "open").otherwise("closed")


def candle_bounds(range_name: str, ts: Column) -> tuple[int, Column, Column]:
    """(interval, from, till) of a candles request; an unknown range is a day."""
    interval, days = RANGES.get(range_name, RANGES["day"])
    start = F.trunc(ts, "year") if days is None else F.date_sub(F.to_date(ts), days)
    return interval, iso_date(start), iso_date(ts)


def clock_label(stamp: Column) -> Column:
    """HH:MM of an exchange stamp with a mark of its time zone, or empty."""
    t = F.regexp_extract(F.coalesce(stamp, F.lit("")), r"(\d{2}:\d{2})(?::\d{2})?$", 1)
    return F.when(t != "", F.concat(t, F.lit(" мск"))).otherwise("")


#: Months of a displayed date, May in full.
MONTHS = "янв. февр. мар. апр. мая июн. июл. авг. сент. окт. нояб. дек.".split()


def display_date(ts: Column) -> Column:
    """A date and time as Russian pages show them: 9 сент. 2026 г., 15:04; empty without one."""
    month = F.get(F.array(*map(F.lit, MONTHS)), F.month(ts) - 1)
    shown = F.concat(F.dayofmonth(ts).cast("string"), F.lit(" "), month, F.lit(" "), F.year(ts).cast("string"), F.lit(" г., "), F.date_format(ts, "HH:mm"))
    return F.coalesce(shown, F.lit(""))


def compact_time(ts: Column, now: Column) -> Column:
    """The time of an item on its card: Сегодня, 15:04 on the day of now; 9 сент., 15:04 in its year, with the year before it."""
    day = F.concat(F.dayofmonth(ts).cast("string"), F.lit(" "), F.get(F.array(*map(F.lit, MONTHS)), F.month(ts) - 1))
    year = F.when(F.year(ts) == F.year(now), "").otherwise(F.concat(F.lit(" "), F.year(ts).cast("string"), F.lit(" г.")))
    shown = F.when(F.to_date(ts) == F.to_date(now), "Сегодня").otherwise(F.concat(day, year))
    return F.coalesce(F.concat(shown, F.lit(", "), F.date_format(ts, "HH:mm")), F.lit(""))


def chart_label(stamp: Column, range_name: str) -> Column:
    """Label of a chart point: time within a day, day and month otherwise."""
    s = F.coalesce(stamp, F.lit(""))
    if range_name == "day":
        return F.substring(s, 12, 5)
    months = F.array(*map(F.lit, MONTHS))
    d = F.try_to_timestamp(s)
    return F.when(d.isNull(), F.substring(s, 1, 10)).otherwise(F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), F.get(months, F.month(d) - 1)))
