"""Local days, windows, parsing and labels. Instants are UTC timestamps; a day key is a local `yyyy-MM-dd` string."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagelight.schema import ZONE

LOCAL = ZoneInfo(ZONE)


def local(value: Column) -> Column:
    return F.from_utc_timestamp(value, ZONE)


def day_key(value: Column) -> Column:
    return F.date_format(local(value), "yyyy-MM-dd")


def month_key(value: Column) -> Column:
    return F.date_format(local(value), "yyyy-MM")


def day_start(value: Column) -> Column:
    """First instant of the local day that holds an instant."""
    return F.to_utc_timestamp(F.date_trunc("day", local(value)), ZONE)


def day_bounds(key: Column) -> Column:
    """(start, end) of a day key, half open; null for what isn't a date."""
    start = F.when(key.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.to_utc_timestamp(F.try_to_timestamp(key, F.lit("yyyy-MM-dd")), ZONE))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), (start + F.expr("interval 1 day")).alias("end")))


# --- arguments, on the driver: `now` is an aware datetime --------------------------------------------------------


def utc(when: datetime) -> datetime:
    """Naive UTC, as Spark literals in a UTC session take it."""
    return when.astimezone(timezone.utc).replace(tzinfo=None) if when.tzinfo else when


def today(now: datetime) -> date:
    return utc(now).replace(tzinfo=timezone.utc).astimezone(LOCAL).date()


def bounds_of(day: date) -> tuple[datetime, datetime]:
    start = datetime(day.year, day.month, day.day, tzinfo=LOCAL)
    return utc(start), utc(start + timedelta(days=1))


def bounds_of_key(key: str) -> tuple[datetime, datetime] | None:
    try:
        return bounds_of(datetime.strptime(key, "%Y-%m-%d").date()) if len(key) == 10 else None
    except ValueError:
        return None


def shift_months(day: date, months: int) -> date:
    """So many calendar months on, the day cut to the month's length."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(year, month + 1, min(day.day, last))


def archive_bound(now: datetime, months: int = 3) -> datetime:
    return bounds_of(shift_months(today(now), -months))[0]


def month_bounds(year: int, month: int) -> tuple[datetime, datetime] | None:
    if not (2000 <= year <= 2200 and 1 <= month <= 12):
        return None
    first = date(year, month, 1)
    return bounds_of(first)[0], bounds_of(shift_months(first, 1))[0]


def weekend_keys(now: datetime) -> list[str]:
    """Friday to Sunday; on Saturday and Sunday those of the next weekend."""
    day = today(now)
    friday = day + timedelta(days=(4 - day.weekday()) % 7)
    return [(friday + timedelta(days=i)).isoformat() for i in range(3)]


def literal(when: datetime) -> Column:
    return F.lit(utc(when))


# --- labels -----------------------------------------------------------------------------------------------------


def ordinal(day: Column) -> Column:
    end = F.when(day.between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    return F.concat(day.cast("string"), end)


def heading(key: Column) -> Column:
    """`Mon, Apr 6th`."""
    day = F.to_date(key)
    return F.concat(F.date_format(day, "EEE, MMM "), ordinal(F.dayofmonth(day)))


def display_state(status: Column, starts_at: Column, ends_at: Column, now: Column) -> Column:
    return F.when(status.isin("cancelled", "postponed"), status).when(F.coalesce(ends_at, starts_at) <= now, "past").otherwise("active")


def iso_local(value: Column) -> Column:
    return F.concat(F.date_format(local(value), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


def month_label(value: Column) -> Column:
    return F.date_format(local(value), "MMMM yyyy")


def month_path(key: Column) -> Column:
    return F.concat(F.lit("/gigs/"), F.replace(key, F.lit("-"), F.lit("/")))


def version_token(*instants: Column) -> Column:
    return F.date_format(F.coalesce(*instants), "yyyyMMddHHmmss.SSS")


# --- parsing; what can't be read is null -------------------------------------------------------------------------

_ZONED = "(Z|[+][0-9]{2}:?[0-9]{2})$"


def parse_utc(value: Column) -> Column:
    """An instant; without a zone it is UTC. A negative offset is not read, as it would be taken for part of the date."""
    text = F.trim(value)
    return F.when(text.rlike(_ZONED), F.try_to_timestamp(text)).when(text.rlike("-[0-9]{2}:?[0-9]{2}$") & text.contains("T"), None).otherwise(F.try_to_timestamp(text))


def parse_local(value: Column) -> Column:
    """An instant; without a zone it is local."""
    text = F.trim(value)
    return F.when(text.rlike(f"{_ZONED}|T.*-[0-9]{{2}}:?[0-9]{{2}}$"), F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(text), ZONE))


def local_noon(day: Column) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr("interval 12 hours"), ZONE)


def parse_start(value: Column) -> Column:
    """(instant, precision): a date alone is local noon with precision `date`."""
    only_date = F.trim(value).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    at = F.when(only_date, local_noon(F.try_to_timestamp(F.trim(value), F.lit("yyyy-MM-dd")).cast("date"))).otherwise(parse_local(value))
    return F.when(at.isNotNull(), F.struct(at.alias("starts_at"), F.when(only_date, "date").otherwise("exact").alias("precision")))


def parse_day_text(value: Column) -> Column:
    """The noon of `Fri 10 Apr 2026` anywhere in a text; null for TBC and the like."""
    found = F.regexp_extract(value, "([0-9]{1,2}) ([A-Za-z]{3})[a-z]* ([0-9]{4})", 0)
    day = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(found, "^[0-9]+", 0), F.initcap(F.regexp_extract(found, " ([A-Za-z]{3})", 1)), F.regexp_extract(found, "[0-9]{4}$", 0)), F.lit("d MMM yyyy"))
    return F.when(value.rlike("(?i)\\bTB[AC]\\b"), None).otherwise(local_noon(day.cast("date")))


def parse_numeric_day(value: Column) -> Column:
    """The date of `10/04/26` or `10.04.2026`, one separator throughout."""
    text = F.trim(value)
    pattern = "^([0-9]{1,2})([/.])([0-9]{1,2})\\2([0-9]{2}|[0-9]{4})$"
    year = F.regexp_extract(text, pattern, 4)
    joined = F.concat_ws("/", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year))
    return F.when(text.rlike(pattern), F.try_to_timestamp(joined, F.lit("d/M/yyyy")).cast("date"))


def parse_clock(value: Column) -> Column:
    """(hour, minute) of the first `7.30pm`, `8pm` or `19:30` in a text."""
    pattern = "(?i)\\b([0-9]{1,2})(?:[:.]([0-9]{2}))?\\s*(am|pm)\\b|\\b([01]?[0-9]|2[0-3]):([0-5][0-9])\\b"
    part = lambda i: F.regexp_extract(value, pattern, i)
    hour12 = part(1).try_cast("int") % 12 + F.when(F.lower(part(3)) == "pm", 12).otherwise(0)
    hour = F.when(part(3) != "", hour12).otherwise(part(4).try_cast("int"))
    minute = F.when(part(3) != "", F.coalesce(part(2).try_cast("int"), F.lit(0))).otherwise(part(5).try_cast("int"))
    return F.when(hour.isNotNull() & (minute < 60), F.struct(hour.alias("hour"), minute.alias("minute")))


def at_clock(day: Column, clock: Column) -> Column:
    """The instant of a local date and clock."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.make_dt_interval(F.lit(0), clock["hour"], clock["minute"]), ZONE)


def end_after(start: Column, end: Column) -> Column:
    """An end that isn't after the start is on the next day."""
    return F.when(end <= start, end + F.expr("interval 1 day")).otherwise(end)


def parse_club_time(value: Column) -> Column:
    """The instant of `April 10, 2026 7:30 pm` or `10 April 2026 19:30`, local; null for another day or hour than there is."""
    text = F.trim(F.regexp_replace(value, "\\s+", " "))
    month_first, day_first = "^([A-Za-z]+) ([0-9]{1,2}), ?([0-9]{4})", "^([0-9]{1,2}) ([A-Za-z]+) ([0-9]{4})"
    clock = "(?i) ([0-9]{1,2})(?::([0-9]{2}))? ?(am|pm)?$"
    part = lambda i, j: F.when(text.rlike(month_first), F.regexp_extract(text, month_first, i)).otherwise(F.regexp_extract(text, day_first, j))
    day = F.try_to_timestamp(F.concat_ws(" ", part(2, 1), F.initcap(part(1, 2)), part(3, 3)), F.lit("d MMMM yyyy")).cast("date")
    hour, minute, half = F.regexp_extract(text, clock, 1).try_cast("int"), F.coalesce(F.regexp_extract(text, clock, 2).try_cast("int"), F.lit(0)), F.lower(F.regexp_extract(text, clock, 3))
    full = F.when(half != "", F.when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))).otherwise(F.when(hour < 24, hour))
    whole = text.rlike(f"(?:{month_first}|{day_first})(?i) [0-9]{{1,2}}(?::[0-9]{{2}})? ?(?:am|pm)?$")
    return F.when(whole & full.isNotNull() & (minute < 60), at_clock(day, F.struct(full.alias("hour"), minute.alias("minute"))))


def parse_meta_date(value: Column) -> Column:
    """`2026-04-10` of a text with `Friday 10th April 2026`; null without one."""
    pattern = "(?i)(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\\s+([0-9]{1,2})(?:st|nd|rd|th)?\\s+([a-z]+)\\s+([0-9]{4})"
    month = F.try_to_timestamp(F.concat_ws(" ", F.lit("1"), F.initcap(F.regexp_extract(value, pattern, 2)), F.regexp_extract(value, pattern, 3)), F.lit("d MMMM yyyy"))
    return F.when(month.isNotNull(), F.concat_ws("-", F.date_format(month, "yyyy-MM"), F.lpad(F.regexp_extract(value, pattern, 1), 2, "0")))
