"""Dates and instants of mixed texts.

An instant is kept as epoch seconds, computed by plain arithmetic, so results do not depend on the
session time zone.  A local date is the Shanghai calendar day of an instant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import as_column, bind, constant_map, strip

SHANGHAI = 8 * 3600
UTC = 0
_ISO = ("^(\\d{4})-(\\d{1,2})-(\\d{1,2})(?:[T ](\\d{1,2})(?::(\\d{2})(?::(\\d{2})(?:[.,]\\d+)?)?)?"
        "\\s*(Z|z|[+-]\\d{2}(?::?\\d{2})?)?)?$")
_RFC = ("^(?:[A-Za-z]{3,9},?\\s+)?(\\d{1,2})\\s+([A-Za-z]{3})[a-z]*\\s+(\\d{4})\\s+"
        "(\\d{1,2}):(\\d{2})(?::(\\d{2}))?(?:\\s+([A-Za-z]{1,5}|[+-]\\d{4}))?")
_DAY = "(20\\d{2})[年/.-](\\d{1,2})[月/.-](\\d{1,2})日?"
_MONTH = "(20\\d{2})-(\\d{1,2})(?:-(\\d{1,2}))?"
_ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
          "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def _epoch(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column,
           offset: Column) -> Column:
    date = F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")
    valid = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    seconds = F.unix_date(date).cast("bigint") * 86400 + hour * 3600 + minute * 60 + second - offset
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & valid, seconds)


def _zone_offset(zone: Column, naive: int) -> Column:
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours = F.substring(digits, 1, 2).try_cast("bigint")
    minutes = _long(F.substring(digits, 3, 2), 0)
    named = constant_map({k: v * 3600 for k, v in _ZONES.items()})
    return (F.when((zone == "") | (zone == "-0000"), naive)
            .when(zone.rlike("^[+-]"), sign * (hours * 3600 + minutes * 60))
            .otherwise(F.coalesce(F.try_element_at(named, F.upper(zone)), F.lit(0))))


def _groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of a full match as one array, found by one pass of the pattern."""
    return F.split(F.regexp_replace(text, pattern, "|".join(f"${i}" for i in range(1, count + 1))), "\\|", -1)


def _long(text: Column, default: int | None = None) -> Column:
    # A failed cast costs an exception, and most groups that are no number are empty.
    number = F.nullif(text, F.lit("")).try_cast("bigint")
    return number if default is None else F.coalesce(number, F.lit(default))


def iso_epoch(value: Column | str, naive: int = SHANGHAI) -> Column:
    """Epoch seconds of an ISO date or date-time; ``naive`` is the offset of a text without one."""
    text = as_column(value)
    out = bind(_groups(text, _ISO, 7), lambda g: _epoch(
        _long(g[0]), _long(g[1]), _long(g[2]), _long(g[3], 0), _long(g[4], 0), _long(g[5], 0), _zone_offset(g[6], naive)))
    return F.when(text.rlike(_ISO), out)


def mail_epoch(value: Column | str, naive: int = SHANGHAI) -> Column:
    """Epoch seconds of a mail-style date such as ``Thu, 20 Aug 2026 02:00:00 GMT``."""
    text = as_column(value)

    def of_groups(g: Column) -> Column:
        spot = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(g[1]))
        month = F.when((spot > 0) & ((spot - 1) % 3 == 0), (spot + 2) / 3).cast("bigint")
        return _epoch(_long(g[2]), month, _long(g[0]), _long(g[3]), _long(g[4]), _long(g[5], 0), _zone_offset(g[6], naive))

    return F.when(text.rlike(_RFC), bind(_groups(F.regexp_extract(text, _RFC, 0), _RFC, 7), of_groups))


def number_epoch(value: Column | str) -> Column:
    """Epoch seconds of a 10 to 13 digit number; more than ten billion means milliseconds."""
    text = as_column(value)
    number = F.when(text.rlike("^\\d{10,13}$"), text.try_cast("bigint"))
    return F.when(number > 10_000_000_000, F.floor(number / 1000)).otherwise(number).cast("bigint")


def _day_epoch(text: Column, pattern: str, naive: int, default_day: int | None = None) -> Column:
    zero = F.lit(0)
    out = bind(_groups(F.regexp_extract(text, pattern, 0), pattern, 3), lambda g: _epoch(
        _long(g[0]), _long(g[1]), _long(g[2], default_day), zero, zero, zero, F.lit(naive)))
    return F.when(text.rlike(pattern), out)


def any_epoch(value: Column | str) -> Column:
    """Epoch seconds of a number, ISO, mail-style or Chinese date text; no zone means Shanghai."""
    return bind(strip(as_column(value).cast("string")), lambda text: F.coalesce(
        number_epoch(text), iso_epoch(text), mail_epoch(text), _day_epoch(text, _DAY, SHANGHAI)))


def stamp_epoch(value: Column | str) -> Column:
    """As :func:`any_epoch`, without the search for a date inside a longer text; positive only."""
    def read(text: Column) -> Column:
        number = number_epoch(text)
        return F.coalesce(F.when(number > 0, number), iso_epoch(text), mail_epoch(text))

    text = strip(as_column(value).cast("string"))
    # A plain day, which most are, is read without lambdas.
    day = F.unix_date(text.try_cast("date")).cast("bigint") * 86400 - SHANGHAI
    return F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}\\z"), day).otherwise(bind(text, read))


def local_date(epoch: Column, offset: int = SHANGHAI) -> Column:
    """Calendar day of an instant."""
    return F.date_from_unix_date(F.floor((epoch + offset) / 86400).cast("int"))


def any_local_date(value: Column | str) -> Column:
    """Shanghai day of a mixed date text."""
    return local_date(any_epoch(value))


def iso_utc(epoch: Column) -> Column:
    """ISO text of an instant in UTC, to the second."""
    day = F.date_from_unix_date(F.floor(epoch / 86400).cast("int"))
    rest = F.pmod(epoch, F.lit(86400)).cast("int")
    return F.concat(day.cast("string"), F.lit("T"),
                    F.format_string("%02d:%02d:%02d", F.floor(rest / 3600).cast("int"),
                                    F.floor(rest % 3600 / 60).cast("int"), (rest % 60).cast("int")),
                    F.lit("+00:00"))


def iso_text(value: Column | str, default: str | Column = "") -> Column:
    """ISO UTC text of a date; a text that only starts like one is kept, anything else is default."""
    raw = F.substring(strip(as_column(value).cast("string")), 1, 100)
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(iso_utc(stamp_epoch(value)), F.when(raw.rlike("^20\\d{2}-\\d{2}-\\d{2}"), raw),
                      fallback)


def fact_epoch(value: Column | str) -> Column:
    """Epoch seconds of a fact date: lenient, no zone means UTC, month only means its first day."""
    raw = strip(as_column(value).cast("string"))
    text = F.translate(F.replace(raw, F.lit("日"), F.lit("")), "年月/.", "----")
    return F.coalesce(iso_epoch(raw, UTC), iso_epoch(text, UTC), mail_epoch(raw, UTC),
                      _day_epoch(text, _MONTH, UTC, default_day=1))


def age_days(epoch: Column, now: Column | int) -> Column:
    """Whole days since an instant; NULL when it lies in the future."""
    current = F.lit(now) if isinstance(now, int) else now
    return F.when(current >= epoch, F.floor((current - epoch) / 86400).cast("int"))


def scoreable_epoch(event: Column, published: Column, now: Column | int) -> Column:
    """Event date, else publish date; NULL when in the future (the guard comes after the choice)."""
    current = F.lit(now) if isinstance(now, int) else now
    epoch = F.coalesce(fact_epoch(event), fact_epoch(published))
    return F.when(epoch <= current, epoch)


def event_date_and_basis(*fields: tuple[Column, str]) -> Column:
    """Struct (day, basis): the first date that can be read from ordered fields, and the basis text of that field."""
    def found(col: Column, label: str) -> Column:
        return bind(any_local_date(col), lambda day: F.when(day.isNotNull(), F.struct(day.alias("day"), F.lit(label).alias("basis"))))

    return F.coalesce(*[found(col, label) for col, label in fields], F.struct(F.lit(None).cast("date").alias("day"), F.lit("缺少可用日期").alias("basis")))


def in_window(day: Column, as_of: Column | str, days: int) -> Column:
    """Whether a day lies in the ``days`` days that end with ``as_of``, both ends included."""
    end = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return day.between(F.date_sub(end, max(1, days) - 1), end)


def day_bounds(start: str | None, end: str | None) -> tuple[int | None, int | None]:
    """First and last second (epoch) of a range of Shanghai days."""
    from datetime import datetime, timedelta, timezone
    zone = timezone(timedelta(seconds=SHANGHAI))

    def first(day: str) -> int:
        return int(datetime.fromisoformat(day).replace(tzinfo=zone).timestamp())

    return (first(start) if start else None), (first(end) + 86399 if end else None)


def to_epoch(value: str) -> int:
    """Epoch seconds of an ISO text given by the caller; no zone means UTC."""
    from datetime import datetime, timezone
    moment = datetime.fromisoformat(value)
    return int((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp())


def ntz_epoch(value: Column | str, offset: int = UTC) -> Column:
    """Epoch seconds of a time stamp without a zone, read in the given offset."""
    col = as_column(value)
    return (F.unix_date(F.to_date(col)).cast("bigint") * 86400 + F.hour(col) * 3600
            + F.minute(col) * 60 + F.second(col) - offset)
