"""Date, expiry and receipt-time formats (Column -> Column)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

ONE_DAY = timedelta(days=1)

# Fixed value: receipt times are shown at this offset.
LOCAL_OFFSET = "+08:00"

_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
# Year, month, day; hours, minutes, seconds and fraction; offset. Separators are groups too, so one match tells every format apart.
_MOMENT = (
    "^([0-9]{4})(-?)([0-9]{1,2})(-?)([0-9]{1,2})"
    "(?:[T ]([0-9]{2})(:?)([0-9]{2})(?:(:?)([0-9]{2})(?:[.,]([0-9]{1,9}))?)?)?"
    "(Z|[+-][0-9]{2}:?[0-9]{2})?$"
)
_PARTS = ["year", "sep1", "month", "sep2", "day", "hour", "sep3", "minute", "sep4", "second", "fraction", "offset"]
# Stands between the parts of a matched text; a text that holds it is no time.
_MARK = "\u0001"


def time_literal(value: datetime, data_type: DataType = TimestampNTZType()) -> Column:
    """``value`` as a literal. A wall clock goes in as text: a datetime would pass through two time zones."""
    if isinstance(data_type, TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(data_type)
    return F.lit(value)


def _date_of(text: Column) -> Column:
    """``yyyy-M-d`` (padded or not) as a date, NULL when it is no valid one."""
    return F.when(text.rlike(_DATE), text.try_cast("date"))


def normalise_date(text: Column) -> Column:
    """``yyyy-M-d`` -> ``yyyy-MM-ddT00:00:00Z``; any other text is returned as it is."""
    return F.coalesce(F.concat(_date_of(text).cast("string"), F.lit("T00:00:00Z")), text)


def wall_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.ffffff]``. A formatter would move hours that the session time zone skips."""
    return ts.cast("timestamp_ntz").cast("string")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def iso_text(ts: Column) -> Column:
    """Naive ISO text; the fraction is written, with six digits, only when it is not zero."""
    text = F.translate(wall_text(ts), " ", "T")
    return bound(text, lambda t: F.when(F.length(t) > 19, F.rpad(t, 26, "0")).otherwise(t))


def _moment(text: Column, body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of the parts of a date or date-time text, which is matched once; NULL for any other text."""
    marked = F.regexp_replace(text, _MOMENT, _MARK + _MARK.join(f"${i}" for i in range(1, len(_PARTS) + 1)))

    def read(parts: Column) -> Column:
        named = {name: F.get(parts, F.lit(i + 1)) for i, name in enumerate(_PARTS)}
        return F.when(F.size(parts) == len(_PARTS) + 1, body(named))

    return F.when(~F.contains(text, F.lit(_MARK)), bound(F.split(marked, _MARK, -1), read))


def _instant(part: dict[str, Column]) -> Column:
    """The wall clock of a padded date, of a date-time or of its basic form; with an offset it is the UTC one."""
    dated = (F.length(part["month"]) == 2) & (F.length(part["day"]) == 2)
    timed, full = part["hour"] != "", part["second"] != ""
    extended = (part["sep1"] == "-") & (part["sep2"] == "-") & (~timed | ((part["sep3"] == ":") & (~full | (part["sep4"] == ":"))))
    # An offset needs a time.
    extended = extended & (timed | (part["offset"] == ""))
    basic = (part["sep1"] == "") & (part["sep2"] == "") & (part["offset"] == "")
    basic = basic & (~timed | ((part["sep3"] == "") & (part["sep4"] == "") & full & (part["fraction"] == "")))
    clock = F.concat(
        part["year"], F.lit("-"), part["month"], F.lit("-"), part["day"], F.lit("T"), F.when(timed, part["hour"]).otherwise("00"), F.lit(":"),
        F.when(timed, part["minute"]).otherwise("00"), F.lit(":"), F.when(full, part["second"]).otherwise("00"),
        F.when(part["fraction"] != "", F.concat(F.lit("."), part["fraction"])).otherwise(""),
    )
    ts = clock.try_cast("timestamp_ntz")
    digits = F.translate(part["offset"], "Z:", "")
    minutes = (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")) * F.when(digits.startswith("-"), -1).otherwise(1)
    utc = F.when(digits == "", ts).otherwise(ts - F.make_dt_interval(mins=minutes))
    return F.when(dated & (extended | basic), utc)


def naive_timestamp(text: Column) -> Column:
    """ISO date or date-time text as ``timestamp_ntz``, NULL when it is none. With ``Z`` or an offset it is the UTC wall clock."""
    return _moment(text, _instant)


def _end_of_day(part: dict[str, Column]) -> Column:
    alone = (part["sep1"] == "-") & (part["sep2"] == "-") & (part["hour"] == "") & (part["offset"] == "")
    day = F.concat(part["year"], F.lit("-"), part["month"], F.lit("-"), part["day"]).try_cast("date")
    return F.when(alone, F.concat(day.cast("string"), F.lit("T23:59:59")))


def normalise_expiry(text: Column, now: Column, ttl: timedelta = ONE_DAY) -> Column:
    """Expiry text as naive ISO text.

    Blank means ``now + ttl``; an ISO date or date-time stands for itself, one with an offset for its UTC wall clock; an
    unpadded date means the end of that day; anything else gives NULL and belongs in quarantine.
    """
    read = _moment(text, lambda part: F.coalesce(iso_text(_instant(part)), _end_of_day(part)))
    return F.when(text.isNull() | (text == ""), iso_text(now + F.lit(ttl))).otherwise(read)


def received_at_local(received_at: Column, naive_utc: bool = True) -> Column:
    """Receipt time at the fixed offset, 12-hour clock. ``naive_utc``: the column is a UTC wall clock."""
    zone = F.lit("UTC") if naive_utc else None
    local = F.convert_timezone(zone, F.lit(LOCAL_OFFSET), received_at)
    text, hour = wall_text(local), F.hour(local)
    clock_hour = F.lpad(((hour + 11) % 12 + 1).cast("string"), 2, "0")
    half = F.when(hour < 12, " AM").otherwise(" PM")
    return F.concat(F.substring(text, 1, 11), clock_hour, F.substring(text, 14, 6), half)


def elapsed_after(ts: Column, ttl: timedelta, kind: DataType) -> Column:
    """``ttl`` of elapsed time after ``ts``: a day is 24 hours, whatever the session time zone's clock does."""
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(F.unix_micros(ts) + F.lit(ttl // timedelta(microseconds=1)))
    return ts + F.lit(ttl)


def instant_micros(ts: Column, kind: DataType) -> Column:
    """Microseconds since 1970-01-01 of an instant, or of a wall clock."""
    return F.unix_micros(ts) if isinstance(kind, TimestampType) else epoch_micros(ts)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a wall clock, without going through any time zone."""
    seconds = (
        F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    )
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
