"""ISO-8601 text to UTC timestamps, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape nearly every feed sends; Spark's own cast reads it as wanted. The
# years at either end are left to the general path, which checks the range.
_COMMON = (
    r"^(?!000[01]|9999)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?"
    r"[+-](?:0\d|1[0-7]):[0-5]\d\z"
)

# Named parts of every accepted form, basic and extended, calendar and week date.
# One stray character is let through before an offset. Digits that run on after a basic
# week date belong to the time, the first of them parting both: an odd number remains.
_CALENDAR = r"(\d{4})(-?)(\d{2})\2(\d{2})"
_WEEK = r"(\d{4})(-?)W(\d{2})(?:\6([1-7]))?(?:(?!\d)|(?<!-\d)(?=\d(?:\d\d)*(?!\d)))"
_CLOCK = r"(\d{2})(?:(:?)(\d{2})(?:\10(\d{2}))?)?(?:(?:[.,]|(?<=:\d\d:\d\d):)(\d+))?"
_OFFSET = r"([+-])(\d{2})(?:(:?)(\d{2})(?:\16(\d{2}))?)?(?:[.,](\d+))?"
_STRAY = r"(?:(?<![.,]\d{1,5}).)"
_FORM = rf"(?s)^(?!0000)(?:{_CALENDAR}|{_WEEK})(?:.{_CLOCK}(?:{_STRAY}?{_OFFSET})?)?\z"
_GROUPS = {
    "year": 1, "month": 3, "day": 4,
    "week_year": 5, "week": 7, "week_day": 8,
    "hour": 9, "minute": 11, "second": 12, "fraction": 13,
    "sign": 14, "off_hour": 15, "off_minute": 17, "off_second": 18, "off_fraction": 19,
}
_DAY_MICROS = 86400 * 1000000

# 0001-01-01T00:00:00 and 9999-12-31T23:59:59.999999 in microseconds.
_MIN_MICROS = -62135596800000000
_MAX_MICROS = 253402300799999999


def _cast_micros(text: Column) -> Column:
    return F.unix_micros(text.try_cast("timestamp"))


def _general_micros(text: Column) -> Column:
    """Any accepted form.

    Lists of one element bind a value that is used several times; it is computed
    once, and only for the rows that take this path.
    """
    replacement = "|".join(f"${n}" for n in _GROUPS.values())
    parts = F.split(F.regexp_replace(text, F.lit(_FORM), F.lit(replacement)), r"\|")
    matched = F.when(text.rlike(_FORM), F.array(parts))
    micros = F.transform(matched, _micros_of_parts)
    in_range = F.filter(micros, lambda m: m.between(_MIN_MICROS, _MAX_MICROS))
    return F.get(in_range, F.lit(0))


def _micros_of_parts(parts: Column) -> Column:
    part = {name: F.get(parts, F.lit(i)) for i, name in enumerate(_GROUPS)}

    def digits(name: str) -> Column:
        # The parts are digits or nothing; a failing cast would be slow.
        return F.concat(F.lit("0"), part[name]).cast("int")

    def padded(name: str) -> Column:
        return F.when(part[name] == "", "00").otherwise(part[name])

    def micro(name: str) -> Column:
        return F.rpad(F.substring(part[name], 1, 6), 6, "0")

    fourth_january = F.concat(part["week_year"], F.lit("-01-04")).try_cast("date")
    monday = F.date_add(
        F.trunc(fourth_january, "week"), F.lit(7) * (digits("week") - F.lit(1))
    )
    week_date = F.when(
        F.weekofyear(monday) == digits("week"),
        F.date_add(monday, F.greatest(digits("week_day"), F.lit(1)) - F.lit(1)),
    )
    date = F.when(
        part["year"] != "", F.concat_ws("-", part["year"], part["month"], part["day"])
    ).otherwise(week_date.cast("string"))
    clock = F.concat(
        F.lit(" "), F.concat_ws(":", padded("hour"), padded("minute"), padded("second")),
        F.lit("."), micro("fraction"), F.lit("+00:00"),
    )
    offset = (
        digits("off_hour") * F.lit(3600)
        + digits("off_minute") * F.lit(60)
        + digits("off_second")
    ).cast("bigint") * F.lit(1000000) + micro("off_fraction").cast("bigint")
    signed = F.when(part["sign"] == "-", -offset).otherwise(offset)
    wall = _cast_micros(F.concat(date, clock))
    # A week date may run past the last four-digit year.
    return F.when((F.length(date) == 10) & (offset < _DAY_MICROS), wall - signed)


def parse_utc(text: Column) -> Column:
    """Timestamp of ISO-8601 text; text without an offset is UTC; else NULL."""
    plain = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    micros = F.when(plain.rlike(_COMMON), _cast_micros(plain)).otherwise(_general_micros(plain))
    return F.timestamp_micros(micros)
