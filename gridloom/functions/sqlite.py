"""SQLite's SQL functions that Spark lacks or spells differently, for columns and for SQL text.

COUNT, SUM, AVG, MIN, MAX, ABS, ROUND, COALESCE, IFNULL, NULLIF, LENGTH, LOWER, UPPER, TRIM, LTRIM,
RTRIM, SUBSTR, REPLACE, INSTR, PRINTF, TYPEOF, CAST, RANDOM and the ranking functions are Spark's own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession, functions as F

# Strftime codes with the date pattern that gives the same text.
DATE_CODES = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "ss.SSS", "%j": "DDD",
}

# Fixed value: milliseconds from the start of the Julian days to 1970-01-01 00:00 UTC.
UNIX_EPOCH_JULIAN_MILLIS = 210866760000000


def total(value: Column) -> Column:
    """Sum as a double; 0.0 over no rows, where SUM gives NULL."""
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))


def group_concat(value: str, separator: str = ",", order_by: str | None = None) -> Column:
    """Values of a group as one string, NULL left out; ``value`` and ``order_by`` are SQL expressions.

    The string has no order of its own in Spark, so one is always given: by value unless named.
    """
    mark = separator.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"listagg(CAST({value} AS STRING), '{mark}') WITHIN GROUP (ORDER BY {order_by or value})")


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def datetime_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _clock_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 by the clock the value shows, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")) * F.lit(86400).cast("bigint") + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint")


def julian_day(ts: Column) -> Column:
    """Days since noon of 24 November 4714 BC, to the millisecond as SQLite has it."""
    micros = _clock_micros(ts) + 500
    millis = (micros - F.pmod(micros, F.lit(1000))) / 1000
    return (millis + UNIX_EPOCH_JULIAN_MILLIS) / 86400000


def strftime(pattern: str, ts: Column) -> Column:
    """A date by SQLite's codes; text between them is kept as it is."""
    pieces = []
    for piece in re.findall(r"%.|[^%]+|%", pattern):
        if piece in DATE_CODES:
            pieces.append(F.date_format(ts, DATE_CODES[piece]))
        elif piece == "%s":
            pieces.append(F.floor(_clock_micros(ts) / 1000000).cast("string"))
        elif piece == "%w":
            pieces.append((F.dayofweek(ts) - 1).cast("string"))
        elif piece == "%J":
            pieces.append(julian_day(ts).cast("string"))
        elif piece == "%%":
            pieces.append(F.lit("%"))
        elif piece.startswith("%"):
            raise ValueError(f"Unknown date code '{piece}'.")
        else:
            pieces.append(F.lit(piece))
    return F.concat(*pieces) if pieces else F.lit("")


def glob_regex(pattern: str) -> str:
    """A GLOB pattern (``*``, ``?``, ``[...]``, ``[^...]``) as an anchored regular expression."""
    parts, rest = [], pattern
    while rest:
        found = re.match(r"\[\^?\]?[^\]]*\]", rest)
        if found:
            inner = found.group()[1:-1]
            negated, members = inner.startswith("^"), inner.removeprefix("^")
            safe = re.sub(r"([\\\[\]&^])", r"\\\1", members)
            parts.append(f"[{'^' if negated else ''}{safe}]")
            rest = rest[found.end():]
            continue
        parts.append({"*": ".*", "?": "."}.get(rest[0]) or re.escape(rest[0]))
        rest = rest[1:]
    return "(?s)^" + "".join(parts) + r"\z"


def glob(value: Column, pattern: str) -> Column:
    """``value GLOB pattern``: whole text, upper and lower case told apart."""
    return value.rlike(glob_regex(pattern))


def like(value: Column, pattern: str) -> Column:
    """``value LIKE pattern`` as SQLite has it: ASCII case is ignored."""
    return value.ilike(pattern)


# -- dates with modifiers, as SQL text ---------------------------------------------------------------

# Seconds of the units that a modifier may count, and days that a part of a month or year has.
_UNIT_SECONDS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}
_UNIT_MONTHS = {"month": (1, 30), "year": (12, 365)}

_COUNTED = re.compile(r"([+-]?\d+(?:\.\d*)?|[+-]?\.\d+) *(day|hour|minute|second|month|year)s?", re.I)
_CLOCK_SHIFT = re.compile(r"([+-])(\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?")
_DATE_SHIFT = re.compile(r"([+-])(\d{4})-(\d{2})-(\d{2})(?: (\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?)?")
_NO_MOMENT = "CAST(NULL AS TIMESTAMP_NTZ)"


def moment_sql(value: str, modifiers: Sequence[tuple[str, str | None]] = ()) -> str:
    """SQL text of the moment (TIMESTAMP_NTZ) that a time value and its modifiers name; NULL where they name none.

    ``value`` is SQL text of a timestamp, a date, or a text or number by SQLite's rules. A modifier is its SQL
    text and, if that is one string, its characters. Modifiers apply from left to right; those that are
    written out become plain date arithmetic, others (``'-' || n || ' days'``) are read for each row.
    """
    text, rest = f"CAST({value} AS STRING)", list(modifiers)
    first = rest[0][1].strip().lower() if rest and rest[0][1] is not None else ""
    if first in ("unixepoch", "auto", "julianday"):
        rest = rest[1:]
    found = f"sqlite_moment({text}, '{first if first in ('unixepoch', 'auto') else ''}')"
    for sql, written in rest:
        found = f"sqlite_shift({found}, CAST({sql} AS STRING))" if written is None else _shifted(found, written.strip().lower())
    return found


def _shifted(moment: str, modifier: str) -> str:
    counted, clock, date = _COUNTED.fullmatch(modifier), _CLOCK_SHIFT.fullmatch(modifier), _DATE_SHIFT.fullmatch(modifier)
    if counted:
        number, unit = float(counted[1]), counted[2].lower()
        if unit in _UNIT_SECONDS:
            return _later(moment, number * _UNIT_SECONDS[unit])
        months, days = _UNIT_MONTHS[unit]
        return _later(f"sqlite_months({moment}, {int(number) * months})", (number - int(number)) * days * 86400)
    if clock:
        seconds = int(clock[2]) * 3600 + int(clock[3]) * 60 + float(clock[4] or 0)
        return _later(moment, -seconds if clock[1] == "-" else seconds)
    if date:
        sign = -1 if date[1] == "-" else 1
        seconds = int(date[4]) * 86400 + int(date[5] or 0) * 3600 + int(date[6] or 0) * 60 + float(date[7] or 0)
        return _later(f"sqlite_months({moment}, {sign * (int(date[2]) * 12 + int(date[3]))})", sign * seconds)
    if modifier in ("start of day", "start of month", "start of year"):
        day = f"CAST({moment} AS DATE)"
        unit = {"start of month": "MM", "start of year": "YYYY"}.get(modifier)
        return f"CAST({f"trunc({day}, '{unit}')" if unit else day} AS TIMESTAMP_NTZ)"
    if re.fullmatch(r"weekday +[0-6]", modifier):
        return f"sqlite_weekday({moment}, {modifier[-1]})"
    if modifier == "localtime":
        return f"convert_timezone('UTC', current_timezone(), {moment})"
    if modifier == "utc":
        return f"convert_timezone(current_timezone(), 'UTC', {moment})"
    return moment if modifier in ("subsec", "subsecond") else _NO_MOMENT


def _later(moment: str, seconds: float) -> str:
    return f"({moment} + make_dt_interval(0, 0, 0, {seconds:.6f}BD))" if seconds else moment


NUMBERS = ("BIGINT", "DOUBLE")


def number_sql(value: str, kind: str) -> str:
    """CAST to a number as SQLite has it: a text counts as far as it is a number, and as 0 if it starts with none."""
    return f"sqlite_{kind.lower()}(CAST({value} AS STRING))"


_CLOCK = (
    "((unix_date(date(ts)) * 86400L + hour(ts) * 3600 + minute(ts) * 60) * 1000000"
    " + bigint(extract(SECOND FROM ts) * 1000000))"
)
_JULIAN = f"(({_CLOCK} + 500 - pmod({_CLOCK} + 500, 1000)) / 1000 + {UNIX_EPOCH_JULIAN_MILLIS}) / 86400000"
_SQL_FUNCTIONS = (
    f"julianday(ts TIMESTAMP_NTZ) RETURNS DOUBLE RETURN {_JULIAN}",
    "datetime(ts TIMESTAMP_NTZ) RETURNS STRING RETURN date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "timetext(ts TIMESTAMP_NTZ) RETURNS STRING RETURN date_format(ts, 'HH:mm:ss')",
    "strftime(pattern STRING, ts TIMESTAMP_NTZ) RETURNS STRING RETURN IF(ts IS NULL, NULL, array_join(transform("
    "regexp_extract_all(pattern, '(%.|[^%]+|%)', 1), piece -> CASE piece"
    + "".join(f" WHEN '{code}' THEN date_format(ts, '{fmt}')" for code, fmt in DATE_CODES.items())
    + " WHEN '%s' THEN string(floor(" + _CLOCK + " / 1000000)) WHEN '%w' THEN string(dayofweek(ts) - 1)"
    " WHEN '%J' THEN string(" + _JULIAN + ") WHEN '%%' THEN '%'"
    " ELSE IF(startswith(piece, '%'), raise_error(concat('Unknown date code \\'', piece, '\\'.')), piece) END), ''))",
)

# How SQLite writes a day and a time of day.
_DAY = "[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_TIME_OF_DAY = "([01][0-9]|2[0-4]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?"
_ZONE = " *(Z|z|[+-][0-9]{2}:[0-9]{2})"


def _seconds(start: int) -> str:
    """Seconds of the time of day that starts at a place of ``t``."""
    return (f"(int(substr(t, {start}, 2)) * 3600 + int(substr(t, {start + 3}, 2)) * 60"
            f" + coalesce(try_cast(regexp_extract(substr(t, {start + 6}), '^([0-9]{{2}}([.][0-9]+)?)', 1) AS DECIMAL(8,6)), 0BD))")


def _epoch_moment(seconds: str) -> str:
    return f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({seconds} AS DECIMAL(18,6)))"


# a day is counted from the first of its month, so that a 31st of a short month is in the next one
_DAY_OF_TEXT = "CAST(date_add(make_date(int(substr(t, 1, 4)), int(substr(t, 6, 2)), 1), int(substr(t, 9, 2)) - 1) AS TIMESTAMP_NTZ)"
_NUMBER = "^ *[+-]?[0-9]+([.][0-9]*)?([eE][+-]?[0-9]+)? *$"
_JULIAN_SECONDS = "round((double(t) - 2440587.5) * 86400, 3)"
_MODIFIER = "^ *([+-]?[0-9.]+) *{unit}s? *$"


def _counted(unit: str) -> str:
    return f"try_cast(regexp_extract(lower(m), '{_MODIFIER.format(unit=unit)}', 1) AS DOUBLE)"


_SQL_FUNCTIONS += (
    # a text or number by SQLite's rules; how: unixepoch, auto or nothing
    "sqlite_moment(t STRING, how STRING) RETURNS TIMESTAMP_NTZ RETURN CASE"
    f" WHEN t RLIKE '{_NUMBER}' THEN CASE"
    f" WHEN how = 'unixepoch' OR how = 'auto' AND NOT double(t) BETWEEN 0 AND 5373484.5 THEN {_epoch_moment('double(t)')}"
    f" WHEN double(t) BETWEEN 0 AND 5373484.5 THEN {_epoch_moment(_JULIAN_SECONDS)} END"
    " WHEN how = 'unixepoch' THEN NULL"
    f" WHEN t RLIKE '^{_DAY}$' THEN {_DAY_OF_TEXT}"
    f" WHEN t RLIKE '^{_DAY}( +|T){_TIME_OF_DAY}$' THEN {_DAY_OF_TEXT} + make_dt_interval(0, 0, 0, {_seconds(12)})"
    f" WHEN t RLIKE '^{_DAY}( +|T){_TIME_OF_DAY}{_ZONE}$' THEN {_DAY_OF_TEXT}"
    f" + make_dt_interval(0, 0, 0, {_seconds(12)} - sqlite_zone(t))"
    f" WHEN t RLIKE '^{_TIME_OF_DAY}$' THEN TIMESTAMP_NTZ'2000-01-01 00:00:00' + make_dt_interval(0, 0, 0, {_seconds(1)})"
    " WHEN lower(t) = 'now' THEN convert_timezone(current_timezone(), 'UTC', localtimestamp()) END",
    # months later; a day that the month lacks is in the one after it
    "sqlite_months(ts TIMESTAMP_NTZ, n INT) RETURNS TIMESTAMP_NTZ RETURN"
    " CAST(date_add(add_months(trunc(CAST(ts AS DATE), 'MM'), n), day(ts) - 1) AS TIMESTAMP_NTZ)"
    " + (ts - CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ))",
    "sqlite_weekday(ts TIMESTAMP_NTZ, n INT) RETURNS TIMESTAMP_NTZ RETURN"
    " ts + make_dt_interval(pmod(n + 1 - dayofweek(ts), 7), 0, 0, 0BD)",
    # a modifier that is known for each row only
    "sqlite_shift(ts TIMESTAMP_NTZ, m STRING) RETURNS TIMESTAMP_NTZ RETURN CASE"
    + "".join(f" WHEN {_counted(unit)} IS NOT NULL THEN ts + make_dt_interval(0, 0, 0, CAST({_counted(unit)} * {seconds} AS DECIMAL(18,6)))"
              for unit, seconds in _UNIT_SECONDS.items())
    + "".join(f" WHEN {_counted(unit)} IS NOT NULL THEN sqlite_months(ts, int({_counted(unit)}) * {months})"
              f" + make_dt_interval(0, 0, 0, CAST(({_counted(unit)} - int({_counted(unit)})) * {days * 86400} AS DECIMAL(18,6)))"
              for unit, (months, days) in _UNIT_MONTHS.items())
    + " WHEN lower(m) = 'start of day' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ)"
    " WHEN lower(m) = 'start of month' THEN CAST(trunc(CAST(ts AS DATE), 'MM') AS TIMESTAMP_NTZ)"
    " WHEN lower(m) = 'start of year' THEN CAST(trunc(CAST(ts AS DATE), 'YYYY') AS TIMESTAMP_NTZ)"
    " WHEN lower(m) RLIKE '^weekday +[0-6]$' THEN sqlite_weekday(ts, try_cast(right(m, 1) AS INT)) END",
    "sqlite_bigint(t STRING) RETURNS BIGINT RETURN CASE WHEN t IS NOT NULL THEN"
    " coalesce(try_cast(regexp_extract(t, '^\\\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) END",
    "sqlite_double(t STRING) RETURNS DOUBLE RETURN CASE WHEN t IS NOT NULL THEN"
    " coalesce(try_cast(regexp_extract(t, '^\\\\s*([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?)', 1) AS DOUBLE), 0D) END",
)
# functions that others use come first
_SQL_FUNCTIONS = (
    "sqlite_zone(t STRING) RETURNS DECIMAL(10,0) RETURN CASE WHEN lower(right(t, 1)) = 'z' THEN 0 ELSE"
    " IF(left(right(t, 6), 1) = '-', -1, 1) * (int(left(right(t, 5), 2)) * 3600 + int(right(t, 2)) * 60) END",
    *(f for f in _SQL_FUNCTIONS if not f.startswith("sqlite_shift")), *(f for f in _SQL_FUNCTIONS if f.startswith("sqlite_shift")),
)


def register_functions(spark: SparkSession) -> None:
    """Make ``julianday``, ``datetime``, ``timetext``, ``strftime`` and what ``plans.sqltext`` writes known to the session's SQL.

    They are SQL expressions that Catalyst inlines, in the time zone that the session has now.
    """
    for function in _SQL_FUNCTIONS:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + function)
