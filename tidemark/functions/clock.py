"""The ``DAYn`` / ``HHMMSSFF`` clock and the other time dialects, as Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400


def day_number(date: Column) -> Column:
    """n of ``DAYn`` in any letter case, zero-padded or not; NULL for anything else."""
    digits = F.regexp_extract(date, r"^(?i:day)0*([0-9]{1,9})\z", 1)
    return F.when(F.length(digits) > 0, digits).try_cast("int")


def clock_seconds(time: Column) -> Column:
    """Second of the day of up to eight digits read as ``HHMMSSFF``; NULL if it is no such time."""
    padded = F.lpad(F.when(time.rlike(r"^[0-9]{1,8}\z"), time), 8, "0")
    hh, mm, ss = (F.substring(padded, p, 2).try_cast("int") for p in (1, 3, 5))
    return F.when((hh < 24) & (mm < 60) & (ss < 60), hh * 3600 + mm * 60 + ss)


def running_seconds(day: Column, second: Column) -> Column:
    """One clock over all days."""
    return (day.cast("long") - 1) * DAY_SECONDS + second


def is_seconds_ts(ts: Column, is_float: Column) -> Column:
    """Floats and integers below a million are seconds, other integers ``DHHMMSSFF``."""
    return is_float | (ts < 1_000_000)


def day_stamp_seconds(stamp: Column) -> Column:
    """Seconds of an integer stamp ``D..HHMMSSFF``; the day may have several digits."""
    s = stamp.cast("long")
    day, rest = F.floor(s / 100_000_000), F.pmod(s, F.lit(100_000_000))
    hh, mm, ss = F.floor(rest / 1_000_000), F.pmod(F.floor(rest / 10_000), F.lit(100)), F.pmod(F.floor(rest / 100), F.lit(100))
    return ((day - 1) * DAY_SECONDS + hh * 3600 + mm * 60 + ss).cast("double")


def two(c: Column) -> Column:
    return F.lpad(c.cast("long").cast("string"), 2, "0")


def hms(seconds: Column) -> Column:
    """``HH:MM:SS`` of a number of seconds below 100 hours."""
    s = F.floor(seconds).cast("long")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.pmod(F.floor(s / 60), F.lit(60))), two(F.pmod(s, F.lit(60))))


def day_label(seconds: Column) -> Column:
    """``DAYn HH:MM:SS`` of a running number of seconds."""
    return F.concat(F.lit("DAY"), (F.floor(seconds / DAY_SECONDS) + 1).cast("string"), F.lit(" "), hms(F.pmod(F.floor(seconds), F.lit(DAY_SECONDS))))


def civil_days_sql(y: str, m: str, d: str) -> str:
    """Days since 1970-01-01 of a proleptic Gregorian date, by arithmetic that never raises (SQL text)."""
    years = f"({y} - CASE WHEN {m} <= 2 THEN 1 ELSE 0 END)"
    of_year = f"((153 * ({m} + CASE WHEN {m} > 2 THEN -3 ELSE 9 END) + 2) div 5 + {d} - 1)"
    return f"({years} * 365L + {years} div 4 - {years} div 100 + {years} div 400 + {of_year} - 719468)"


def is_date_sql(y: str, m: str, d: str) -> str:
    """Whether the calendar has this day (SQL text)."""
    leap = f"(({y} % 4 = 0 AND {y} % 100 <> 0) OR {y} % 400 = 0)"
    return f"({y} >= 1 AND {m} BETWEEN 1 AND 12 AND {d} >= 1 AND {d} <= CASE WHEN {m} = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END WHEN {m} IN (4, 6, 9, 11) THEN 30 ELSE 31 END)"


def digits_seconds_sql(c: str) -> str:
    """Second of the day of ``HHMMSSFF`` as a number or text (SQL text), without a check."""
    t = f"lpad(CAST({c} AS string), 8, '0')"
    return f"(CAST(substr({t}, 1, 2) AS bigint) * 3600 + CAST(substr({t}, 3, 2) AS bigint) * 60 + CAST(substr({t}, 5, 2) AS bigint))"


def seconds_digits_sql(s: str) -> str:
    """``HHMMSSFF`` of a second of the day (SQL text); the frame is 0."""
    two_ = lambda x: f"lpad(CAST({x} AS string), 2, '0')"
    return f"concat({two_(f'{s} DIV 3600')}, {two_(f'{s} DIV 60 % 60')}, {two_(f'{s} % 60')}, '00')"


def frame_sql(c: str, fps: int = 20) -> str:
    """Number of the frame that ``HHMMSSFF`` names (SQL text)."""
    return f"({digits_seconds_sql(c)} * {fps} + CAST(substr(lpad(CAST({c} AS string), 8, '0'), 7, 2) AS bigint))"


def clock_text_sql(c: str) -> str:
    """Seconds of ``HH:MM`` or ``HH:MM:SS`` (SQL text); NULL for anything else."""
    g = lambda k: f"CAST(regexp_extract({c}, '^([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?$', {k}) AS bigint)"
    return f"CASE WHEN {c} RLIKE '^[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?$' THEN {g(1)} * 3600 + {g(2)} * 60 + coalesce(try_cast(regexp_extract({c}, '^([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?$', 3) AS bigint), 0L) END"


#: A moment as DAYn HH:MM:SS within a text.
MOMENT = "(?i)DAY\\\\s*([0-9]+)\\\\s+([0-9]{1,2}):([0-9]{2}):([0-9]{2})"


def is_time_range_sql(text: str) -> str:
    """Whether a text asks for a range of time (SQL text)."""
    one = "DAY\\\\s*[0-9]+\\\\s+[0-9]{1,2}:[0-9]{2}:[0-9]{2}"
    return f"{text} RLIKE '(?i){one}\\\\s*-\\\\s*{one}'"


def time_range_sql(text: str) -> str:
    """Both ends of the range that a text names, as stamps ``DHHMMSS00`` (SQL text, an array); NULL with fewer than two moments."""
    g = lambda k: f"regexp_extract_all({text}, '{MOMENT}', {k})"
    stamp = lambda i: f"CAST(concat({g(1)}[{i}], lpad({g(2)}[{i}], 2, '0'), {g(3)}[{i}], {g(4)}[{i}], '00') AS bigint)"
    return f"CASE WHEN size({g(1)}) >= 2 THEN array({stamp(0)}, {stamp(1)}) END"
