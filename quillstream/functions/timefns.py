"""Offsets, time stamps and times in names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def two_digits(n: Column) -> Column:
    """A number with at least two digits; longer ones stay whole."""
    s = n.cast("string")
    return F.when(F.length(s) >= 2, s).otherwise(F.lpad(s, 2, "0"))


def clock_to_seconds(ts: Column | str) -> Column:
    """``HH:MM:SS`` to whole seconds; null where it isn't of that form."""
    ts = _c(ts)
    part = lambda i: F.regexp_extract(ts, r"^(\d+):(\d{2}):(\d{2})$", i).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def seconds_to_clock(s: Column | str) -> Column:
    """Seconds to ``HH:MM:SS``, truncated to whole seconds."""
    n = _c(s).cast("long")
    return F.concat_ws(":", two_digits(F.floor(n / 3600)), two_digits(F.floor(n / 60) % 60), two_digits(n % 60))


def seconds_to_short_clock(s: Column | str) -> Column:
    """Seconds to ``H:MM:SS``, with ``D day(s), `` before it from 24 hours on."""
    n = _c(s).cast("long")
    days = F.floor(n / 86400).cast("long")
    clock = F.concat_ws(":", (F.floor(n / 3600) % 24).cast("string"), two_digits(F.floor(n / 60) % 60), two_digits(n % 60))
    return F.when(days == 0, clock).when(days == 1, F.concat(F.lit("1 day, "), clock)).otherwise(F.concat(days.cast("string"), F.lit(" days, "), clock))


def offset_seconds(ts: Column | str) -> Column:
    """Seconds of an offset as people write it, or null where it is unreadable.

    Read are hours (any number of digits), minutes and seconds; minutes and seconds; seconds before an ``s``; each
    with decimals after a point or comma, within brackets or white space.
    """
    ts = _c(ts)
    clock = r"(?U)^[\s\[(]*(?:(\d+):)?(\d+):(\d{1,2})(?:[.,](\d+))?[\s\])]*$"
    plain = r"(?U)^[\s\[(]*(\d+)(?:[.,](\d+))?\s*s[\s\])]*$"
    number = lambda p, i: F.coalesce(F.regexp_extract(ts, p, i).try_cast("double"), F.lit(0.0))
    frac = lambda p, i: F.coalesce(F.concat(F.lit("0."), F.regexp_extract(ts, p, i)).try_cast("double"), F.lit(0.0))
    return (
        F.when(ts.rlike(clock), number(clock, 1) * 3600 + number(clock, 2) * 60 + number(clock, 3) + frac(clock, 4))
        .when(ts.rlike(plain), number(plain, 1) + frac(plain, 2))
    )


def slide_seconds(filename: Column | str, minutes: bool = False) -> Column:
    """The time in a slide's name, ``..._<seconds>.png``; null where the name has none."""
    t = F.regexp_extract(_c(filename), r"_([0-9]+(?:\.[0-9]+)?)\.png$", 1).try_cast("double")
    return t / 60 if minutes else t
