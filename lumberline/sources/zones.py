"""Zones of timestamps without one: reception, utc, local, an offset, a zone name, or a POSIX rule."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

YEARS = range(1970, 2101)
_NAME = r"(?:<[A-Za-z0-9+-]{3,}>|[A-Za-z]{3,})"
_TIME = r"[+-]?\d{1,3}(?::\d{1,2}(?::\d{1,2})?)?"
_DAY = r"(?:M\d{1,2}\.\d\.\d|J\d{1,3}|\d{1,3})"
_RULE = re.compile(rf"{_NAME}({_TIME})(?:{_NAME}({_TIME})?,({_DAY})(?:/({_TIME}))?,({_DAY})(?:/({_TIME}))?)?\Z")


def _seconds(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    parts = [*map(int, text.lstrip("+-").split(":")), 0, 0][:3]
    return sign * (parts[0] * 3600 + parts[1] * 60 + parts[2])


class Rule:
    """Standard offset and, with daylight saving, its offset and the two days of change; seconds east of UTC."""

    def __init__(self, text: str):
        m = _RULE.match(text)
        if m is None:
            raise ValueError(f"{text!r} is not a POSIX TZ rule")
        self.std = -_seconds(m[1])
        self.dst = None if m[3] is None else -_seconds(m[2]) if m[2] else self.std + 3600
        self.start, self.end = (m[3], m[4]), (m[5], m[6])

    @staticmethod
    def _wall(change: tuple[str, str | None], year: int) -> int:
        """Seconds since 1970, as if in UTC, of a change in a year."""
        day, time = change
        if day[0] == "M":
            month, week, weekday = map(int, day[1:].split("."))
            first = date(year, month, 1)
            when = first + timedelta((weekday - first.isoweekday()) % 7 + 7 * (week - 1))
            while when.month != month:
                when -= timedelta(7)
        elif day[0] == "J":
            n = int(day[1:])
            when = date(year, 1, 1) + timedelta(n - 1 + (calendar.isleap(year) and n >= 60))
        else:
            when = date(year, 1, 1) + timedelta(int(day))
        return (when - date(1970, 1, 1)).days * 86_400 + (7200 if time is None else _seconds(time))

    def changes(self, year: int) -> tuple[int, int]:
        return self._wall(self.start, year) - self.std, self._wall(self.end, year) - self.dst

    def to_ms(self, wall: int, year: int) -> int | None:
        """The earlier moment of a wall-clock time that comes twice; None for one that is skipped."""
        if self.dst is None:
            return (wall - self.std) * 1000
        start, end = self.changes(year)
        inside = lambda t: start <= t < end if start < end else t >= start or t < end
        found = [t for t, ok in ((wall - self.dst, inside(wall - self.dst)), (wall - self.std, not inside(wall - self.std))) if ok]
        return min(found) * 1000 if found else None

    def column(self, wall: Column, year: Column) -> Column:
        """The same as an expression, over a table of the changes of each year."""
        if self.dst is None:
            return (wall - self.std) * 1000
        table = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in map(self.changes, YEARS)))
        at = F.get(table, year - YEARS[0])

        def inside(t: Column) -> Column:
            return F.when(at["s"] < at["e"], (t >= at["s"]) & (t < at["e"])).otherwise((t >= at["s"]) | (t < at["e"]))

        summer, winter = wall - self.dst, wall - self.std
        return F.least(F.when(inside(summer), summer), F.when(~inside(winter), winter)) * 1000


def parse(text: str):
    """None for reception, else a function of (seconds of the wall clock, year) to milliseconds."""
    bare = text.strip()
    low = bare.lower()
    if low in ("", "reception"):
        return None
    if low in ("utc", "z"):
        return lambda wall, year: wall * 1000
    if low == "local":
        return lambda wall, year: _named(wall, F.current_timezone())
    if m := re.fullmatch(r"([+-])(\d{1,2})(?::?(\d\d))?", bare):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 14 or minutes > 59:
            raise ValueError(f"{text!r} is not an offset")
        offset = (1 if m[1] == "+" else -1) * (hours * 3600 + minutes * 60)
        return lambda wall, year: (wall - offset) * 1000
    if "," in bare:
        return Rule(bare).column
    if re.fullmatch(r"[A-Za-z0-9_+-]+(?:/[A-Za-z0-9_+-]+)*", bare):
        from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

        try:
            ZoneInfo(bare)
        except (ZoneInfoNotFoundError, ValueError, OSError):
            raise ValueError(f"{text!r} is not reception, utc, local, an offset, a zone name or a POSIX rule") from None
        return lambda wall, year: _named(wall, F.lit(bare))
    raise ValueError(f"{text!r} is not reception, utc, local, an offset, a zone name or a POSIX rule")


def _named(wall: Column, zone: Column) -> Column:
    """A wall-clock time that is skipped has no moment: it doesn't come back the same."""
    there = F.timestamp_seconds(wall)
    utc = F.to_utc_timestamp(there, zone)
    return F.when(F.from_utc_timestamp(utc, zone) == there, F.unix_millis(utc))
