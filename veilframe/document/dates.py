"""Dates as they are written: reading them, moving them in their own layout, and top-coding ages."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable

from .view import digits_only, match_key

# The range of offsets, the year that two digits turn at, the age from which ages are one, and what stands for no date.
LEAST_SHIFT, MOST_SHIFT, ATTEMPTS, PIVOT, AGE_CAP, NO_DATE = 30, 365, 256, 30, 90, "[date]"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_DAYS = 30.4375
_AROUND = re.compile(r"(?s)(\s*[(\[{\"'“‘]*)(.*?)([)\]}\"'”’.,;:!?]*\s*)")
_NUMERIC = re.compile(r"(\d{1,2})([ \t]?[/.\-][ \t]?)(\d{1,2})([ \t]?[/.\-][ \t]?)(\d{4}|\d{2})")
_ISO = re.compile(r"((?:18|19|20)\d{2})-(\d{2})-(\d{2})")
_PIECES = re.compile(r"[A-Za-z]+|\d+(?:st|nd|rd|th)?|[^A-Za-z\d]+", re.IGNORECASE)
_DAY = re.compile(r"(\d{1,2})(st|nd|rd|th)?", re.IGNORECASE)


def like(template: str, value: str) -> str:
    """``value`` in capitals or small letters if ``template`` is."""
    letters = [c for c in template if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return value.upper()
    return value.lower() if letters and all(c.islower() for c in letters) else value


def _ending(day: int) -> str:
    return "th" if 11 <= day % 100 <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _month(word: str) -> int:
    """1 to 12 for a month's name or its first three or more letters, else 0."""
    w = word.lower()
    return next((i for i, name in enumerate(MONTHS, 1) if len(w) >= 3 and name.lower().startswith(w)), 0)


def _year(text: str) -> int:
    n = int(text)
    return n if len(text) == 4 else n + (2000 if n < PIVOT else 1900)


class Written:
    """A date's parts and how to write another one like it; ``day`` None: a month; ``date`` None: no valid date."""

    def __init__(self, text: str):
        self.lead, core, self.trail = _AROUND.fullmatch(text).groups()
        self.year = self.month = self.day = None
        self._write: Callable[[int, int, int], str] | None = None
        numeric, iso = _NUMERIC.fullmatch(core), _ISO.fullmatch(core)
        if iso:
            self.year, self.month, self.day = map(int, iso.groups())
            self._write = lambda y, m, d: f"{y:04d}-{m:02d}-{d:02d}"
        elif numeric:
            d0, s1, m0, s2, y0 = numeric.groups()
            self.day, self.month, self.year = int(d0), int(m0), _year(y0)
            width = lambda n, old: f"{n:02d}" if len(old) == 2 else str(n)
            self._write = lambda y, m, d: width(d, d0) + s1 + width(m, m0) + s2 + (f"{y:04d}" if len(y0) == 4 else f"{y % 100:02d}")
        elif core:
            self._words(_PIECES.findall(core))

    def _words(self, parts: list[str]) -> None:
        days = [i for i, p in enumerate(parts) if (m := _DAY.fullmatch(p)) and (m[2] or len(p) <= 2)]
        years = [i for i, p in enumerate(parts) if p.isdigit() and len(p) == 4]
        months = [i for i, p in enumerate(parts) if p.isalpha() and _month(p)]
        if not years:
            return
        self.year = int(parts[years[-1]])
        if not months:
            self.bare_year = not days and len(parts) == 1 and parts[0][:2] in ("18", "19", "20")
            return
        ordinals = [i for i in days if not parts[i].isdigit()]
        day_at = (ordinals or days or [None])[0]
        month_at, year_at = months[0], years[-1]
        self.month = _month(parts[month_at])
        self.day = int(_DAY.fullmatch(parts[day_at])[1]) if day_at is not None else None
        short = len(parts[month_at]) < len(MONTHS[self.month - 1])

        def write(y: int, m: int, d: int) -> str:
            out = list(parts)
            name = MONTHS[m - 1]
            out[month_at] = like(parts[month_at], name[:3] if short else name)
            out[year_at] = f"{y:04d}"
            if day_at is not None:
                ending = _DAY.fullmatch(parts[day_at])[2]
                out[day_at] = f"{d}{like(ending, _ending(d))}" if ending else f"{d:02d}" if len(parts[day_at]) == 2 else str(d)
            return "".join(out)

        self._write = write

    bare_year = False

    @property
    def date(self) -> dt.date | None:
        try:
            return dt.date(self.year, self.month, self.day)
        except (TypeError, ValueError):
            return None

    def as_written(self, y: int, m: int, d: int) -> str:
        return self.lead + self._write(y, m, d) + self.trail


def canonical_date(value: str) -> str | None:
    """yyyy-mm-dd of a day-first, ISO or worded date; days that a month doesn't have are let through."""
    w = Written(value)
    if w.year is None or w.month is None or w.day is None or not (1 <= w.day <= 31 and 1 <= w.month <= 12):
        return None
    return f"{w.year:04d}-{w.month:02d}-{w.day:02d}"


def shift_date(value: str, days: int) -> str:
    """The date ``days`` later in its own layout; a month by whole months, a lone year as it is, else ``NO_DATE``."""
    w = Written(value)
    if w.bare_year:
        return value
    if w._write is None:
        return NO_DATE
    if w.day is None:
        months = w.year * 12 + w.month - 1 + round(days / MONTH_DAYS)
        return w.as_written(months // 12, months % 12 + 1, 0)
    if w.date is None:
        return NO_DATE
    try:
        moved = w.date + dt.timedelta(days=days)
    except OverflowError:
        return NO_DATE
    return w.as_written(moved.year, moved.month, moved.day)


def date_delta(before: str, after: str) -> int | None:
    a, b = Written(before).date, Written(after).date
    return (b - a).days if a and b else None


def same_year(value: str, day_of_year: int) -> str:
    """The date's year with another day and month, in its layout; a plain date where the layout isn't known."""
    day = dt.date(2023, 1, 1) + dt.timedelta(days=day_of_year % 365)
    w = Written(value)
    if w._write is not None:
        return w.as_written(w.year, day.month, day.day)
    year = re.search(r"(?<![0-9])(?:18|19|20)\d{2}(?![0-9])", value)
    return f"{day.day:02d}/{day.month:02d}/{year[0] if year else '1970'}"


def generalise_age(value: str) -> str:
    return re.sub(r"(?<!\d)\d{1,3}(?!\d)", lambda m: f"{AGE_CAP}+" if int(m[0]) >= AGE_CAP else m[0], value)


def leak_needles(values: Iterable[str], shortest: int = 4) -> set[str]:
    """What must not be found in an output: values' keys, and their digits if there are six or more."""
    out = set()
    for v in values:
        key, digits = match_key(v), digits_only(v)
        out |= {key} if len(key) >= shortest else set()
        out |= {digits} if len(digits) >= 6 else set()
    return out


def choose_offset(index: Callable[[str, int, int], int], dates: list[str], removed: list[str]) -> int:
    """A keyed number of days, either way, under which no date becomes what looks like a removed value; 0: none does.

    ``index``: a keyed draw by purpose, size and attempt.
    """
    needles = leak_needles(removed)
    for attempt in range(ATTEMPTS):
        days = LEAST_SHIFT + index("magnitude", MOST_SHIFT - LEAST_SHIFT + 1, attempt)
        days *= 1 if index("sign", 2, attempt) else -1
        moved = [s for v in dates if (s := shift_date(v, days)) not in (v, NO_DATE)]
        if not any(n in match_key(s) or n in digits_only(s) for s in moved for n in needles):
            return days
    return 0
