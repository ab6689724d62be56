"""Reading one timestamp notation: pure functions, used inside Arrow batches.

A text is read into *candidates*.  A candidate is ``(first_us, second_us)``: the
instant in microseconds since 1970 UTC, and a second instant where a wall time
occurred twice.  Several candidates come back where a year is missing or day and
month cannot be told apart; the caller's window decides between them.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)
US = timedelta(microseconds=1)

# Month names and their places in the year.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

# Customary zone names and their offsets in minutes, used where the session's own zone has no such name.
ZONE_MINUTES = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 330,
    "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NPT": 345, "JST": 540, "KST": 540, "SGT": 480, "HKT": 480, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,:](?P<f>\d+))?)?"
_ZONE = r"(?:\s*(?P<ap>[AaPp]\.?[Mm]\.?))?(?:\s*\(?(?P<z>[Zz]|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Z][A-Za-z_]+/[A-Za-z_/+-]+)\)?)?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_MON = r"(?P<mon>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"


def _form(text: str) -> re.Pattern[str]:
    return re.compile(rf"^{_DAY}{text}$".replace("(?P<Z>)", _ZONE), re.IGNORECASE)


FORMS = (
    _form(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:[Tt]|\s+|[_:-]){_TIME}(?P<Z>)"),
    _form(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt\s_-](?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?P<Z>)"),
    _form(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt\s_-]{_TIME}(?P<Z>)"),
    _form(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}),?(?:[Tt]|\s+|[_:-]){_TIME}(?P<Z>)"),
    _form(rf"(?P<d>\d{{1,2}})[\s/.-]*{_MON}[\s/.,-]*(?P<y>\d{{4}})(?:[:Tt]|,?\s+){_TIME}(?P<Z>)"),
    _form(rf"{_MON}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+{_TIME}(?P<Z>)"),
    _form(rf"{_MON}\s+(?P<d>\d{{1,2}}),?\s+{_TIME}(?:\s+(?P<z0>[A-Za-z]{{2,5}}|[+-]\d{{2}}:?\d{{2}}))?\s+(?P<y>\d{{4}})"),
    _form(rf"{_MON}\s+(?P<d>\d{{1,2}}),?\s+{_TIME}(?P<Z>)"),
    _form(rf"(?P<d>\d{{1,2}})[\s/.-]+{_MON}\s+{_TIME}(?P<Z>)"),
    _form(rf"(?P<y>\d{{4}})-?W(?P<week>\d{{2}})-?(?P<wd>[1-7])(?:[Tt]|\s+){_TIME}(?P<Z>)"),
    _form(rf"(?P<y>\d{{4}})-(?P<yd>\d{{3}})(?:[Tt]|\s+){_TIME}(?P<Z>)"),
    _form(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<yy>\d{{2}}),?(?:[Tt]|\s+){_TIME}(?P<Z>)"),
)
#: Two-digit years are of this century.
CENTURY = 2000
_BLANKS = re.compile(r"\s+")
FIGURES = re.compile(r"^(\d{9,19})(?:[.,](\d+))?$")
COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{3}|\d{6})?$")
#: Blanks, quotes and brackets around a value.
OUTER = " \t\r\n\f\v   ﻿\"'`´‘’“”«»[](){}<>"
#: Bare figures are read as the unit that puts them between these years.
YEARS = (1990, 2100)

Candidate = tuple[int, "int | None"]


@lru_cache(maxsize=512)
def zone_of(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # an unknown name: the library has several exceptions for it
        return None


@lru_cache(maxsize=4096)
def _names(zone: str, year: int) -> dict[str, int]:
    """Zone abbreviations of ``zone`` in ``year`` and their offsets in minutes."""
    info, out = zone_of(zone), {}
    if info:
        for month in range(1, 13):
            at = datetime(year, month, 1, tzinfo=info)
            if (short := at.tzname()) and short.isalpha():
                out[short.upper()] = int(at.utcoffset().total_seconds() // 60)
    return out


def micros_of(at: datetime) -> int:
    return (at - EPOCH) // US


def wall_instants(at: datetime, zone: str | None) -> Candidate:
    """Instants at which clocks in ``zone`` showed ``at``.

    A wall time that occurred twice gives both instants in order; one the clock
    skipped is read with the offset valid before the change.
    """
    info = zone_of(zone) if zone else None
    if info is None:
        return micros_of(at), None
    one = micros_of(at) - int(at.replace(tzinfo=info, fold=0).utcoffset().total_seconds()) * 1_000_000
    two = micros_of(at) - int(at.replace(tzinfo=info, fold=1).utcoffset().total_seconds()) * 1_000_000
    return (one, two) if two > one else (one, None)


def _offset(zone: str, host: str | None, year: int) -> int | str | None:
    """Minutes for an offset or abbreviation, the name itself for an IANA zone, None if it means nothing."""
    if m := re.match(r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$", zone, re.IGNORECASE):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 15 or minutes > 59:
            return None
        return (hours * 60 + minutes) * (-1 if m[1] == "-" else 1)
    if "/" in zone:
        return zone if zone_of(zone) else None
    up = zone.upper()
    if up in ("Z", "UTC", "GMT", "UT"):
        return 0
    if host and up in (own := _names(host, year)):
        return own[up]
    return ZONE_MINUTES.get(up)


def _build(g: dict[str, str | None], y: int, m: int, d: int) -> datetime | None:
    h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if ap := (g.get("ap") or "").replace(".", "").lower():
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if ap == "pm" else 0)
    f = int(((g.get("f") or "") + "000000")[:6])
    try:
        if (h, mi, s) == (24, 0, 0):
            return datetime(y, m, d) + timedelta(days=1, microseconds=f)
        return datetime(y, m, d, h, mi, s, f)
    except (ValueError, OverflowError):
        return None


def candidates(raw: str | None, host: str | None, year: int | None) -> list[Candidate]:
    """All readings of ``raw`` written in zone ``host``; ``year`` is about when it was written."""
    if raw is None:
        return []
    text = _BLANKS.sub(" ", raw.strip(OUTER))
    if not any(c.isdigit() for c in text):
        return []
    if m := FIGURES.match(text):
        return _figures(m, host)
    for form in FORMS:
        if not (m := form.match(text)):
            continue
        g = m.groupdict()
        zone = g.get("z") or g.get("z0")
        if g.get("mon"):
            days = [(y, MONTHS[g["mon"].lower()[:3]], int(g["d"])) for y in ([int(g["y"])] if g.get("y") else _years(year))]
        elif g.get("week"):
            days = _week_day(int(g["y"]), int(g["week"]), int(g["wd"]))
        elif g.get("yd"):
            days = _year_day(int(g["y"]), int(g["yd"]))
        elif g.get("yy"):
            a, b, c = int(g["a"]), int(g["b"]), int(g["yy"])
            first = [(CENTURY + c, b, a), (CENTURY + c, a, b)] if g["sep"] == "." else [(CENTURY + c, a, b), (CENTURY + c, b, a)]
            days = list(dict.fromkeys([*first, (CENTURY + a, b, c)]))
        elif g.get("a"):
            a, b, y = int(g["a"]), int(g["b"]), int(g["y"])
            days = [(y, b, a)] if g["sep"] == "." else list(dict.fromkeys([(y, a, b), (y, b, a)]))
        else:
            days = [(int(g["y"]), int(g["m"]), int(g["d"]))]
        out = []
        for y, mo, d in days:
            if (at := _build(g, y, mo, d)) is None:
                continue
            if zone is None:
                out.append(wall_instants(at, host))
                continue
            shift = _offset(zone, host, y)
            if isinstance(shift, str):
                out.append(wall_instants(at, shift))
            elif shift is not None:
                out.append((micros_of(at) - shift * 60_000_000, None))
        return out
    return []


def _week_day(year: int, week: int, day: int) -> list[tuple[int, int, int]]:
    try:
        at = date.fromisocalendar(year, week, day)
    except ValueError:
        return []
    return [(at.year, at.month, at.day)]


def _year_day(year: int, day: int) -> list[tuple[int, int, int]]:
    if not 1 <= year or not 1 <= day <= 366:
        return []
    at = date(year, 1, 1) + timedelta(days=day - 1)
    return [(at.year, at.month, at.day)] if at.year == year else []


def _years(year: int | None) -> list[int]:
    return [year - 1, year, year + 1] if year else []


def _figures(m: re.Match[str], host: str | None) -> list[Candidate]:
    whole, part, out = m[1], m[2] or "", []
    if not part and (c := COMPACT.match(whole)):
        g = {"h": c[4], "mi": c[5], "s": c[6], "f": c[7]}
        if (at := _build(g, int(c[1]), int(c[2]), int(c[3]))) and YEARS[0] <= at.year < YEARS[1]:
            out.append(wall_instants(at, host))
    for digits in (0, 3, 6, 9):  # seconds, milli-, micro- and nanoseconds
        scaled = whole + part
        keep = len(whole) - digits + 6
        us = int((scaled + "0" * 12)[:keep]) if keep > 0 else 0
        if micros_of(datetime(YEARS[0], 1, 1)) <= us < micros_of(datetime(YEARS[1], 1, 1)):
            out.append((us, None))
    return out


def utc_text(us: int) -> str:
    """ISO text of an instant, for messages and tests."""
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + us * US).isoformat()
