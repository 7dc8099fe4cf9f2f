"""Reading instants out of a text: every notation a text may be written in, and all that it may mean there.

Pure Python, used from Arrow batches by ``terralace.operators.timestamps``. All instants are microseconds since
1970-01-01 UTC.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ORDERS = ("DMY", "MDY", "YMD")

# English month names by their first three letters.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
# Zone names that mean the same everywhere, in minutes; all others mean what they mean in the zone.
UNIVERSAL = {"Z": 0, "UTC": 0, "UT": 0, "GMT": 0}
# Other names in common use for what the zone database writes as a number.
LOCAL_NAMES = {
    "Asia/Kolkata": {"IST": 330},
    "Asia/Kathmandu": {"NPT": 345},
    "America/Sao_Paulo": {"BRT": -180, "BRST": -120},
}
#: Units of bare numbers, in nanoseconds.
UNITS = {"d": 86_400_000_000_000, "h": 3_600_000_000_000, "min": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
#: Bare numbers whose instant is further from 1970 than this have no reading (years that a date can have).
FURTHEST_US = 253_000_000_000_000_000
#: Zone names are looked up in these years; the latest use of a name counts.
NAME_YEARS = range(2037, 1969, -1)

CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
ZONE = r"(?P<z>\s*(?:Z|z|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|\[[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*\]|[A-Z]{2,5}))?"
HALF = r"(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"

NOTATIONS = [
    (name, re.compile(pattern))
    for name, pattern in (
        ("number", r"(?P<n>[+-]?\d{1,24})(?:\.(?P<nf>\d+))?"),
        ("iso", rf"(?P<y>\d{{4}})(?P<sep>[-/.:])(?P<mo>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:[T ]\s*{CLOCK}{HALF})?{ZONE}"),
        ("compact", rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})[T ](?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{ZONE}"),
        ("week", rf"(?P<y>\d{{4}})-?W(?P<w>\d{{2}})-?(?P<wd>\d)(?:[T ]{CLOCK})?{ZONE}"),
        ("ordinal", rf"(?P<y>\d{{4}})-(?P<yd>\d{{3}})(?:[T ]{CLOCK})?{ZONE}"),
        ("numeric", rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<c>\d{{4}}|\d{{2}}|\d)(?:[T ,]\s*{CLOCK}{HALF})?{ZONE}"),
        ("mail", rf"(?:(?P<dow>[A-Za-z]{{3,9}}),?\s+)?(?P<d>\d{{1,2}})[ -](?P<mon>[A-Za-z]{{3,9}})\.?[ -](?P<y>\d{{4}}),?\s+{CLOCK}{HALF}{ZONE}"),
        ("month_first", rf"(?P<mon>[A-Za-z]{{3,9}})\.? (?P<d>\d{{1,2}}),? (?P<y>\d{{4}}),?\s+{CLOCK}{HALF}{ZONE}"),
        ("korean", r"(?P<y>\d{4})년\s*(?P<mo>\d{1,2})월\s*(?P<d>\d{1,2})일(?:\s*(?P<ko>오전|오후))?(?:\s*(?P<h>\d{1,2})시)?(?:\s*(?P<mi>\d{1,2})분)?(?:\s*(?P<s>\d{1,2})초)?"),
        ("group", r"(?P<d>\d{2})(?P<h>\d{2})(?P<mi>\d{2})(?P<z>[A-Z])(?P<mon>[A-Za-z]{3})(?P<y>\d{2})"),
    )
]


@lru_cache(maxsize=None)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=None)
def _names_of(zone: str) -> dict[str, int]:
    """Abbreviation -> minutes, as used in ``zone``."""
    found: dict[str, int] = dict(LOCAL_NAMES.get(zone, {}))
    tz = _zone(zone)
    if tz:
        for year in NAME_YEARS:
            for month in (1, 7):
                at = datetime(year, month, 1, tzinfo=tz)
                found.setdefault(at.tzname(), int(at.utcoffset().total_seconds() // 60))
    return found


def _micros(at: datetime) -> int:
    return (at - EPOCH) // timedelta(microseconds=1)


@lru_cache(maxsize=65536)
def _wall(zone: str, y: int, mo: int, d: int, h: int, mi: int) -> tuple[int, ...]:
    """The instants of a wall minute in ``zone``: none if it doesn't exist, two if it occurs twice, the earlier first."""
    tz = _zone(zone)
    if tz is None:
        return ()
    found = []
    for fold in (0, 1):
        utc = datetime(y, mo, d, h, mi, tzinfo=tz, fold=fold).astimezone(timezone.utc)
        back = utc.astimezone(tz)
        if (back.day, back.hour, back.minute) == (d, h, mi):
            found.append(_micros(utc))
    return tuple(sorted(set(found)))


def _offset(zone_text: str, zone: str | None) -> int | None | str:
    """Minutes east of UTC, or a zone's name for ``[Area/City]``, or null if it means nothing."""
    z = zone_text.strip()
    if z in UNIVERSAL:
        return UNIVERSAL[z]
    if z == "z":
        return 0
    if z[0] == "[":
        return z[1:-1] if _zone(z[1:-1]) else None
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?", z)
    if m:
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 18 or minutes > 59:
            return None
        return (hours * 60 + minutes) * (-1 if m[1] == "-" else 1)
    return _names_of(zone).get(z) if zone else None


def _instants(y, mo, d, h, mi, s, frac, zone_text, zone) -> list[int]:
    """The instants that given parts may mean, the earlier first; none if there is no such time."""
    if not (0 <= h <= 23 and 0 <= mi <= 59 and 0 <= s <= 59):
        return []
    try:
        date(y, mo, d)
        if zone_text and zone_text.strip():
            east = _offset(zone_text, zone)
            if east is None:
                return []
            if isinstance(east, str):
                bases = _wall(east, y, mo, d, h, mi)
            else:
                bases = (_micros(datetime(y, mo, d, h, mi, tzinfo=timezone.utc)) - east * 60_000_000,)
        else:
            bases = _wall(zone, y, mo, d, h, mi) if zone else ()
    except (ValueError, OverflowError):
        return []
    return [base + s * 1_000_000 + frac for base in bases]


def _numbers(whole: str, part: str | None) -> list[tuple[str, int]]:
    """The instants of a bare number by unit."""
    n, nanos = int(whole), int((part or "0")[:12].ljust(12, "0"))
    out = []
    for unit, size in UNITS.items():
        us = (n * size + nanos * size // 10**12) // 1000
        if abs(us) < FURTHEST_US:
            out.append((unit, us))
    return out


def _parts(name: str, g: dict) -> list[tuple[str, tuple]]:
    """(variant, (year, month, day)) that the date of a matched text may be."""
    if name == "numeric":
        a, b, c = int(g["a"]), int(g["b"]), int(g["c"])
        tries = []
        if len(g["c"]) == 4:
            tries = [("DMY", (c, b, a)), ("MDY", (c, a, b))]
        else:
            if len(g["c"]) == 2:
                tries = [("DMY", (2000 + c, b, a)), ("MDY", (2000 + c, a, b))]
            if len(g["a"]) == 2:
                tries.append(("YMD", (2000 + a, b, c)))
        return tries
    y = int(g["y"])
    try:
        if name == "week":
            at = date.fromisocalendar(y, int(g["w"]), int(g["wd"]))
            return [("", (at.year, at.month, at.day))]
        if name == "ordinal":
            at = date(y, 1, 1) + timedelta(days=int(g["yd"]) - 1)
            return [("", (y, at.month, at.day))] if at.year == y else []
        month = int(g["mo"]) if g.get("mo") else MONTHS.get((g["mon"] or "")[:3].lower())
        if not month:
            return []
        y += 2000 if name == "group" else 0
        day = int(g["d"])
        if g.get("dow") and g["dow"][:3].lower() != date(y, month, day).strftime("%a").lower():
            return []
        return [("", (y, month, day))]
    except (ValueError, OverflowError):
        return []


def _letter(z: str) -> str | None:
    """The offset of a military letter: A to M without J go east, N to Y west, Z is UTC; J means nothing here."""
    if z == "J":
        return None
    east = 0 if z == "Z" else ("ABCDEFGHIKLM".find(z) + 1) or -("NOPQRSTUVWXY".find(z) + 1)
    return f"{east:+03d}:00"


def read(text: str | None, zone: str | None) -> tuple[str | None, list[tuple[str, int]]]:
    """(the notation, all readings of the text as (kind, instant)).

    A kind is the notation, for all-number dates with the date order (``numeric:DMY``), for bare numbers with the unit
    (``number:s``), and with ``:later`` behind it for the second occurrence of a wall time that occurs twice. Every
    notation is tried; the name returned is the first that fits. A text in no known notation gives (None, []), one that
    names no existing time has no reading.
    """
    t = (text or "").strip().strip("\ufeff\u200b").strip()
    first, out = None, []
    if not t or len(t) > 200:
        return first, out
    for name, pattern in NOTATIONS:
        m = pattern.fullmatch(t)
        if not m:
            continue
        first = first or name
        g = m.groupdict()
        if name == "number":
            out += [(f"number:{unit}", us) for unit, us in _numbers(g["n"], g["nf"])]
            continue
        h, mi, s = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
        frac = int((g.get("f") or "0")[:6].ljust(6, "0"))
        half = (g.get("ap") or "").lower() or {"오전": "a", "오후": "p"}.get(g.get("ko") or "", "")
        if half:
            if not 1 <= h <= 12:
                continue
            h = h % 12 + (12 if half == "p" else 0)
        z = g.get("z")
        if name == "group":
            z = _letter(z)
            if z is None:
                continue
        for variant, ymd in _parts(name, g):
            kind = f"{name}:{variant}" if variant else name
            for k, us in enumerate(_instants(*ymd, h, mi, s, frac, z, zone)):
                out.append((kind + ":later" if k else kind, us))
    return first, out
