"""Versioned tables of the changes of offset of time zones."""

from __future__ import annotations

import zoneinfo
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from importlib import metadata
from pathlib import Path

import numpy as np

#: Offsets in hours of the zone abbreviations of Europe, North America and Japan.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "IST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2,
    "EET": 2, "EEST": 3, "MSK": 3, "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10, "JST": 9,
}

YEARS = (1990, 2040)


@dataclass(frozen=True)
class ZoneTables:
    """For each zone the seconds at which its offset changes, and the offsets (seconds) before, between and after."""

    version: str
    first: int
    last: int
    zones: dict[str, tuple[np.ndarray, np.ndarray]]


def _version() -> str:
    for folder in zoneinfo.TZPATH:
        rules = Path(folder, "tzdata.zi")
        if rules.exists():
            with rules.open() as f:
                return f.readline().removeprefix("# version").strip()
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "unknown"


def _changes(zone: zoneinfo.ZoneInfo, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    def offset(at: int) -> int:
        return int(datetime.fromtimestamp(at, zone).utcoffset() / timedelta(seconds=1))

    at, offsets, step = [], [offset(first)], 14 * 86400  # no rule holds for less than two weeks
    for t in range(first, last, step):
        low, high = t, min(t + step, last)
        if (after := offset(high)) != offsets[-1]:
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            at.append(high)
            offsets.append(after)
    return np.array(at, np.int64), np.array(offsets, np.int64)


@lru_cache(maxsize=4)
def zone_tables(years: tuple[int, int] = YEARS) -> ZoneTables:
    """Tables for the years [first, last) of all zones that the driver's tz database knows.

    They are built on the driver and sent along, so that every executor converts by the same version; their size is
    bound by the database (about 600 zones, some sixty changes each).
    """
    first, last = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in years)
    names = sorted(n for n in zoneinfo.available_timezones() if not n.startswith(("posix/", "right/")) and n != "localtime")
    known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # many names stand for the same rules
    zones = {}
    for n in names:
        rules = next((f.read_bytes() for p in zoneinfo.TZPATH if (f := Path(p, n)).is_file()), n.encode())
        if rules not in known:
            known[rules] = _changes(zoneinfo.ZoneInfo(n), first, last)
        zones[n] = known[rules]
    return ZoneTables(_version(), first, last, zones)


#: The zones that the abbreviations on devices stand for.
ZONE_OF = {
    "BST": "Europe/London", "CEST": "Europe/Paris", "CET": "Europe/Paris", "CST": "America/Chicago", "EET": "Europe/Athens",
    "EST": "America/New_York", "GMT": "GMT", "HST": "Pacific/Honolulu", "IST": "Asia/Kolkata", "JST": "Asia/Tokyo", "MSK": "Europe/Moscow",
    "MST": "America/Denver", "PST": "America/Los_Angeles", "UTC": "UTC", "WET": "Europe/Lisbon",
}


def zone_names(spark):
    """Names by which a zone may be given, with the identifier that each stands for: (name, identifier).

    Identifiers stand for themselves, also where they look like abbreviations. About 600 rows, so it may be broadcast.
    """
    own = {n for n in zoneinfo.available_timezones() if not n.startswith(("posix/", "right/")) and n != "localtime"}
    rows = {n: n for n in own} | {a: z for a, z in ZONE_OF.items() if a not in own}
    return spark.createDataFrame(sorted(rows.items()), "name string, identifier string")


def wall_to_utc(wall_us: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Wall times in microseconds to (instants in microseconds, number of instants that the wall time denotes)."""
    at, offsets = table
    found, count = np.zeros(len(wall_us), np.int64), np.zeros(len(wall_us), np.int64)
    for o in np.unique(offsets):
        utc = wall_us - o * 1_000_000
        holds = offsets[np.searchsorted(at, utc // 1_000_000, side="right")] == o
        found, count = np.where(holds, utc, found), count + holds
    return found, count
