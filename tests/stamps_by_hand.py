"""Stamps read one at a time with strptime: the slow reading that the vectorised one is compared with."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone
from fractions import Fraction
from zoneinfo import ZoneInfo, available_timezones

ZONES = available_timezones()
HOURS = {"WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "PST": -8, "PDT": -7, "JST": 9}
MONTH_FIRST = {"en_US": True, "en_GB": False, "de_DE": False}
EPOCH = datetime(1970, 1, 1)


def zone_of(metadata, device):
    try:
        name = json.loads(metadata or "{}").get("timeZone")
    except ValueError:
        name = None
    return name if name in ZONES else device if device in ZONES else None


def instants(wall, zone):
    """All instants in microseconds at which the zone's clocks show the wall time."""
    found = set()
    for fold in (0, 1):
        at = wall.replace(tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc)
        if at.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == wall:
            found.add((at.replace(tzinfo=None) - EPOCH) // timedelta(microseconds=1))
    return found


def read(text, locale, zone):
    """Microseconds, or None."""
    text = " ".join((text or "").split())
    if m := re.fullmatch(r"(\d+)(?:\.(\d+))?", text):
        value = Fraction(text)
        for unit, epoch in ((1, 0), (1000, 0), (10**6, 0), (1, 978307200)):
            s = value / unit + epoch
            if 1577836800 <= s < 1798761600:
                return int(s * 10**6)
        return None
    own = None
    if m := re.search(r"\[([^\]]+)\]$", text):
        text, zone = text[: m.start()].strip(), m[1] if m[1] in ZONES else None
    if m := re.search(r"(?<=[\d ])([zZ])$", text):
        own, text = 0, text[: m.start()]
    elif m := re.search(r"([+-])(\d\d):?(\d\d)?$", text):
        if ":" in text[: m.start()] or "T" in text[: m.start()]:
            own, text = (-1 if m[1] == "-" else 1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60), text[: m.start()].strip()
    elif m := re.search(r" ([A-Z]{3,4})$", text):
        if m[1] not in HOURS:
            return None
        own, text = HOURS[m[1]] * 3600, text[: m.start()]
    us = 0
    if m := re.search(r"(:\d\d)[.,](\d+)", text):
        us, text = int((m[2] + "000000")[:6]), text[: m.start()] + m[1] + text[m.end() :]
    slashed = "%m/%d/%Y" if MONTH_FIRST.get(locale) else "%d/%m/%Y"
    formats = []
    for day in ("%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%d.%m.%Y", slashed, "%d %b %Y", "%a, %d %b %Y", "%b %d, %Y at", "%b %d, %Y"):
        for clock in ("%H:%M:%S", "%H:%M", "%I:%M:%S %p", "%I:%M %p", "%H%M%S"):
            formats += [f"{day} {clock}", f"{day}T{clock}"]
    for f in formats:
        try:
            wall = datetime.strptime(text, f) + timedelta(microseconds=us)
        except ValueError:
            continue
        if own is not None:
            return (wall - timedelta(seconds=own) - EPOCH) // timedelta(microseconds=1)
        found = instants(wall, zone) if zone else set()
        return found.pop() if len(found) == 1 else None
    return None
