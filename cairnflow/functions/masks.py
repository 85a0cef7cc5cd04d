"""Stamps read by shape: one parser for each mask of character classes, applied to all stamps of that mask at once."""

from __future__ import annotations

import re

import numpy as np

from .zones import ABBREVIATIONS, ZoneTables, wall_to_utc

LONGEST = 72  # characters of a stamp; no format is longer

_CLASSES = {c: "9" for c in "0123456789"} | {chr(c): "a" for c in (*range(65, 91), *range(97, 123))}
_TABLE = str.maketrans(_CLASSES | {" ": " ", " ": " ", " ": " ", " ": " ", "\t": " "})
_SPACES = str.maketrans({" ": " ", " ": " ", " ": " ", " ": " ", "\t": " "})

#: The months' names in the languages that stamps come in.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
}


def _month_numbers() -> dict[str, int]:
    """Month names, and their first three and four letters, to numbers; what stands for two months is left out."""
    found: dict[str, set[int]] = {"mrz": {3}, "mrt": {3}}
    for names in MONTHS.values():
        for k, name in enumerate(names.split(), 1):
            for text in {name, name[:3], name[:4]}:
                found.setdefault(text, set()).add(k)
    return {t: next(iter(ks)) for t, ks in found.items() if len(ks) == 1}


MONTH_NUMBERS = _month_numbers()

_DATES = [
    r"(?P<Y>9999)(?P<s1>[-/.])(?P<M>99?)(?P=s1)(?P<D>99?)",
    r"(?P<Y>9999)(?P<M>99)(?P<D>99)",
    r"(?P<A>99?)(?P<s1>[-/.])(?P<B>99?)(?P=s1)(?P<Y>9999)",
    r"(?:a{3,9},? )?(?P<D>99?)\.? (?P<N>a{3,9})\.?,? (?P<Y>9999)",
    r"(?:a{3,9},? )?(?P<N>a{3,9})\.? (?P<D>99?),? (?P<Y>9999)",
]
_TIME = r"(?P<h>99?):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?"
_BASIC = r"(?P<h>99)(?P<m>99)(?:(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?"
_ZONE = r"(?: ?(?P<p>aa)(?!a))?(?: ?(?P<o>[-+]99(?::?99)?)| ?(?P<z>a{1,5}))?(?: ?\[(?P<id>[^\]]+)\])?"
_SHAPES = [
    re.compile(f"{date}(?:(?P<t>a)|,? (?P<at>aa )?){_BASIC if k == 1 else _TIME}{_ZONE}") for k, date in enumerate(_DATES)
]
_NUMBER = re.compile(r"(?P<i>9{9,19})(?:\.(?P<f>9{1,9}))?")

US = 1_000_000
#: Seconds since 1970 of 2001, and of the years between which plain numbers are looked for by default.
EPOCH_2001, EARLIEST, LATEST = 978_307_200, 1_577_836_800, 1_798_761_600

#: What a stamp came to.
STATUSES = ["read", "empty", "unreadable", "no zone", "twice or never", "outside the zone tables"]
READ, EMPTY, UNREADABLE, NO_ZONE, AMBIGUOUS, OUTSIDE = range(len(STATUSES))

MONTH_FIRST = {"en_US", "en_PH", "en_FM", "en_PW", "en_UM", "en_AS", "en_GU"}
YEAR_FIRST = {"ja", "zh", "ko", "sv", "hu", "lt", "mn", "fa"}


def day_month_order(locale: str | None) -> int:
    """1 for month first, 0 for day first, -1 where the locale doesn't tell."""
    if not locale:
        return -1
    name = locale.replace("-", "_").split(".")[0]
    if name in MONTH_FIRST:
        return 1
    return -1 if name == "en" or name.split("_")[0] in YEAR_FIRST else 0


def mask_of(text: str) -> str:
    mask = text.translate(_TABLE)
    return mask if mask.isascii() else "".join("a" if c.isalpha() else c for c in mask)


def parser(mask: str) -> re.Match | None:
    """The fields of a mask by position, or None for a mask that is no stamp."""
    for shape in (_NUMBER, *_SHAPES):
        if m := shape.fullmatch(mask):
            return m
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970, and whether the date exists."""
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    begin = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    length = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - begin
    return begin + d - 1, ok & (d <= length)


class Stamps:
    """Reads columns of stamps with the zones, locales and tables given."""

    def __init__(self, tables: ZoneTables, numbers: tuple[int, int] = (EARLIEST, LATEST)) -> None:
        self.tables, self.numbers = tables, numbers
        self.parsers: dict[str, re.Match] = {}  # of masks that are stamps; how many there are is bound by the shapes

    def read(self, texts: list[str | None], orders: np.ndarray, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Instants in microseconds, and the status of each (see STATUSES): READ if the stamp denotes exactly one.

        ``orders`` as of ``day_month_order``; ``zones`` holds the name of a zone that exists, or None, for stamps
        without a zone of their own.
        """
        out, status = np.zeros(len(texts), np.int64), np.full(len(texts), UNREADABLE, np.int8)
        groups: dict[str, list[int]] = {}
        clean: list[str] = []
        for i, text in enumerate(texts):
            if not text or len(text) <= LONGEST and not text.strip():
                status[i] = EMPTY
            text = text.strip().translate(_SPACES) if text and len(text) <= LONGEST else ""
            clean.append(text)
            if text:
                groups.setdefault(mask_of(text), []).append(i)
        for mask, rows in groups.items():
            plan = self.parsers.get(mask) or parser(mask)
            if plan is None:
                continue
            self.parsers[mask] = plan
            at = np.array(rows)
            chars = np.array([clean[i] for i in rows], dtype=f"U{len(mask)}").view(np.uint32).reshape(len(rows), len(mask))
            out[at], status[at] = self._convert(plan, chars, orders[at], zones[at])
        return out, status

    def _convert(self, plan: re.Match, chars: np.ndarray, orders: np.ndarray, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = plan.groupdict()
        n = len(chars)

        def number(name: str) -> np.ndarray:
            if found.get(name) is None:
                return np.zeros(n, np.int64)
            a, b = plan.span(name)
            return (chars[:, a:b].astype(np.int64) - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

        def words(name: str) -> np.ndarray:
            a, b = plan.span(name)
            return np.ascontiguousarray(chars[:, a:b]).view(f"U{b - a}").ravel()

        def looked_up(name: str, table: dict, missing: int) -> np.ndarray:
            values, where = np.unique(words(name), return_inverse=True)
            return np.array([table.get(str(v), missing) for v in values], np.int64)[where]

        fraction = np.zeros(n, np.int64)
        if found.get("f") is not None:
            a, b = plan.span("f")
            fraction = number("f") * 10 ** (6 - (b - a)) if b - a <= 6 else number("f") // 10 ** (b - a - 6)
        if "i" in found:
            return self._plain(number("i"), fraction, found["f"] is not None)

        good = np.ones(n, bool)
        year, month, day = number("Y"), number("M"), number("D")
        if found.get("A") is not None:
            a, b = number("A"), number("B")
            only_md, only_dm = (b > 12) & (a <= 12), (a > 12) & (b <= 12)
            month_first = (orders == 1) | (orders == -1) & only_md
            good &= (orders != -1) | only_md | only_dm | (a == b)
            month, day = np.where(month_first, a, b), np.where(month_first, b, a)
        elif found.get("N") is not None:
            values, where = np.unique(words("N"), return_inverse=True)
            month = np.array([MONTH_NUMBERS.get(v.lower(), 0) for v in map(str, values)])[where]
        if found.get("t") is not None:
            good &= np.isin(words("t"), ["T", "t"])
        if found.get("at") is not None:
            good &= words("at") == "at "
        days, exists = _days(year, month, day)
        hour, minute, second = number("h"), number("m"), number("s")
        good &= exists & (hour <= 23) & (minute <= 59) & (second <= 59)

        own = np.full(n, False)
        offset = np.zeros(n, np.int64)
        for name in ("p", "z"):
            if found.get(name) is None:
                continue
            values = np.char.upper(words(name))
            half = np.isin(values, ["AM", "PM"]) if name == "p" else np.zeros(n, bool)
            good &= ~half | (hour >= 1) & (hour <= 12)
            hour = np.where(half, hour % 12 + 12 * (values == "PM"), hour)
            distinct, where = np.unique(values, return_inverse=True)
            seconds = np.array([round(ABBREVIATIONS[v] * 3600) if v in ABBREVIATIONS else -1 for v in map(str, distinct)], np.int64)[where]
            known = np.array([v in ABBREVIATIONS for v in map(str, distinct)])[where]
            good &= half | known
            own |= known & ~half
            offset = np.where(known & ~half, seconds, offset)
        if found.get("o") is not None:
            a, b = plan.span("o")
            digits = [k for k in range(a + 1, b) if plan.string[k] == "9"]
            v = chars[:, digits].astype(np.int64) - 48
            hours, minutes = v[:, 0] * 10 + v[:, 1], (v[:, 2] * 10 + v[:, 3] if len(digits) == 4 else np.zeros(n, np.int64))
            good &= (hours <= 18) & (minutes <= 59)
            offset = np.where(chars[:, a] == ord("-"), -1, 1) * (hours * 3600 + minutes * 60)
            own[:] = True
        wall = (days * 86400 + hour * 3600 + minute * 60 + second) * US + fraction
        out = wall - offset * US

        names = zones
        if found.get("id") is not None:
            inner = words("id")
            names = np.array([v if v in self.tables.zones else None for v in inner], object)
        status = np.where(good, READ, UNREADABLE).astype(np.int8)
        need = good & ~own
        if need.any():
            status[need] = NO_ZONE
            for zone in {z for z in names[need] if z is not None}:
                rows = np.flatnonzero(need & (names == zone))
                instants, count = wall_to_utc(wall[rows], self.tables.zones[zone])
                inside = (instants >= self.tables.first * US) & (instants < self.tables.last * US)
                out[rows], status[rows] = instants, np.where(count != 1, AMBIGUOUS, np.where(inside, READ, OUTSIDE))
        return out, status

    def _plain(self, whole: np.ndarray, fraction: np.ndarray, broken: bool) -> tuple[np.ndarray, np.ndarray]:
        """Counts since 1970 in s, ms, us or ns, or seconds since 2001: what lies between the two instants of ``numbers``."""
        out, good = np.zeros(len(whole), np.int64), np.zeros(len(whole), bool)
        earliest, latest = self.numbers
        for per_s, epoch in ((1, 0), (1, EPOCH_2001), (1000, 0), (US, 0), (1000 * US, 0)):
            seconds = whole // per_s + epoch
            holds = (seconds >= earliest) & (seconds < latest)
            if per_s == 1:
                us = (whole + epoch) * US + fraction
            elif per_s <= US:
                us = whole * (US // per_s) + (fraction * (US // per_s) // US if broken else 0)
            else:
                us = whole // (per_s // US)
            out, good = np.where(holds, us, out), good | holds
        return out, np.where(good, READ, UNREADABLE).astype(np.int8)
