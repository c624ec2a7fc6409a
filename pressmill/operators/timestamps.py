"""Timestamps of many formats and zones as instants in UTC (problem 1).

A value is cut into tokens and every token becomes one character of a shape mask: digits by their number, words by
what they mean (month, weekday, half of the day, zone, connector), signs as they are. A mask is matched once against
the grammar of dates and times, which tells the place of each field; all values of a mask are then converted together
in arrays. Wall clocks pass through zone transition tables that the driver builds once and that carry the version of
the zone data, so all executors use the same ones.

A value without one certain instant gives null: unreadable and relative values, dates that do not exist, and wall
clocks that their zone skips or repeats. 24:00 is the midnight that ends the day.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pressmill.session import spread
from pressmill.sources.sites import SiteRegistry

# Words of dates by meaning; month names by number.
MONTHS = [
    "jan january januar enero janeiro janvier ene janv",
    "feb february februar febrero fevereiro février fev févr",
    "mar march märz marzo março mars mär",
    "apr april abril avril abr avr",
    "may mai mayo maio",
    "jun june juni junio junho juin",
    "jul july juli julio julho juillet juil",
    "aug august agosto août ago",
    "sep september sept septiembre setembro septembre set",
    "oct october oktober octubre outubro octobre okt out",
    "nov november noviembre novembro novembre",
    "dec december dezember diciembre dezembro décembre dez dic déc",
]
MONTH = {name: k + 1 for k, names in enumerate(MONTHS) for name in names.split()}
WEEKDAYS = set(
    """mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday thứ chủ nhật hai ba tư năm sáu bảy
    lunes martes miércoles jueves viernes sábado domingo segunda terça quarta quinta sexta lundi mardi mercredi jeudi vendredi samedi
    dimanche montag dienstag mittwoch donnerstag freitag samstag sonntag""".split()
)
HALVES = {"am": 0, "pm": 12, "a.m.": 0, "p.m.": 12}
CONNECTORS = {"at", "à", "de", "del", "um", "às", "las", "a"}
SINGLE = {"t": "t", "z": "z", "h": "h", "uhr": "u", "gmt": "G", "utc": "G", "ut": "G", "ngày": "g", "tháng": "k", "年": "Y", "月": "O", "日": "D", "時": "H", "分": "I", "秒": "S"}
#: Abbreviations of zones for which the zone data has only numbers, and older ones still in use: seconds east of UTC.
ABBREVIATIONS = {"Asia/Ho_Chi_Minh": {"ICT": 25200}, "Asia/Bangkok": {"ICT": 25200}, "Asia/Singapore": {"SGT": 28800}, "America/Sao_Paulo": {"BRT": -10800, "BRST": -7200}}

_TOKEN = re.compile(r"\d+|[AaPp]\.[Mm]\.|[^\W\d_]+|\s+|.", re.S)
_LETTERS = re.compile(r"^[^\W\d_]")
_BRACKET = re.compile(r"\[[\w/+\-]+\]$")

_CLOCK = r"(?P<H>d):(?P<M>d)(?::(?P<S>d)(?:[.,](?P<F>[dnysbe]))?)?(?: ?(?P<P>p))?(?: u)?|(?P<H2>d)h(?P<M2>d)"
_ZONE = r"(?: ?(?:(?P<z>z)|(?P<g>[+-])(?P<oh>d):?(?P<om>d)?|(?P<g2>[+-])(?P<ohm>y)|(?P<ab>[ZG])|\(G(?P<g3>[+-])(?P<oh3>d)(?::(?P<om3>d))?\)))?"
_JOIN = r"(?:t|,? | - |,? c )"
_DATES = {
    "iso": r"(?P<y>y)([-/])(?P<m>d)\2(?P<d>d)",
    "numeric": r"(?:W+(?: W)?,? )?(?P<a>d)([/.-])(?P<b>d)\3(?P<y>y)",
    "day first": r"(?:W(?: W)?,? )?(?P<d>d)\.? (?:c )?(?P<N>N)\.?,? (?:c )?(?P<y>y)",
    "month first": r"(?:W(?: W)?,? )?(?P<N>N)\.? (?P<d>d),? (?P<y>y)",
}
_GRAMMAR = [
    ("epoch", re.compile(r"(?P<e>e)")),
    ("basic", re.compile(rf"(?P<bd>b)(?:t(?P<bt>s)(?:[.,](?P<F>[dnysbe]))?{_ZONE})?")),
    ("iso", re.compile(r"(?P<y>y)Y(?P<m>d)O(?P<d>d)D(?: ?(?P<H>d)H(?P<M>d)I(?:(?P<S>d)S)?)?")),
    ("iso", re.compile(rf"(?:{_CLOCK}) (?:W W, |W, )?g (?P<d>d) k (?P<m>d) W (?P<y>y)")),
    *[(kind, re.compile(rf"{date}(?:{_JOIN}(?:{_CLOCK}){_ZONE})?")) for kind, date in ((k, v.replace(r"\2", r"[-/]").replace(r"\3", r"[/.-]")) for k, v in _DATES.items())],
]


def tokens_of(value: str) -> list[str]:
    return _TOKEN.findall(value)


def _shape(token: str) -> str:
    if token[0].isdigit():
        n = len(token)
        return "d" if n <= 2 else {4: "y", 6: "s", 8: "b"}.get(n, "e" if n in (9, 10, 13, 16, 19) else "n")
    if token.isspace():
        return " "
    if not (_LETTERS.match(token)):
        return token
    low = token.casefold()
    if low in SINGLE:
        return SINGLE[low]
    if low in HALVES:
        return "p"
    if low in MONTH:
        return "N"
    if low in CONNECTORS:
        return "c"
    if low in WEEKDAYS:
        return "W"
    return "Z" if token.isupper() and 2 <= len(token) <= 5 else "x"


_SHAPES: dict[str, str] = {}


def mask_of(tokens: list[str]) -> str:
    """The shape mask: one character for each token. Words are remembered, digits only by their number."""
    out = []
    for token in tokens:
        if token[0] in "0123456789":
            out.append(_shape(token))
        else:
            s = _SHAPES.get(token)
            if s is None:
                s = _shape(token)
                if len(_SHAPES) < 10_000:
                    _SHAPES[token] = s
            out.append(s)
    return "".join(out)


@lru_cache(maxsize=4096)
def parser_of(mask: str) -> tuple[str, dict[str, int]] | None:
    """Kind of the date and the token of each field; null for a mask that is no timestamp."""
    for kind, pattern in _GRAMMAR:
        if m := pattern.fullmatch(mask):
            return kind, {name: m.start(name) for name, found in m.groupdict().items() if found is not None}
    return None


@dataclass(frozen=True)
class ZoneTable:
    """Transitions of a zone: seconds in UTC, the offsets before, between and after them, and offsets by abbreviation."""

    name: str
    at: np.ndarray
    offset: np.ndarray
    abbreviations: dict[str, int]
    #: seconds between which the table holds, and the version of the zone data it was made from
    span: tuple[int, int] = (-(1 << 62), 1 << 62)
    version: str = ""

    def offset_at(self, utc: np.ndarray) -> np.ndarray:
        return self.offset[np.searchsorted(self.at, utc, "right")]

    def to_utc(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Instants of wall clocks, and whether there is exactly one. Outside the table's span there is none."""
        early, late = wall - self.offset_at(wall - 90_000), wall - self.offset_at(wall + 90_000)
        ok_early, ok_late = (u + self.offset_at(u) == wall for u in (early, late))
        inside = (wall >= self.span[0]) & (wall <= self.span[1])
        return np.where(ok_early, early, late), inside & (ok_early | ok_late) & ~(ok_early & ok_late & (early != late))


def zone_version() -> str:
    """Version of the zone data in use."""
    for folder in TZPATH:
        for name, skip in (("tzdata.zi", "# version "), ("+VERSION", "")):
            path = Path(folder, name)
            if path.exists():
                return path.read_text(errors="replace").split("\n", 1)[0].removeprefix(skip).strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=512)
def zone_table(name: str, first: int = 1900, last: int = 2200, fine: tuple[int, int] = (1970, 2038)) -> ZoneTable | None:
    """Built by bisection from the zone data; null for an unknown zone.

    Within ``fine`` offsets that hold for two days are found, before and after it those that hold for ten. Wall clocks
    before ``first`` or after ``last`` have no instant.
    """
    try:
        zone = ZoneInfo(name)
    except Exception:  # unknown names raise several kinds
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    abbreviations = dict(ABBREVIATIONS.get(name, {}))

    def offset(t: int) -> int:
        local = (epoch + timedelta(seconds=t)).astimezone(zone)
        label = local.tzname()
        if label and label.isalpha():
            abbreviations[label] = int(local.utcoffset().total_seconds())
        return int(local.utcoffset().total_seconds())

    begin, low_fine, high_fine, end = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) for y in (first, *fine, last))
    t = begin
    at, offsets = [], [offset(t)]
    while t < end:
        step = (2 if low_fine <= t < high_fine else 10) * 86400
        now = offset(t + step)
        if now != offsets[-1]:
            low, high = t, t + step
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            at.append(high)
            offsets.append(now)
        t += step
    return ZoneTable(name, np.array(at, np.int64), np.array(offsets, np.int64), abbreviations, (begin + 86400, end - 86400), zone_version())


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01, and whether the date exists."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    good = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    mm = np.where(good, m, 1)
    good &= d <= length[mm] + (leap & (mm == 2))
    shifted = y - (mm <= 2)
    era = shifted // 400
    yoe = shifted - era * 400
    doy = (153 * (mm + np.where(mm > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468, good


def convert(values: list[str | None], zones: list[str | None], month_first: list[bool], tables: dict[str, ZoneTable]) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 in UTC and whether each value denotes one instant; all values of a mask at once."""
    n = len(values)
    out, good = np.zeros(n, np.int64), np.zeros(n, bool)
    groups: dict[str, tuple[list[int], list[list[str]]]] = defaultdict(lambda: ([], []))
    for i, value in enumerate(values):
        if value and (value := _BRACKET.sub("", value.strip())):
            tokens = tokens_of(value)
            rows, parts = groups[mask_of(tokens)]
            rows.append(i)
            parts.append(tokens)
    zone_of = np.array([z or "" for z in zones], object)
    first = np.array(month_first, bool)
    for mask, (rows, parts) in groups.items():
        if found := parser_of(mask):
            at = np.array(rows)
            us, ok = _convert_mask(found, parts, zone_of[at], first[at], tables)
            out[at], good[at] = us, ok
    return out, good


def _convert_mask(found: tuple[str, dict[str, int]], parts: list[list[str]], zone: np.ndarray, month_first: np.ndarray, tables: dict[str, ZoneTable]) -> tuple[np.ndarray, np.ndarray]:
    kind, field = found
    n = len(parts)

    def texts(name: str) -> list[str]:
        k = field[name]
        return [p[k] for p in parts]

    def numbers(*names: str) -> np.ndarray:
        for name in names:
            if name in field:
                return np.array(texts(name), dtype=object).astype(np.int64)
        return np.zeros(n, np.int64)

    if kind == "epoch":
        raw = texts("e")
        scale = {9: 1_000_000, 10: 1_000_000, 13: 1_000, 16: 1}
        size = len(raw[0])
        return np.array([int(r) * scale[len(r)] if len(r) in scale else int(r) // 1000 for r in raw], np.int64), np.full(n, size > 0)
    if kind == "basic":
        date = numbers("bd")
        y, m, d = date // 10000, date // 100 % 100, date % 100
        clock = numbers("bt")
        hour, minute, second = clock // 10000, clock // 100 % 100, clock % 100
        timed = "bt" in field
    else:
        y = numbers("y")
        if kind == "numeric":
            a, b = numbers("a"), numbers("b")
            m, d = np.where(month_first, a, b), np.where(month_first, b, a)
        elif "N" in field:
            m, d = np.array([MONTH[t.casefold()] for t in texts("N")], np.int64), numbers("d")
        else:
            m, d = numbers("m"), numbers("d")
        hour, minute, second = numbers("H", "H2"), numbers("M", "M2"), numbers("S")
        timed = "H" in field or "H2" in field
    days, ok = days_from_civil(y, m, d)
    if "P" in field:
        half = np.array([HALVES[t.casefold()] for t in texts("P")], np.int64)
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    ok &= ((hour <= 23) | ((hour == 24) & (minute == 0) & (second == 0) & ("P" not in field))) & (minute <= 59) & (second <= 59)
    fraction = np.array([int((t + "000000")[:6]) for t in texts("F")], np.int64) if "F" in field else np.zeros(n, np.int64)
    wall = days * 86400 + hour * 3600 + minute * 60 + second
    utc = wall.copy()
    if not timed or not any(name in field for name in ("z", "oh", "ohm", "ab", "oh3")):
        for name in set(zone.tolist()):
            own = zone == name
            table = tables.get(name)
            if table is None:
                ok &= ~own
            else:
                utc[own], one = table.to_utc(wall[own])
                ok[own] &= one
    elif "ab" in field:
        labels = [t.upper() for t in texts("ab")]
        for label, name in set(zip(labels, zone.tolist())):
            own = (zone == name) & np.array([x == label for x in labels])
            table = tables.get(name)
            if label in ("GMT", "UTC", "UT"):
                continue
            if table is None or label not in table.abbreviations:
                ok &= ~own
                continue
            utc[own] = wall[own] - table.abbreviations[label]
            # a wall clock that the zone skips carries an abbreviation that is not in force then
            ok[own] &= table.offset_at(utc[own]) == table.abbreviations[label]
    elif "z" not in field:
        sign = np.array([-1 if t == "-" else 1 for t in texts(next(k for k in ("g", "g2", "g3") if k in field))], np.int64)
        joined = numbers("ohm")
        oh, om = (joined // 100, joined % 100) if "ohm" in field else (numbers("oh", "oh3"), numbers("om", "om3"))
        ok &= (oh <= 15) & (om <= 59)
        utc = wall - sign * (oh * 3600 + om * 60)
    return utc * 1_000_000 + fraction, ok


SCHEMA = "field_name string, rec_id long, utc_us long, zone_version string"


def normalize_timestamps(values: DataFrame, sites: SiteRegistry) -> DataFrame:
    """(field_name, rec_id, utc_us, zone_version) of the values that denote one instant; the version is that of the zone data used.

    values has field_name, rec_id, value, domain and url; other columns are ignored. The zone and the order of numeric
    dates are those of the site of ``domain``, or of ``url`` where domain is null. Without a site, values that carry
    their zone still count. Null and empty values give no row, repeated rows a row each.
    """
    zones = {s: (v.get("site_timezone"), v.get("og_locale") == "en_US") for s, v in sites.sites.items()}
    tables = {name: t for name in {z for z, _ in zones.values() if z} if (t := zone_table(name))}
    # the tables made here are the ones all tasks use, whatever zone data their machines have
    shared = values.sparkSession.sparkContext.broadcast((zones, tables, zone_version()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_site, by_zone, version = shared.value
        for batch in batches:
            domains, urls = batch.column("domain").to_pylist(), batch.column("url").to_pylist()
            at = [by_site.get(sites.of_host(d) if d else sites.of_url(u), (None, False)) for d, u in zip(domains, urls)]
            us, ok = convert(batch.column("value").to_pylist(), [z for z, _ in at], [f for _, f in at], by_zone)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("field_name").filter(keep), batch.column("rec_id").cast(pa.int64()).filter(keep), pa.array(us[ok]), pa.array([version] * int(ok.sum()), pa.string())], ["field_name", "rec_id", "utc_us", "zone_version"])

    return spread(values.select("field_name", "rec_id", "value", "domain", "url").where("value is not null"), "rec_id").mapInArrow(run, SCHEMA)
