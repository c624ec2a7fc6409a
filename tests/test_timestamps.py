from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from pressmill.operators.timestamps import ABBREVIATIONS, convert, days_from_civil, mask_of, normalize_timestamps, parser_of, tokens_of, zone_table
from pressmill.sources.sites import SiteRegistry

ZONES = ("America/New_York", "Europe/London", "Asia/Ho_Chi_Minh", "Australia/Sydney", "Asia/Kolkata", "Europe/Berlin", "Etc/UTC", "Asia/Tokyo")
TABLES = {z: zone_table(z) for z in ZONES}


def us(*parts, zone=timezone.utc):
    return int((datetime(*parts, tzinfo=zone) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


NY, BERLIN, HCM = ZoneInfo("America/New_York"), ZoneInfo("Europe/Berlin"), ZoneInfo("Asia/Ho_Chi_Minh")
CASES = [
    ("2023-11-05T06:30:00Z", "Europe/Berlin", False, us(2023, 11, 5, 6, 30)),
    ("\t2023-02-12t01:42:06+07:00 ", None, False, us(2023, 2, 11, 18, 42, 6)),
    ("2023-01-10T20:37:47.069340+0900", None, False, us(2023, 1, 10, 11, 37, 47, 69340)),
    ("2022-10-09T19:08:43.964442389Z", None, False, us(2022, 10, 9, 19, 8, 43, 964442)),
    ("2023-12-18T13:06:21+01:00[Europe/Berlin]", None, False, us(2023, 12, 18, 12, 6, 21)),
    ("20220704T061752Z", None, False, us(2022, 7, 4, 6, 17, 52)),
    ("1665571039", None, False, 1665571039 * 10**6),
    ("1671031068739", None, False, 1671031068739 * 1000),
    ("2022-06-13T24:00:00Z", None, False, us(2022, 6, 14)),
    ("03/04/2023 10:00:00", "America/New_York", True, us(2023, 3, 4, 10, zone=NY)),
    ("03/04/2023 10:00:00", "Europe/Berlin", False, us(2023, 4, 3, 10, zone=BERLIN)),
    ("13/04/2023 10:00", "America/New_York", True, None),
    ("19.10.2023 17:42", "Europe/Berlin", False, us(2023, 10, 19, 17, 42, zone=BERLIN)),
    ("2023-03-12 02:30", "America/New_York", True, None),
    ("2023-11-05 01:30", "America/New_York", True, None),
    ("2023-11-05 01:30:00 -0500", "America/New_York", True, us(2023, 11, 5, 6, 30)),
    ("Sun, 05 Nov 2023 01:30:00 EST", "America/New_York", True, us(2023, 11, 5, 6, 30)),
    ("Sun, 05 Nov 2023 01:30:00 EDT", "America/New_York", True, us(2023, 11, 5, 5, 30)),
    ("Sun, 05 Nov 2023 01:30:00 JST", "America/New_York", True, None),
    ("Fri, 01 Dec 2023 00:06:33 ICT", "Asia/Ho_Chi_Minh", False, us(2023, 11, 30, 17, 6, 33)),
    ("Fri, 1 Dec 2023 00:06:33 GMT", "Asia/Tokyo", False, us(2023, 12, 1, 0, 6, 33)),
    ("Apr 12, 2023 12:19 AM", "Europe/London", False, us(2023, 4, 11, 23, 19)),
    ("April 11, 2023 at 8:11 p.m. AEST", "Australia/Sydney", False, us(2023, 4, 11, 10, 11)),
    ("01 Aug 2023 01:10", "Etc/UTC", False, us(2023, 8, 1, 1, 10)),
    ("Chủ Nhật, 01/10/2023 - 00:14 (GMT+7)", "Asia/Ho_Chi_Minh", False, us(2023, 9, 30, 17, 14)),
    ("10/10/2023, 01:22 (GMT+7)", "Asia/Ho_Chi_Minh", False, us(2023, 10, 9, 18, 22)),
    ("00:05 ngày 5 tháng 12 năm 2023", "Asia/Ho_Chi_Minh", False, us(2023, 12, 5, 0, 5, zone=HCM)),
    ("10 de agosto de 2023, 14:03", "Europe/Berlin", False, us(2023, 8, 10, 14, 3, zone=BERLIN)),
    ("12 décembre 2023 à 10h22", "Europe/Berlin", False, us(2023, 12, 12, 10, 22, zone=BERLIN)),
    ("28. Dezember 2023, 00:33 Uhr", "Europe/Berlin", False, us(2023, 12, 28, 0, 33, zone=BERLIN)),
    ("2023年12月5日 9時02分", "Asia/Tokyo", False, us(2023, 12, 5, 0, 2)),
    ("2023-11-05", "America/New_York", True, us(2023, 11, 5, 4)),
    ("2022/10/21", "Asia/Kolkata", False, us(2022, 10, 20, 18, 30)),
    *[(v, "Europe/Berlin", False, None) for v in ("", " ", "-", "N/A", "TBD", "yesterday", "1 hour ago", "0000-00-00 00:00:00", "2025-02-30T10:00:00Z", "2023-02-29", "25:61 2024-05-05", "31/31/2025 10:00", "2024", "hôm qua", "x" * 100_000, "2023-01-01T10:60:00Z", None)],
    ("2023-06-01 10:00", None, False, None),
]


def test_values():
    values, zones, first, want = (list(x) for x in zip(*CASES))
    got, ok = convert(values, zones, first, TABLES)
    for value, g, o, w in zip(values, got, ok, want):
        assert (int(g) if o else None) == w, value


@pytest.mark.parametrize("zone", ZONES)
def test_wall_clocks_equal_the_zone_data(zone):
    rng = np.random.default_rng(4)
    z, table = ZoneInfo(zone), TABLES[zone]
    near = np.concatenate([table.at[(table.at > 1.5e9) & (table.at < 1.9e9)], [1.6e9]]).astype(np.int64)
    walls = rng.choice(near, 3000) + rng.integers(-4, 18, 3000) * 1800 + rng.integers(-20, 20, 3000) * 3600
    got, one = table.to_utc(walls)
    for wall, u, ok in zip(walls.tolist(), got.tolist(), one.tolist()):
        naive = datetime(1970, 1, 1) + timedelta(seconds=wall)
        found = {int(t.timestamp()) for fold in (0, 1) if (t := naive.replace(tzinfo=z, fold=fold)).astimezone(timezone.utc).astimezone(z).replace(tzinfo=None) == naive}
        assert ok == (len(found) == 1)
        assert not ok or found == {u}


def test_masks():
    assert mask_of(tokens_of("Fri, 01 Dec 2023 00:06:33 ICT")) == "W, d N y d:d:d Z"
    assert mask_of(tokens_of("2023-01-02")) == mask_of(tokens_of("1999-12-31"))
    assert parser_of("x x") is None
    assert zone_table("No/Where") is None and ABBREVIATIONS["Asia/Ho_Chi_Minh"]["ICT"] == 25200


def test_civil_days():
    days, ok = days_from_civil(np.array([1970, 2000, 2023, 1900]), np.array([1, 2, 2, 2]), np.array([1, 29, 29, 29]))
    assert days[:2].tolist() == [0, 11016] and ok.tolist() == [True, True, False, False]


def test_table(spark):
    sites = SiteRegistry({"a.example": {"site_timezone": "America/New_York", "og_locale": "en_US"}, "b.example": {"site_timezone": "Europe/Berlin", "og_locale": "de_DE"}})
    rows = [
        ("lastmod", 1, "03/04/2023 10:00", "www.a.example", None), ("lastmod", 2, "03/04/2023 10:00", None, "https://m.b.example/x"), ("lastmod", 3, None, "a.example", None), ("lastmod", 4, "03/04/2023 10:00", None, None),
        ("lastmod", 5, "2023-01-01T00:00:00Z", None, None), ("lastmod", 5, "2023-01-01T00:00:00Z", None, None), (None, None, "2023-01-01T00:00:00Z", "b.example", None),
    ]
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], "field_name string, rec_id long, value string, domain string, url string, utc_us long, mask string")
    got = sorted(((r.field_name, r.rec_id, r.utc_us) for r in normalize_timestamps(df, sites).collect()), key=str)
    new_year = us(2023, 1, 1)
    assert got == sorted([("lastmod", 1, us(2023, 3, 4, 10, zone=NY)), ("lastmod", 2, us(2023, 4, 3, 10, zone=BERLIN)), ("lastmod", 5, new_year), ("lastmod", 5, new_year), (None, None, new_year)], key=str)
    assert normalize_timestamps(df.limit(0), sites).count() == 0


def test_zone_tables_reach_before_1970_and_after_2100():
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    from pressmill.operators.timestamps import convert, zone_table, zone_version

    tables = {"America/New_York": zone_table("America/New_York")}
    values = ["1965-06-01T00:00:00", "2110-07-01T00:00:00", "1850-01-01T00:00:00", "2300-01-01T00:00:00", " " * 300 + "2020-01-01T00:00:00Z"]
    us, ok = convert(values, ["America/New_York"] * 5, [False] * 5, tables)
    assert ok.tolist() == [True, True, False, False, True]
    for k in (0, 1):
        assert us[k] == int(datetime.fromisoformat(values[k]).replace(tzinfo=ZoneInfo("America/New_York")).astimezone(timezone.utc).timestamp()) * 1_000_000
    assert tables["America/New_York"].version == zone_version()
