from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from quillrock.operators.timestamps import normalise_timestamps, zone_segments


def us(*a, tz=timezone.utc):
    return int(datetime(*a, tzinfo=tz).timestamp() * 1_000_000)


CASES = [
    ("Wed,  6 Jan 1999 18:10:17 -0700 (EST)", 1, us(1999, 1, 7, 1, 10, 17)),
    ("10-JAN-1999 10:17:34", 1, us(1999, 1, 10, 16, 17, 34)),
    ("1999-09-17T14:30:06.837", 1, us(1999, 9, 17, 19, 30, 6, 837000)),
    ("2001-10-10T10:32:33.800427+00:00", 1, us(2001, 10, 10, 10, 32, 33, 800427)),
    ("20010522181401", 2, us(2001, 5, 22, 17, 14, 1)),
    ("20020220T071212Z", 2, us(2002, 2, 20, 7, 12, 12)),
    ("Sat, 06 May 2000 14:54:04 CDT", 2, us(2000, 5, 6, 19, 54, 4)),
    ("7/2/00 9:00 pm", 1, us(2000, 7, 3, 2)),
    ("7/2/00 9:00 pm", 2, us(2000, 2, 7, 21)),
    ("24.1.2002 08:01:26", 1, us(2002, 1, 24, 14, 1, 26)),
    ("Fr, 5. März 1999 18:20:44 +0100", 1, us(1999, 3, 5, 17, 20, 44)),
    ("April 7, 2000 12:25 AM", 2, us(2000, 4, 6, 23, 25)),
    ("995487565", 1, 995487565_000_000),
    ("967037530008", 1, 967037530_008_000),
    ("970660279.75", 1, 970660279_750_000),
    ("Thu, 26 Jul 01 16:00:49 -0500\r", 1, us(2001, 7, 26, 21, 0, 49)),
    ("Sun, 29 Oct 2000 01:30:00", 1, us(2000, 10, 29, 6, 30)),  # twice: the earlier
    ("2000-04-02 02:30:00", 1, None),  # skipped by the clock
    ("2000-04-02 02:30:00 -0600", 1, us(2000, 4, 2, 8, 30)),
    ("Thu, 31 Feb 2001 10:15:00 -0600", 1, None),
    ("2001-13-05T08:00:00Z", 1, None),
    ("0000-00-00 00:00:00", 1, None),
    ("2001-09-03", 3, us(2001, 9, 3)),
    ("yesterday", 1, None),
    ("", 1, None),
    (None, 1, None),
    ("1999-01-01 00:00:00", 9, None),  # unknown exporter
    ("1999-01-01 00:00:00 +0000", None, us(1999, 1, 1)),
    ("1999-01-01 00:00:00", 4, None),  # no such zone
]


def test_cases(spark):
    ex = spark.createDataFrame([(1, "a", "America/Chicago", "mdy"), (2, "b", "Europe/London", "dmy"), (3, "c", "UTC", None), (4, "d", "No/Where", "mdy")], "exporter_id int, exporter string, tz string, date_order string")
    rows = spark.createDataFrame([(i, d, e, "clash") for i, (d, e, _) in enumerate(CASES)], "row_id bigint, date string, exporter_id int, tz string")
    got = {r.row_id: r.utc_us for r in normalise_timestamps(rows, ex).collect()}
    assert {i: (d, got.get(i)) for i, (d, _, _) in enumerate(CASES)} == {i: (d, w) for i, (d, _, w) in enumerate(CASES)}


def test_empty(spark):
    ex = spark.createDataFrame([], "exporter_id int, exporter string, tz string, date_order string")
    rows = spark.createDataFrame([], "row_id bigint, date string, exporter_id int")
    assert normalise_timestamps(rows, ex).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "Europe/Berlin", "Australia/Lord_Howe"])
def test_segments_agree_with_the_zone(zone):
    seg = zone_segments([zone], 1995, 2005)
    tz = ZoneInfo(zone)
    for t in range(us(1996, 1, 1) // 10**6, us(2004, 1, 1) // 10**6, 86400 * 3 + 3600 * 5 + 7):
        instant = datetime.fromtimestamp(t, tz)
        local = int(instant.replace(tzinfo=timezone.utc).timestamp()) * 10**6
        hits = [s for s in seg if s[2] <= local < s[3]]
        assert len(hits) == 1 and hits[0][1] == datetime.fromtimestamp(local / 1e6, timezone.utc).year
        both = {instant.replace(fold=f).utcoffset().total_seconds() * 10**6 for f in (0, 1)}
        assert hits[0][4] == max(both) and hits[0][5] == len(both)


def test_years_beyond_the_listed_ones(spark):
    zones = {1: "America/Chicago", 2: "Europe/Berlin", 3: "Australia/Sydney"}
    ex = spark.createDataFrame([(k, "x", z, "mdy") for k, z in zones.items()], "exporter_id int, exporter string, tz string, date_order string")
    at = [(y, m, 17, 13, 5, 9) for y in (500, 1700, 1849, 1850, 2199, 2201, 2499, 2501, 2600, 2999, 9998) for m in (1, 7)]
    rows = [(len(zones) * i + k, k, "{:04}-{:02}-{:02} {:02}:{:02}:{:02}".format(*a)) for i, a in enumerate(at) for k in zones]
    got = {r.row_id: r.utc_us for r in normalise_timestamps(spark.createDataFrame(rows, "row_id bigint, exporter_id int, date string"), ex).collect()}
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    for i, a in enumerate(at):
        for k, z in zones.items():
            d = datetime(*a, tzinfo=ZoneInfo(z)).astimezone(timezone.utc) - epoch
            assert got[len(zones) * i + k] == (d.days * 86_400 + d.seconds) * 1_000_000, (a, z)
