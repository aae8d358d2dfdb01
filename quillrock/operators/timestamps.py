"""Mixed timestamp formats and time zones, made one UTC instant in microseconds.

Parsing is one regular expression per family of shapes, rewritten to a canonical
``y|m|d|h|mi|s|fraction|am/pm|zone`` string, all inside the JVM. A date without zone is the
wall clock of its exporter's zone: an as-of join against the zone's exploded offset
intervals gives the offset. The intervals are cut where they overlap, so a local time falls
into at most one piece: a piece under two offsets is ambiguous, no piece at all means that
the clock skipped it.
"""

from __future__ import annotations

from bisect import bisect_right
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.session import broadcast_if_bounded

DAY_US = 86_400_000_000
#: Years for which offset intervals are listed. Before them a zone has one offset; after them its rule
#: repeats with the calendar, every ``CYCLE`` years, so that any other year is looked up in one of these.
FIRST_YEAR, LAST_YEAR, CYCLE = 1850, 2500, 400
CYCLE_US = 146_097 * DAY_US

#: Month names of the four languages of the mail (English, German, French, Spanish).
MONTHS: dict[str, int] = {
    name: i + 1
    for i, names in enumerate(
        [
            "january jan januar jän jänner janvier janv enero ene",
            "february feb februar février fevrier févr fév fev febrero",
            "march mar märz mär maerz mrz mars marzo",
            "april apr avril avr abril abr",
            "may mai mayo",
            "june jun juni juin junio",
            "july jul juli juillet juil julio",
            "august aug août aout agosto ago",
            "september sep sept septembre septiembre set",
            "october oct oktober okt octobre octubre",
            "november nov novembre noviembre",
            "december dec dezember dez décembre déc decembre diciembre dic",
        ]
    )
    for name in names.split()
}

#: Fixed offsets in minutes of zone abbreviations.
ABBREVIATIONS: dict[str, int] = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150,
    "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780,
}

_TIME = r"(?:[ T]+(?:at )?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?)?"
_ZONE = r"(?: ?([+-]\d{2}:?\d{2}|[A-Za-z]{1,5})?)?"
_WEEKDAY = r"^(?:\p{L}+\.?,? )?"
#: (pattern, replacement): y|month|day|h|mi|s|fraction|am/pm|zone; N marks the all-numeric order.
_FAMILIES = [
    (_WEEKDAY + r"(\d{1,2})\.?[ -](\p{L}+)\.?[ -](\d{4}|\d{2})" + _TIME + _ZONE + "$", "D|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (_WEEKDAY + r"(\p{L}{3,})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _TIME + _ZONE + "$", "D|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (_WEEKDAY + r"(\p{L}{3,}) (\d{1,2}) (\d{1,2}):(\d{2}):(\d{2}) (?:([A-Za-z]{1,5}|[+-]\d{4}) )?(\d{4})$", "D|$7|$1|$2|$3|$4|$5|||$6"),
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})" + _TIME + _ZONE + "$", "D|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _ZONE + "$", "D|$1|$2|$3|$4|$5|$6|$7||$8"),
    (_WEEKDAY + r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2}),?" + _TIME + _ZONE + "$", "N|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (_WEEKDAY + r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2}),?" + _TIME + _ZONE + "$", "D|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{9,10})(?:\.(\d+))?$", "E|$1||||||$2||"),
    (r"^(\d{12,13})$", "M|$1||||||||"),
]


def zone_segments(zones: list[str], first: int = FIRST_YEAR, last: int = LAST_YEAR) -> list[tuple]:
    """``(tz, year, lo_us, hi_us, offset_us, n_offsets)`` of local time, exploded by year.

    ``offset_us`` is the larger one where two hold, which is the earlier instant. Zone names
    that do not exist give no rows.
    """
    out: list[tuple] = []
    known = available_timezones()
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    lo_t = int((datetime(first, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    hi_t = int((datetime(last, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    years = range(first - 1, last + 2)
    starts = {y: int((datetime(y, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) for y in [*years, last + 2]}
    for name in sorted({z for z in zones if z in known}):
        tz = ZoneInfo(name)

        def offset(t: int) -> int:
            return int((epoch + timedelta(seconds=t)).astimezone(tz).utcoffset().total_seconds())

        changes = [(lo_t - 10 * 366 * 86400, offset(lo_t))]
        t = lo_t
        while t < hi_t:
            n = min(t + 6 * 86400, hi_t)
            if (after := offset(n)) != (before := changes[-1][1]):
                a, b = t, n
                while b - a > 1:
                    m = (a + b) // 2
                    a, b = (m, b) if offset(m) == before else (a, m)
                changes.append((b, after))
            t = n
        ends = [c[0] for c in changes[1:]] + [hi_t + 10 * 366 * 86400]
        spans = [(s + o, e + o, o) for (s, o), e in zip(changes, ends)]
        cuts = sorted({x for s, e, _ in spans for x in (s, e)} | set(starts.values()))
        begins = [s for s, _, _ in spans]
        for a, b in zip(cuts, cuts[1:]):
            k = bisect_right(begins, a)
            held = [o for s, e, o in spans[max(0, k - 4) : k + 4] if s <= a and b <= e]
            y = (epoch + timedelta(seconds=a)).year
            if held and first - 1 <= y <= last + 1:
                out.append((name, y, a * 1_000_000, b * 1_000_000, max(held) * 1_000_000, len(held)))
    return out


def zone_intervals(spark: SparkSession, zones: list[str]) -> tuple[DataFrame, int]:
    """The segments of the named zones as a table, with its row count. There are about 600
    zones of at most 2,000 pieces each, whatever the size of the data."""
    rows = zone_segments(zones)
    schema = "tz string, local_year int, lo_us bigint, hi_us bigint, offset_us bigint, n_offsets int"
    return spark.createDataFrame(rows, schema), len(rows)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in whole-number arithmetic."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("bigint")


def _map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def with_parsed_date(df: DataFrame, raw: str, order: str) -> DataFrame:
    """Add ``epoch_us`` (an absolute instant), or ``local_us`` (a wall clock) with ``offset_us``
    where the text gives one; all null where the text is no date.

    The steps are separate projections, so that each value is computed once; no filter stands
    on them, as it would be pushed down with all their expressions expanded.
    """
    df = df.withColumn("__s", F.trim(F.regexp_replace(F.col(raw), r"[\s\u00a0]+", " ")))
    df = df.withColumn("__comment", F.upper(F.regexp_extract("__s", r"\(([A-Za-z]{1,5})\)$", 1)))
    df = df.withColumn("__s", F.trim(F.regexp_replace("__s", r" ?\([^)]*\)$", "")))
    canon = F.coalesce(*[F.when(F.col("__s").rlike(p), F.regexp_replace("__s", p, r)) for p, r in _FAMILIES])
    df = df.withColumn("__p", F.split(canon, r"\|"))
    part = lambda i: F.col("__p")[i]
    num = lambda i: F.nullif(part(i), F.lit("")).try_cast("bigint")
    micros = F.when(part(7) == "", 0).otherwise(F.rpad(F.substring(part(7), 1, 6), 6, "0").try_cast("bigint"))
    dmy = (part(0) == "N") & (F.col(order) == "dmy")
    df = df.select(
        *[c for c in df.columns if c not in ("__s", "__p")],
        part(0).alias("__kind"), num(1).alias("__y"), F.length(part(1)).alias("__ylen"),
        F.lower(F.when(dmy, part(3)).otherwise(part(2))).alias("__mo"), F.when(dmy, num(2)).otherwise(num(3)).alias("__d"),
        F.coalesce(num(4), F.lit(0)).alias("__h"), F.coalesce(num(5), F.lit(0)).alias("__mi"), F.coalesce(num(6), F.lit(0)).alias("__sec"),
        micros.alias("__us"), F.lower(part(8)).alias("__ap"), F.upper(part(9)).alias("__zone"),
    )
    c = {k: F.col(f"__{k}") for k in ("kind", "y", "mo", "d", "h", "mi", "sec", "us", "ap", "zone")}
    digits = F.regexp_replace(c["zone"], "[^0-9]", "")
    df = df.withColumns(
        {
            "__y": F.when(F.col("__ylen") == 2, F.when(c["y"] < 69, c["y"] + 2000).otherwise(c["y"] + 1900)).otherwise(c["y"]),
            "__mo": F.coalesce(c["mo"].try_cast("bigint"), F.try_element_at(_map(MONTHS), c["mo"]).cast("bigint")),
            "__h": F.when(c["ap"] == "", c["h"]).when(c["h"].between(1, 12), c["h"] % 12 + F.when(c["ap"] == "p", 12).otherwise(0)),
            "__digits": digits,
        }
    )
    minutes = F.substring("__digits", 1, 2).try_cast("bigint") * 60 + F.substring("__digits", 3, 2).try_cast("bigint")
    named = lambda x: F.try_element_at(_map(ABBREVIATIONS), x).cast("bigint")
    sign = F.when(F.substring(c["zone"], 1, 1) == "-", -1).otherwise(1)
    leap = ((c["y"] % 4 == 0) & (c["y"] % 100 != 0)) | (c["y"] % 400 == 0)
    df = df.withColumns(
        {
            "__most": F.when(c["mo"] == 2, F.when(leap, 29).otherwise(28)).when(c["mo"].isin(4, 6, 9, 11), 30).otherwise(31),
            "__offset": F.when(F.length("__digits") == 4, sign * minutes).otherwise(F.coalesce(named(c["zone"]), named(F.col("__comment")))),
            "__days": _days(c["y"], c["mo"], c["d"]),
        }
    )
    real = (
        c["mo"].between(1, 12) & (c["d"] >= 1) & (c["d"] <= F.col("__most")) & c["h"].between(0, 23)
        & c["mi"].between(0, 59) & c["sec"].between(0, 59) & (c["y"] >= 1)
    )
    local = ((F.col("__days") * 24 + c["h"]) * 60 + c["mi"]) * 60_000_000 + c["sec"] * 1_000_000 + c["us"]
    epoch = F.when(c["kind"] == "E", c["y"] * 1_000_000 + c["us"]).when(c["kind"] == "M", c["y"] * 1000)
    kept = [x for x in df.columns if x not in {"__comment", "__digits", "__most", "__offset", "__days", "__ylen", *(f"__{k}" for k in c)}]
    return df.select(
        *kept, epoch.alias("epoch_us"), F.when((c["kind"].isin("D", "N")) & real, local).alias("local_us"),
        (F.col("__offset") * 60_000_000).alias("offset_us"),
    )


def normalise_timestamps(
    rows: DataFrame, exporters: DataFrame, date_col: str = "date", exporter_col: str = "exporter_id", id_col: str = "row_id"
) -> DataFrame:
    """``(id_col, utc_us)`` of every row whose ``date_col`` denotes an instant.

    Defined results: a null, empty or useless date, a date that does not exist, and a wall
    clock that its zone skipped give no row. A wall clock that occurred twice is the earlier
    instant. A date without zone whose exporter is null, unknown or has no such zone gives no
    row; where the exporter's order is null an all-numeric date is read month first. A row
    that stands twice comes out twice. Extra columns are not read. Any
    year from 1 to 9999 has its offset: those before the listed ones the zone's first, those after
    them that of the same day a whole number of calendar cycles earlier. Exporters listed twice count once (the smallest zone name).
    """
    spark = rows.sparkSession
    # as many as there are zone names at most
    zones = [r[0] for r in exporters.select("tz").where(F.col("tz").isin(sorted(available_timezones()))).distinct().collect()]
    intervals, n = zone_intervals(spark, zones)
    # One row per exporter; as many as there are exporters, so it is only hinted when counted small.
    ex = exporters.groupBy(F.col("exporter_id").alias("__ex")).agg(
        F.min(F.struct("tz", "date_order")).alias("__e")
    ).select("__ex", F.col("__e.tz").alias("__tz"), F.col("__e.date_order").alias("__order"))
    ex = broadcast_if_bounded(ex, ex.count())
    base = rows.select(F.col(id_col).alias("__id"), F.col(exporter_col).alias("__x"), F.col(date_col).alias("__date"))
    base = base.where(F.col("__date").isNotNull()).join(ex, F.col("__x") == F.col("__ex"), "left")
    base = base.select("__id", "__tz", "__date", F.coalesce("__order", F.lit("mdy")).alias("__order"))
    d = with_parsed_date(base, "__date", "__order").drop("__date", "__order")
    # the wall clock by which the interval is looked up
    first, last = (F.lit(int((datetime(y, 1, 1, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000) for y in (FIRST_YEAR, LAST_YEAR + 1))
    wall = F.when(F.col("epoch_us").isNull() & F.col("offset_us").isNull(), F.col("local_us"))
    over = F.ceil((wall - last + 1) / CYCLE_US).cast("bigint")
    d = d.withColumn("__wall", F.when(wall < first, first - 100 * DAY_US).when(wall >= last, wall - over * CYCLE_US).otherwise(wall))
    d = d.withColumn("__year", F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("__wall") / DAY_US).cast("int"))))
    seg = broadcast_if_bounded(
        intervals.select(F.col("tz").alias("__z"), "local_year", "lo_us", "hi_us", F.col("offset_us").alias("__seg_offset")), n, 600_000
    )
    j = d.join(
        seg,
        (F.col("__tz") == F.col("__z")) & (F.col("__year") == F.col("local_year"))
        & (F.col("__wall") >= F.col("lo_us")) & (F.col("__wall") < F.col("hi_us")),
        "left",
    )
    utc = F.coalesce("epoch_us", F.col("local_us") - F.coalesce("offset_us", "__seg_offset"))
    return j.select(F.col("__id").alias(id_col), utc.alias("utc_us")).where("utc_us is not null")
