"""Core queries by name, and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillrock.operators import timestamps
from quillrock.operators.deliveries import superseded_deliveries
from quillrock.operators.timestamps import normalise_timestamps
from quillrock.queries import guarding, messages, permissions, reporting, searching
from quillrock.session import table

#: In how many parts, by batch, the deliveries are upserted.
FEED = 3

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return normalise_timestamps(table(spark, sf, "messages"), table(spark, sf, "exporters"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return superseded_deliveries(table(spark, sf, "messages"), FEED)


P3_SQL = r"""
WITH d AS (
  SELECT row_id, lower(regexp_replace(message_id, '[<>\s\p{Z}]+', '', 'g')) AS cid,
         len(list_distinct(list_filter(list_transform(list_concat(coalesce("to", []), coalesce(cc, [])),
           lambda x: lower(regexp_replace(regexp_replace(
             CASE WHEN regexp_matches(x, '<[^<>]*@[^<>]*>') THEN regexp_extract(x, '<([^<>]*@[^<>]*)>', 1) ELSE x END,
             '[<>"''\s\p{Z}]+', '', 'g'), '[.]{2,}', '.', 'g'))), lambda x: contains(x, '@')))) AS n_addr
  FROM messages WHERE message_id IS NOT NULL),
r AS (SELECT row_id, row_number() OVER (PARTITION BY cid ORDER BY n_addr DESC, row_id) AS n FROM d WHERE cid <> '')
SELECT row_id FROM r WHERE n > 1
"""


def _p2_sql() -> str:
    """The shapes of dates are those of the operator; zones are not: of all offsets by quarter hours those
    are kept at which the zone's clock shows the time, which is none where it was skipped and two
    where it came twice."""
    back = r"\\\1"  # a backslash and the number
    canon = " ".join(f"WHEN regexp_matches(s, '{pattern}') THEN regexp_replace(s, '{pattern}', '{re.sub(r'[$]([0-9])', back, put)}')" for pattern, put in timestamps._FAMILIES)
    months = ", ".join(f"('{k}', {v})" for k, v in timestamps.MONTHS.items())
    zones = ", ".join(f"('{k}', {v})" for k, v in timestamps.ABBREVIATIONS.items())
    return rf"""
WITH months(name, number) AS (VALUES {months}), zones(abbr, minutes) AS (VALUES {zones}),
a AS (SELECT row_id, tz, coalesce(date_order, 'mdy') AS ord, trim(regexp_replace(date, '[\s\x{{a0}}]+', ' ', 'g')) AS s FROM messages LEFT JOIN exporters USING (exporter_id) WHERE date IS NOT NULL),
b AS (SELECT row_id, tz, ord, upper(regexp_extract(s, '\(([A-Za-z]{{1,5}})\)$', 1)) AS note, trim(regexp_replace(s, ' ?\([^)]*\)$', '')) AS s FROM a),
c AS (SELECT row_id, tz, ord, note, string_split(CASE {canon} END, '|') AS p FROM b),
d AS (SELECT row_id, tz, note, p[1] AS kind, try_cast(nullif(p[2], '') AS BIGINT) AS y0, length(p[2]) AS ylen, lower(CASE WHEN p[1] = 'N' AND ord = 'dmy' THEN p[4] ELSE p[3] END) AS mo,
  try_cast(nullif(CASE WHEN p[1] = 'N' AND ord = 'dmy' THEN p[3] ELSE p[4] END, '') AS BIGINT) AS day, coalesce(try_cast(nullif(p[5], '') AS BIGINT), 0) AS h0, coalesce(try_cast(nullif(p[6], '') AS BIGINT), 0) AS mi,
  coalesce(try_cast(nullif(p[7], '') AS BIGINT), 0) AS sec, CASE WHEN p[8] = '' THEN 0 ELSE try_cast(rpad(p[8][1:6], 6, '0') AS BIGINT) END AS us, lower(p[9]) AS ap, upper(p[10]) AS zone FROM c WHERE p IS NOT NULL),
e AS (SELECT d.*, CASE WHEN ylen = 2 THEN CASE WHEN y0 < 69 THEN y0 + 2000 ELSE y0 + 1900 END ELSE y0 END AS y, coalesce(try_cast(mo AS BIGINT), months.number) AS m,
  CASE WHEN ap = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN ap = 'p' THEN 12 ELSE 0 END END AS h, regexp_replace(zone, '[^0-9]', '', 'g') AS digits FROM d LEFT JOIN months ON months.name = mo),
f AS (SELECT e.*, try_cast(printf('%04d-%02d-%02d', y, m, day) AS DATE) AS dt,
  CASE WHEN length(digits) = 4 THEN CASE WHEN zone[1:1] = '-' THEN -1 ELSE 1 END * (try_cast(digits[1:2] AS BIGINT) * 60 + try_cast(digits[3:4] AS BIGINT)) ELSE coalesce(z.minutes, n.minutes) END AS off
  FROM e LEFT JOIN zones z ON z.abbr = zone LEFT JOIN zones n ON n.abbr = note),
g AS (SELECT row_id, tz, kind, off, CASE WHEN kind = 'E' THEN y0 * 1000000 + us WHEN kind = 'M' THEN y0 * 1000 END AS instant,
  CASE WHEN kind IN ('D', 'N') AND h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND sec BETWEEN 0 AND 59 THEN epoch_us(dt::TIMESTAMP) + ((h * 60 + mi) * 60 + sec) * 1000000 + us END AS wall FROM f),
w AS (SELECT row_id, min(wall - q * 900000000) AS t FROM g, range(-56, 57) r(q) WHERE instant IS NULL AND off IS NULL AND wall IS NOT NULL AND tz IS NOT NULL
  AND timezone(tz, timezone('UTC', make_timestamp(wall - q * 900000000))) = make_timestamp(wall) GROUP BY row_id)
SELECT row_id, CAST(coalesce(instant, wall - off * 60000000, t) AS BIGINT) AS utc_us FROM g LEFT JOIN w USING (row_id) WHERE coalesce(instant, wall - off * 60000000, t) IS NOT NULL
"""


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p3_found": p3_found} | permissions.QUERIES | messages.QUERIES | searching.QUERIES | guarding.QUERIES | reporting.QUERIES
SQL: dict[str, str] = {"p2_found": _p2_sql(), "p3_found": P3_SQL} | permissions.SQL | messages.SQL | searching.SQL | guarding.SQL | reporting.SQL
FLAGSHIP = "plan_strategy"
