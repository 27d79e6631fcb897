"""Queries over web captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.llm import revisits
from lynceus.llm.catalog import query, table

KEY_SQL = r"""
regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[^/?]*')), ':(80|443)?$', ''), '^www\.', '')
|| regexp_replace(regexp_extract(plain, '^[^/?]*(/[^?]*)?', 1), '/+$', '')
|| coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'),
  lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)='))), '&'), ''), '')"""


def captures(spark, d):
    """A capture log made from the pages: each is fetched in full at one minute of ten and asked for again, 304, at another.

    Some first questions come before any answer; some validators have changed since; some answers have a date only.
    """
    page, n = F.col("page_id"), F.col("page_id") % 7
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html")), 1, 12), F.lit('"'))
    day = F.concat(F.lit("day "), (page % 28).cast("string"))
    full = F.create_map(F.lit("etag"), F.when(n != 3, tag), F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"),
                        F.lit("date"), F.concat(F.lit("minute "), (page * 10).cast("string")), F.lit("cache-control"), F.lit("max-age=60"))
    asked = F.create_map(F.lit("etag"), F.when(n == 1, F.concat(F.lit("W/"), tag)).when(n == 2, F.lit('"other"')).when(n.isin(0, 4, 6), tag),
                         F.lit("last-modified"), F.when(n == 3, day), F.lit("content-type"), F.lit("text/plain"),
                         F.lit("date"), F.concat(F.lit("minute "), (page * 10 + 5).cast("string")), F.lit("cache-control"), F.lit("no-cache"))
    def some(headers):
        return F.map_filter(headers, lambda k, v: v.isNotNull())
    both = F.array(
        F.struct((page * 2).alias("capture_id"), (page * 10).alias("captured_at"), F.lit(200).alias("status"), some(full).alias("headers")),
        F.struct((page * 2 + 1).alias("capture_id"), F.when(n == 6, page * 10 - 5).otherwise(page * 10 + 5).alias("captured_at"),
                 F.lit(304).alias("status"), some(asked).alias("headers")))
    return table(spark, d, "pages").select("url", F.explode(both).alias("c")).select("url", "c.*")


@query("op1_revisits", rf"""
WITH plain AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain,
    '"' || left(md5(html), 12) || '"' AS tag, 'day ' || (page_id % 28) AS day, page_id % 7 AS n FROM pages),
keyed AS (SELECT *, {KEY_SQL} AS key FROM plain),
fulls AS (SELECT key, page_id * 2 AS id, page_id * 10 AS at, CASE WHEN n <> 3 THEN tag END AS etag, day FROM keyed),
asked AS (SELECT key, page_id * 2 + 1 AS id, CASE WHEN n = 6 THEN page_id * 10 - 5 ELSE page_id * 10 + 5 END AS at,
  CASE WHEN n = 1 THEN 'W/' || tag WHEN n = 2 THEN '"other"' WHEN n IN (0, 4, 6) THEN tag END AS etag,
  CASE WHEN n = 3 THEN day END AS day, page_id * 10 + 5 AS minute FROM keyed),
met AS (SELECT a.*, f.id AS full_id, f.at AS full_at, f.etag AS full_etag, f.day AS full_day
  FROM asked a ASOF LEFT JOIN fulls f ON a.key = f.key AND a.at > f.at),
judged AS (SELECT *, CASE WHEN full_id IS NULL THEN 'missing'
  WHEN etag IS NOT NULL AND full_etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = full_etag THEN 'resolved' ELSE 'mismatch' END
  WHEN etag IS NULL AND day IS NOT NULL THEN CASE WHEN day = full_day THEN 'resolved' ELSE 'mismatch' END
  ELSE 'unchecked' END AS outcome FROM met)
SELECT id AS capture_id, key AS url_key, full_id, full_at AS full_time, outcome, CASE WHEN outcome = 'resolved' THEN
  'cache-control: no-cache; content-type: text/html; date: minute ' || minute
  || coalesce('; etag: ' || coalesce(etag, full_etag), '') || '; last-modified: ' || full_day END AS headers FROM judged""")
def resolved_revisits(spark, d):
    rows = revisits.resolve(captures(spark, d))
    lines = F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return rows.select(F.col("id").alias("capture_id"), F.col("key").alias("url_key"), "full_id", "full_time", "outcome",
                       F.when(F.col("merged").isNotNull(), F.array_join(lines, "; ")).alias("headers"))
