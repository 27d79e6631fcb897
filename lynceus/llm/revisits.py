"""Resolution of not-modified captures to the response they confirm.

A capture with status 304 stands for the latest earlier full response of the same
canonical URL.  The two are joined in the order of (URL, time): captures are
range-partitioned on that order, so that a URL with very many captures is cut
into ranges, each range carries its last full response along, and what a
range needs from the ranges before it comes through a table of one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm.rows import addressed, free_name
from lynceus.session import durable

#: Header fields that a 304 response may update (RFC 9110, 15.4.5).  Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

#: Query parameters that name a campaign, not a page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)="


def canonical_url(url: Column) -> Column:
    """Host and path of a URL, without what names the same page: scheme, "www.", port 80 and 443, fragment, tracking, order of parameters.

    Letters of the host are lowered; a trailing slash, and an empty query, go.  Null stays null.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[^/?]*", 0)), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*(/[^?]*)?", 1), r"/+$", "")
    asked = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def weak_tag(tag: Column) -> Column:
    """An entity tag without its mark of weakness: a 304 compares tags weakly."""
    return F.regexp_replace(tag, r"^W/", "")


def _last_full(captures: DataFrame) -> DataFrame:
    """Append ``full``: the latest full response (id, time, headers) of the same ``key`` before the row's own time."""
    order = ["key", "time", "is_full", "row_at"]
    rows = durable(captures.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range_no", F.spark_partition_id()))
    response = F.when(F.col("is_full"), F.struct("id", "time", "headers"))
    # full responses come after the other captures of the same time, so what comes before is earlier
    within = Window.partitionBy("range_no", "key").orderBy("time", "is_full", "row_at")
    met = rows.withColumn("own", F.last(response, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    edge = rows.groupBy("range_no").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    ends = (rows.join(F.broadcast(edge), "range_no").filter(F.col("key") == F.col("last_key")).groupBy("range_no", "key")
            .agg(F.max_by(response, F.when(F.col("is_full"), F.struct("time", "row_at"))).alias("best")))
    asks = edge.select("range_no", F.col("first_key").alias("key"), F.lit(0).alias("turn"), F.lit(None).cast(ends.schema["best"].dataType).alias("best"))
    gives = ends.select("range_no", "key", F.lit(1).alias("turn"), "best")
    before = Window.partitionBy("key").orderBy("range_no", "turn").rowsBetween(Window.unboundedPreceding, -1)
    carried = (asks.unionByName(gives).withColumn("brought", F.last("best", ignorenulls=True).over(before))
               .filter("turn = 0 AND brought IS NOT NULL")
               .select("range_no", "key", "brought"))
    return (met.join(F.broadcast(durable(carried)), ["range_no", "key"], "left")
            .withColumn("full", F.coalesce("own", "brought")).drop("own", "brought", "range_no"))


def resolve(captures: DataFrame, id_col: str = "capture_id", url_col: str = "url", time_col: str = "captured_at",
            status_col: str = "status", headers_col: str = "headers", permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row (id, key, full_id, full_time, outcome, merged) for each capture with status 304.

    ``headers`` is a map with lower-case names.  ``outcome`` is "resolved",
    "mismatch" (a validator differs), "unchecked" (the revisit has no validator, or
    the response lacks its counterpart), or "missing" (no earlier full response,
    or no URL or time).  An entity tag decides alone, compared weakly; only without one do
    dates of last modification decide, which must be equal.  ``full_id`` is the
    candidate, also of a mismatch.  ``merged`` is null unless resolved: the headers of the
    response, with those of the revisit in place of theirs where ``permitted``.
    Statuses other than 200 and 304 play no part.  A full response of the same time is not
    earlier; of several latest ones the last in storage is taken.  Repeated revisits are resolved each for itself.  An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    at = free_name(captures, "row_at")
    rows = addressed(captures, at).filter(F.col(status_col).isin(200, 304)).select(
        F.col(at).alias("row_at"), F.col(id_col).alias("id"), canonical_url(F.col(url_col)).alias("key"),
        F.col(time_col).alias("time"), (F.col(status_col) == 200).alias("is_full"), F.col(headers_col).alias("headers"))
    known = rows.filter(F.col("key").isNotNull() & F.col("time").isNotNull())
    lost = rows.filter((F.col("key").isNull() | F.col("time").isNull()) & ~F.col("is_full"))
    met = _last_full(known).filter(~F.col("is_full"))
    found = met.unionByName(lost.withColumn("full", F.lit(None).cast(met.schema["full"].dataType)))
    tag, full_tag = weak_tag(F.col("headers")["etag"]), weak_tag(F.col("full.headers")["etag"])
    date, full_date = F.col("headers")["last-modified"], F.col("full.headers")["last-modified"]
    outcome = (F.when(F.col("full").isNull(), "missing")
               .when(tag.isNotNull() & full_tag.isNotNull(), F.when(tag == full_tag, "resolved").otherwise("mismatch"))
               .when(tag.isNull() & date.isNotNull() & full_date.isNotNull(), F.when(date == full_date, "resolved").otherwise("mismatch"))
               .otherwise("unchecked"))
    updates = F.map_filter("headers", lambda k, v: k.isin(*permitted))
    merged = F.map_concat(F.map_filter("full.headers", lambda k, v: ~F.map_contains_key(updates, k)), updates)
    return (found.withColumn("outcome", outcome)
            .select("id", "key", F.col("full.id").alias("full_id"), F.col("full.time").alias("full_time"), "outcome",
                    F.when(F.col("outcome") == "resolved", merged).alias("merged")))
