from collections import Counter

from pyspark.sql import functions as F

from lynceus.llm import revisits

SCHEMA = "capture_id long, url string, captured_at long, status int, headers map<string,string>, row_at string, key string, full string"


def frame(spark, rows):
    return spark.createDataFrame([r + ("x", "y", "z") for r in rows], SCHEMA)


def test_canonical_url(spark):
    same = ["http://www.Ex.com/a/?utm_source=x&b=2&a=1#top", "HTTPS://ex.com:443/a?a=1&b=2", " ex.com/a/?b=2&a=1&ref=q "]
    rows = spark.createDataFrame([(u,) for u in same + [None, "", "http://ex.com/A"]], "url string")
    keys = [r["k"] for r in rows.select(revisits.canonical_url(F.col("url")).alias("k")).collect()]
    assert set(keys[:3]) == {"ex.com/a?a=1&b=2"} and keys[3:] == [None, "", "ex.com/A"]


def test_outcomes(spark):
    full = {"etag": '"1"', "last-modified": "d1", "content-type": "text/html", "date": "d1"}
    rows = frame(spark, [
        (1, "http://a.com/", 10, 200, full),
        (2, "https://www.a.com", 20, 304, {"etag": 'W/"1"', "date": "d2", "content-type": "no"}),
        (3, "http://a.com/", 10, 304, {"etag": '"1"'}), (4, "http://a.com/", 20, 304, {"etag": '"2"'}),
        (5, "http://a.com/", 20, 304, {"last-modified": "d1"}), (6, "http://a.com/", 20, 304, {"last-modified": "d0"}),
        (7, "http://a.com/", 20, 304, {}), (8, "http://a.com/", 20, 304, None), (9, None, 20, 304, full), (10, "http://a.com/", None, 304, full),
        (11, "http://a.com/", 15, 404, full), (12, "http://a.com/", 20, None, full), (13, "http://b.com/", 30, 304, {"etag": '"1"'}),
        (2, "https://www.a.com", 20, 304, {"etag": 'W/"1"', "date": "d2", "content-type": "no"}),
        (14, "http://c.com/", 1, 200, None), (15, "http://c.com/", 2, 304, full)])
    found = revisits.resolve(rows).collect()
    assert Counter((r["id"], r["full_id"], r["outcome"]) for r in found) == Counter({
        (2, 1, "resolved"): 2, (3, None, "missing"): 1, (4, 1, "mismatch"): 1, (5, 1, "resolved"): 1, (6, 1, "mismatch"): 1,
        (7, 1, "unchecked"): 1, (8, 1, "unchecked"): 1, (9, None, "missing"): 1, (10, None, "missing"): 1, (13, None, "missing"): 1,
        (15, 14, "unchecked"): 1})
    merged = next(r["merged"] for r in found if r["id"] == 2)
    assert merged == {"etag": 'W/"1"', "last-modified": "d1", "content-type": "text/html", "date": "d2"}
    assert revisits.resolve(rows.limit(0)).count() == 0


def test_one_url_over_many_ranges(spark):
    """One address holds nearly all captures; answers are rare, so that ranges lie between a revisit and its answer."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "http://hot.com/", i, 200 if i % 300 == 5 else 304, {"etag": '"1"'}) for i in range(1200)]
        rows += [(5000 + i, f"http://u{i % 7}.com/", i, 200 if i % 11 == 0 else 304, {"etag": '"1"'}) for i in range(100)]
        found = {r["id"]: r["full_id"] for r in revisits.resolve(frame(spark, rows)).collect()}
        for i, url, at, status, _ in rows:
            if status == 304:
                before = [r[0] for r in rows if r[1] == url and r[3] == 200 and r[2] < at]
                assert found[i] == (before[-1] if before else None)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
