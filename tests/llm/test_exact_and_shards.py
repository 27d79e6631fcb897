import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from lynceus.llm import exact_dedup, sharding


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    return sorted((t, max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items())


def check(docs, **options):
    rows = docs.collect()
    found = exact_dedup.mark_copies(docs, **options).collect()
    by_sha = {hashlib.sha256((r["text"] or "").encode()).hexdigest(): r["text"] or "" for r in rows}
    assert len(found) == len(rows)
    assert sorted({(by_sha[r["text_sha256"]], r["keep_id"], r["group_size"]) for r in found}, key=str) == sorted(brute(rows), key=str)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(brute(rows)) and all(r["id"] == r["keep_id"] for r in kept)


def test_copies(documents):
    check(documents)


def test_awkward_rows(awkward):
    check(awkward)
    left = exact_dedup.drop_copies(awkward)
    assert left.columns == awkward.columns and left.count() == len(brute(awkward.collect()))


def test_colliding_hashes_are_told_apart(documents, awkward):
    weak = dict(low=16, high=64, digest=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    check(documents, **weak)
    check(awkward, **weak)


def test_chunks_join_to_the_text(awkward, spark):
    cut = awkward.filter("text IS NOT NULL").select("text", F.array_join(exact_dedup.chunks_of(F.col("text"), 8, 40), "").alias("joined"))
    assert cut.filter("text <> joined").count() == 0
    text = "a word from here to there " * 40
    shifted = spark.createDataFrame([(text,), ("zzz " + text,)], "text string").select(exact_dedup.chunks_of(F.col("text"), 8, 40).alias("c"))
    a, b = (r["c"] for r in shifted.collect())
    assert set(a[2:-2]) <= set(b)


def test_no_rows(nothing):
    assert exact_dedup.mark_copies(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).count() == 0
    assert sharding.shuffled_shards(nothing).count() == 0


def test_permutation_and_inverse(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        rows = spark.range(n).withColumn("to", sharding.permuted("id", n, 7))
        rows = rows.withColumn("shard", F.col("to") % 4).withColumn("slot", F.floor(F.col("to") / 4))
        rows = rows.withColumn("back", sharding.row_of("shard", "slot", n, 4, 7)).collect()
        assert sorted(r["to"] for r in rows) == list(range(n))
        assert all(r["back"] == r["id"] for r in rows)


def test_shards(awkward, documents):
    for docs in (awkward, documents):
        rows = sharding.shuffled_shards(docs, 16, 3).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert len(rows) == docs.count()
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        assert max(map(len, by.values())) - min(len(by[k]) for k in range(16)) <= 1
        texts = [(r["text"] or "").encode() for r in docs.collect()]
        assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len(t) + 1, zlib.crc32(t)) for t in texts)
    again = sharding.shuffled_shards(documents.repartition(5), 16, 3)
    assert {(r["id"], r["shard"], r["slot"]) for r in again.collect()} == {(r["id"], r["shard"], r["slot"]) for r in rows}
