"""Queries over whole documents whose results SQL can state: shards and exact copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.llm import exact_dedup, sharding
from lynceus.llm.catalog import query, table

SHARDS, SEED = 16, 20240607


def _feistel_sql() -> str:
    """Rounds as nested selects over (row_no, n, a, b, l, r); a recursive step walks on while the number is outside."""
    def rounds(source: str) -> str:
        for i, k in enumerate(sharding.round_keys(SEED)):
            moved = (f"(l + {sharding.mixed('r', k)}) % a AS l, r" if i % 2 == 0
                     else f"l, (r + {sharding.mixed('l', k)}) % b AS r")
            source = f"SELECT row_no, n, a, b, {moved} FROM ({source})"
        return f"SELECT row_no, n, a, b, l * b + r AS x FROM ({source})"

    split = "SELECT row_no, n, a, b, x // b AS l, x % b AS r FROM"
    return (f"walk AS ({rounds(f'{split} (SELECT *, row_no AS x FROM numbered)')} UNION ALL "
            f"{rounds(f'{split} walk WHERE x >= n')})")


@query("op7_feistel_shards", f"""
WITH RECURSIVE bits AS (SELECT i AS k, i AS v, 0 AS step FROM range(256) t(i) UNION ALL
  SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY k) AS tab FROM bits WHERE step = 8),
docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(coalesce(text, '')))),
    lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM documents, crc),
numbered AS (SELECT row_number() OVER (ORDER BY doc_id, text_crc32) - 1 AS row_no, count(*) OVER () AS n,
  ceil(sqrt(count(*) OVER ()))::BIGINT AS a, ceil(count(*) OVER () / ceil(sqrt(count(*) OVER ())))::BIGINT AS b FROM docs),
{_feistel_sql()},
placed AS (SELECT row_number() OVER (ORDER BY doc_id, text_crc32) - 1 AS row_no, * FROM docs)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard,
  (x // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed JOIN walk USING (row_no) WHERE x < n""")
def feistel_shards(spark, d):
    rows = sharding.shuffled_shards(table(spark, d, "documents"), SHARDS, SEED)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op9_chunk_recipes", """
SELECT doc_id, max(doc_id) OVER copies AS keep_id, count(*) OVER copies AS group_size,
  doc_id = max(doc_id) OVER copies AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW copies AS (PARTITION BY coalesce(text, ''))""")
def chunk_recipes(spark, d):
    rows = exact_dedup.mark_copies(table(spark, d, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
