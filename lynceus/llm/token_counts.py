"""Token counts by a two-tier lookup on the map side.

First tier: a broadcast table of the token counts of frequent pre-tokens, the
pieces between spaces.  It has a bounded number of entries of bounded length.
Second tier: a cache in each worker, filled by the tokenizer.  No pre-token is
shuffled.  The frequent ones are found by summaries: each task keeps a bounded
Misra-Gries count of its pieces over all its texts, and only the summaries are
added up.  The tables change the speed, never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.rows import addressed, free_name
from lynceus.llm.tokens import CACHE_PIECE, slices, tokenizer, worker_cache

#: Entries of the broadcast table, and of one task's summary.  Pieces are at most CACHE_PIECE characters long.
TABLE_ENTRIES = 65_536
SUMMARY_ENTRIES = 16_384


def frequent_pieces(docs: DataFrame, text_col: str, summary: int = SUMMARY_ENTRIES) -> DataFrame:
    """(piece, n): for each task its most frequent pieces, added up.  ``n`` is a lower bound of the true count."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for a, b in slices(texts):
                for text in texts[a:b]:
                    seen.update(text.split(" "))
                if len(seen) > 16 * summary:
                    # lower all counts by that of the first piece that has no room, as Misra and Gries do
                    top = seen.most_common(8 * summary + 1)
                    cut = top.pop()[1]
                    seen = Counter({piece: n - cut for piece, n in top if n > cut})
        top = [(x, n) for x, n in seen.most_common(summary) if 0 < len(x) <= CACHE_PIECE]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([x for x, _ in top], pa.string()),
                                          "n": pa.array([n for _, n in top], pa.int64())})

    return (docs.select(text_col).mapInArrow(summarise, "piece string, n long")
            .groupBy("piece").agg(F.sum("n").alias("n")))


def frequent_table(docs: DataFrame, path: str, text_col: str = "text", entries: int = TABLE_ENTRIES) -> Broadcast:
    """Broadcast (pieces joined by spaces, one byte of token count each): at most ``entries`` pieces."""
    top = frequent_pieces(docs, text_col).orderBy(F.desc("n"), "piece").limit(entries).select("piece").toArrow()
    words = top.column("piece").to_pylist()
    lengths = [len(x.ids) for x in tokenizer(path).encode_batch(words, add_special_tokens=False)] if words else []
    # a piece of 64 characters has at most 256 bytes; the few with more tokens than a byte holds are left out
    fit = [i for i, n in enumerate(lengths) if n < 256]
    packed = (" ".join(words[i] for i in fit), bytes(lengths[i] for i in fit))
    return docs.sparkSession.sparkContext.broadcast(packed)


class TwoTier(dict):
    """Frequent pieces; any other goes to the cache of the worker."""

    def __init__(self, packed: tuple[str, bytes], misses):
        words, lengths = packed
        super().__init__(zip(words.split(" "), lengths, strict=True) if lengths else ())
        self[""] = 0
        self.misses = misses

    def __missing__(self, piece: str) -> int:
        return self.misses[piece]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 frequent: Broadcast | None = None) -> DataFrame:
    """One row (row_at, id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    Counts are those of the tokenizer on the whole text, without added tokens,
    for a tokenizer that drops white space.  A null text counts as empty: 0
    bytes and tokens.  Repeated rows are counted each for itself.  An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    frequent = frequent or frequent_table(docs, path, text_col)
    at = free_name(docs, "row_at")
    rows = addressed(docs, at).select(F.col(at).alias("row_at"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = tokenizer(path)
        misses = worker_cache(f"counts of {path}", lambda piece: len(whole.encode(piece, add_special_tokens=False).ids))
        lookup = TwoTier(frequent.value, misses).__getitem__
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [sum(map(lookup, text.split(" "))) if text else 0 for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_at"), batch.column("id"), pa.array(counts, pa.int64()),
                 pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())],
                names=["row_at", "id", "n_tokens", "n_bytes"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(count, f"row_at struct<file:long,row:long>, id {kind}, n_tokens long, n_bytes long")
    return found.select("row_at", "id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
