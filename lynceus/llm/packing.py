"""Packing documents into sequences of fixed length by bounded-space online best fit.

Documents are tokenized where they are read; from then on only (document,
piece, length) rows move.  A packer takes a bounded run of pieces in hashed order and
keeps a fixed number of sequences open.  A bitset has one bit for each amount
of free space; the best fit for a piece is the lowest set bit at or above its
length.  When no open sequence fits and all places are taken, the fullest
closes.  Pieces of sequences that are still open at the end go on, with those of the
other packers, to the next level, until few pieces are left; those are packed longest first.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.rows import addressed, free_name, number_rows
from lynceus.llm.tokens import pieces, slices, tokenizer, worker_cache
from lynceus.session import durable

PIECE_COLUMNS = "row_at struct<file:long,row:long>, id {id}, piece int, start long, length long, ids_crc32 long"

#: ASCII and the letters of the Latin-1 and Latin Extended-A blocks, which every edition of Unicode classes alike.
_PLAIN = re.compile("[ -~\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")


def id_bytes(path: str, ranks_path: str | None = None):
    """A worker's function from a piece of text to its ids as little-endian 32-bit words.

    ``ranks_path`` may name the same vocabulary as a file of ranks, for a
    faster encoder; it gets pieces of ASCII and Latin letters only, on which both agree.
    """
    whole = tokenizer(path)

    def exact(piece: str) -> bytes:
        return np.asarray(whole.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    if not ranks_path:
        return exact
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(piece: str) -> bytes:
        if "<|" in piece or not _PLAIN.fullmatch(piece):
            return exact(piece)
        words = array("I", fast.encode_ordinary(piece))
        if sys.byteorder == "big":
            words.byteswap()
        return words.tobytes()

    return ids


def cut_documents(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                  ranks_path: str | None = None) -> DataFrame:
    """Rows (row_at, id, piece, start, length, ids_crc32): every document as ids with ``end_id`` after them, cut where too long.

    Only documents of more than ``capacity`` ids are cut; all pieces but the
    first are full.  A null text is an empty one.
    """
    at = free_name(docs, "row_at")
    rows = addressed(docs, at).select(F.col(at).alias("row_at"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(f"ids of {path}", id_bytes(path, ranks_path))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                at, piece, start, length, crc = [], [], [], [], []
                for i in range(a, b):
                    ids = b"".join(map(known.__getitem__, pieces(texts[i]))) + end
                    n = len(ids) // 4
                    stop = (n - 1) % capacity + 1
                    begin, number = 0, 0
                    while begin < n:
                        at.append(i)
                        piece.append(number)
                        start.append(begin)
                        length.append(stop - begin)
                        crc.append(zlib.crc32(ids[4 * begin:4 * stop]))
                        begin, stop, number = stop, stop + capacity, number + 1
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_at").take(take), batch.column("id").take(take), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["row_at", "id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, PIECE_COLUMNS.format(id=rows.schema["id"].dataType.simpleString()))


def best_fit(lengths: list[int], capacity: int, open_bins: int, slack: int, last: bool) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each length in turn; sequence -1 for pieces that go on to the next level.

    At most ``open_bins`` sequences are open at a time.  At the end the open ones
    with more than ``slack`` free places are given up, unless this is the ``last`` packer.
    """
    bits, bins, n_open, made = 0, [[] for _ in range(capacity + 1)], 0, 0
    where, offset = [], []
    for need in lengths:
        fits = bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            chosen = bins[free].pop()
            if not bins[free]:
                bits ^= 1 << free
            n_open -= 1
        else:
            if n_open == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                bins[fullest].pop()
                if not bins[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
            chosen, free, made = made, capacity, made + 1
        where.append(chosen)
        offset.append(capacity - free)
        free -= need
        if free:
            bins[free].append(chosen)
            bits |= 1 << free
            n_open += 1
    if not last:
        # those that are nearly full are as good as closed
        given_up = {x for free in range(slack + 1, capacity + 1) for x in bins[free]}
        where = [-1 if x in given_up else x for x in where]
    return where, offset


def _packer(level: int, last: bool, capacity: int, open_bins: int, per_packer: int, slack: int):
    """What one packer does with its rows."""
    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("row_no")
        number = group["row_no"][0].as_py() // per_packer
        where, offset = best_fit(group["length"].to_pylist(), capacity, open_bins, slack, last)
        where = np.asarray(where, np.int64)
        named = np.where(where < 0, -1, (level << 56) + (number << 24) + where)
        return (group.drop_columns(["row_no", "turn", "packer"])
                .append_column("sequence_id", pa.array(named)).append_column("offset", pa.array(offset, pa.int64())))

    return packed


def pack(cut: DataFrame, capacity: int, open_bins: int = 1024, per_packer: int = 32_768, slack: int = 4, seed: int = 1) -> DataFrame:
    """Append sequence_id and offset to rows with a ``length`` of at most ``capacity``.

    Rows also need row_at, id, piece and ids_crc32, which give them an order that
    does not depend on where they are stored.
    """
    kept, level, todo, before = None, 0, cut, None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    while True:
        numbered = number_rows(todo.withColumn("turn", F.xxhash64(F.lit(seed + level), "id", "piece", "ids_crc32")),
                               [F.col("turn"), F.col("row_at"), F.col("piece")], "row_no")
        n = numbered.count()
        # one packer ends the work when another random order doesn't halve what stays open
        last = n <= per_packer and before is not None and 2 * n >= before
        before = n
        run = F.call_function("div", F.col("row_no"), F.lit(per_packer))
        done = durable(numbered.withColumn("packer", run).groupBy("packer").applyInArrow(
            _packer(level, last, capacity, open_bins, per_packer, slack), schema))
        placed = done.filter("sequence_id >= 0")
        kept = placed if kept is None else kept.unionByName(placed)
        if last:
            return kept
        todo, level = done.filter("sequence_id < 0").drop("sequence_id", "offset"), level + 1


def packed_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                     text_col: str = "text", ranks_path: str | None = None, **options) -> DataFrame:
    """Rows (row_at, id, piece, start, length, ids_crc32, sequence_id, offset) for all pieces of all documents.

    A sequence holds at most ``capacity`` ids; its pieces lie from offset 0 on
    without gaps.  A null or empty text is the end id alone.  Rows that repeat,
    or share an id, are packed each for itself.  An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    return pack(durable(cut_documents(docs, path, capacity, end_id, id_col, text_col, ranks_path)), capacity, **options)
