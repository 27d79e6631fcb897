"""Exact copies of documents by content-defined chunk recipes.

A text is cut into chunks at places its own characters choose: a chunk has at
least ``low`` characters and ends at the first anchor after them (a vowel, white
space, and a letter from f to m), or after ``high`` characters where none comes.
Equal texts are cut alike.  Every chunk travels once, to be compared with
the other chunks of the same hash: chunks that share a hash but differ get
numbers, so that (hash, number) is a verified identifier.  From then on only
the ordered identifier lists, the recipes, are grouped and joined; two texts
are equal exactly when their recipes are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm.rows import addressed, free_name
from lynceus.session import durable, sized

LOW, HIGH = 1024, 8192


def chunks_of(text: Column, low: int = LOW, high: int = HIGH) -> Column:
    """The chunks of a text, in order; joined together they are the text."""
    pattern = rf"(?s).{{{low},{high}}}?(?<=[aeiou]\s[f-m])|.{{{high}}}|.+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


NUMBERS = "array<struct<place:int,number:int>>"


def repeated_hashes(cut: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows (hash, chunk, number): the chunks that share a hash with another chunk, numbered from 0.

    The only step that moves chunk texts: copies meet in the tasks first, then in the shuffle.
    """
    loose = cut.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("hash"), "chunk")
    shared = durable(loose.distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    if shared.isEmpty():
        return cut.sparkSession.createDataFrame([], "hash long, chunk string, number int")
    # the files of the table tell the optimizer how small it is
    return durable(loose.join(shared, "hash", "left_semi").distinct()
                   .withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")) - 1))


def recipes(cut: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Replace ``chunks`` of the rows (row_at, ..., chunks) by their verified identifiers.

    These are ``recipe``, the hashes of the chunks in order, and ``numbers``, the
    places where a chunk is not the first of its hash, with its number.
    """
    listed = cut.withColumn("recipe", F.transform("chunks", lambda chunk: digest(chunk))).drop("chunks")
    shared = repeated_hashes(cut, digest).filter("number > 0")
    none = F.array().cast(NUMBERS)
    if shared.isEmpty():
        return listed.withColumn("numbers", none)
    placed = (cut.select("row_at", F.posexplode("chunks").alias("place", "chunk"))
              .withColumn("hash", digest(F.col("chunk"))).join(shared, ["hash", "chunk"])
              .groupBy("row_at").agg(F.array_sort(F.collect_list(F.struct("place", "number"))).cast(NUMBERS).alias("numbers")))
    return listed.join(placed, "row_at", "left").withColumn("numbers", F.coalesce("numbers", none))


def _marked(docs: DataFrame, at: str, id_col: str, text_col: str, low: int, high: int,
            digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(at).alias("row_at"), F.col(id_col).alias("id"),
                      F.sha2(text.cast("binary"), 256).alias("text_sha256"), chunks_of(text, low, high).alias("chunks"))
    rows = durable(recipes(cut, digest))
    # written, so that the join below may split the rows of a large group
    groups = durable(rows.groupBy("recipe", "numbers")
                     .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row_at")).alias("best")))
    return rows.join(groups, ["recipe", "numbers"]).select(
        "row_at", "id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row_at") == F.col("best.row_at")).alias("kept"), "text_sha256")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = LOW, high: int = HIGH,
                digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row (row_at, id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Texts are equal when identical; null counts as empty.  Of equal texts the
    row with the largest id stays; where rows repeat that id too, exactly
    one of them.  A null id loses against any other; a group without ids keeps
    one row and has a null keep_id.  An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    at = free_name(docs, "row_at")
    return _marked(addressed(docs, at), at, id_col, text_col, low, high, digest)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are."""
    at = free_name(docs, "row_at")
    rows = addressed(docs, at)
    go = _marked(rows, at, id_col, text_col, LOW, HIGH, F.xxhash64).filter("NOT kept").select(F.col("row_at").alias(at))
    # the rows that go are the fewer ones: while they are small in memory, no text is shuffled again
    return rows.join(sized(go), at, "left_anti").select(docs.columns)
