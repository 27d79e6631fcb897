"""Event-log preparation for process mining."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators.ordering import as_list, row_index
from lynceus.operators.shaping import require_columns

# Columns of a production log and their canonical event-log names.
PRODUCTION_LOG = {
    "Case ID": "case:concept:name",
    "Activity": "concept:name",
    "Resource": "org:resource",
    "Start Timestamp": "start:timestamp",
    "Complete Timestamp": "time:timestamp",
    "Work Order  Qty": "Ordered",
    "Qty Completed": "Completed",
    "Qty Rejected": "Rejected",
    "Qty for MRB": "MRB",
    "Part Desc.": "Part",
}

LOG_TIME_PATTERN = "yyyy/MM/dd HH:mm:ss"
SEGMENT_EVENTS = 10_000


def order_log(log: DataFrame, case: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """Number the events of every case along time (``event_idx``, from 0)."""
    return row_index(log, order, key=case, name="event_idx")


def parse_event_ts(log: DataFrame, cols: Sequence[str],
                   pattern: str = LOG_TIME_PATTERN) -> DataFrame:
    """Drop fractional seconds and parse the text time stamps."""
    require_columns(log, cols)
    return log.withColumns({c: F.to_timestamp(F.substring_index(F.col(c), ".", 1), pattern)
                            for c in cols})


def to_event_log(log: DataFrame, mapping: Mapping[str, str] = PRODUCTION_LOG) -> DataFrame:
    require_columns(log, list(mapping))
    return log.withColumnsRenamed(dict(mapping))


def filter_log(log: DataFrame, condition: Column | str) -> DataFrame:
    return log.filter(condition)


def cases_with_activity(log: DataFrame, case: str | Sequence[str], activity: str,
                        wanted: str) -> DataFrame:
    """Every event of the cases that contain the wanted activity."""
    case = as_list(case)
    hits = log.filter(F.col(activity) == wanted).select(*case).distinct()
    return log.join(hits, case, "left_semi")


def first_seen_codes(log: DataFrame, col: str, order: str | Sequence[str],
                     out: str = "code") -> DataFrame:
    """Dictionary (value, code): codes 1, 2, ... by first appearance along ``order``."""
    order = as_list(order)
    first = log.groupBy(col).agg(F.min(F.struct(*order)).alias("_first"))
    return (row_index(first, "_first", name=out)
            .select(col, (F.col(out) + 1).alias(out)))


def encode_values(log: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    return log.join(codes, col, "left")


def build_traces(log: DataFrame, case: str | Sequence[str], order: str | Sequence[str], col: str,
                 segment: int = SEGMENT_EVENTS) -> DataFrame:
    """Ordered values of every case.

    One row per case and run of ``segment`` events, so that no case of any
    length has to fit in one row; a case up to that length is one row
    (``segment_no`` 0).
    """
    case = as_list(case)
    rows = (order_log(log, case, order)
            .withColumn("segment_no", F.floor(F.col("event_idx") / segment)))
    cells = F.array_sort(F.collect_list(F.struct("event_idx", F.col(col).alias("value"))))
    return (rows.groupBy(*case, "segment_no").agg(cells.alias("_cells"))
            .select(*case, "segment_no", F.size("_cells").alias("n_events"),
                    F.transform("_cells", lambda c: c["value"]).alias("trace")))


def trace_text(traces: DataFrame, out: str = "trace_text") -> DataFrame:
    return traces.withColumn(out, F.array_join(F.transform("trace", lambda v: v.cast("string")), " "))


ITEM_PATTERN = r"^@ITEM=(\d+)=(.*)$"


def parse_traces(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split a trace file into events (seq_id, pos, code, label) and the dictionary (code, label).

    ``lines`` holds one text line per row and a ``line_no`` column; dictionary
    and marker lines start with ``@``.
    """
    require_columns(lines, [col, "line_no"])
    dictionary = (lines.filter(F.col(col).startswith("@ITEM="))
                  .select(F.regexp_extract(col, ITEM_PATTERN, 1).alias("code"),
                          F.regexp_extract(col, ITEM_PATTERN, 2).alias("label")))
    body = lines.filter(~F.col(col).startswith("@") & (F.trim(col) != ""))
    events = body.select(F.col("line_no").alias("seq_id"),
                         F.posexplode(F.split(F.trim(col), r"\s+")).alias("pos", "code"))
    return (events.join(dictionary, "code", "left")
            .select("seq_id", "pos", "code", F.coalesce("label", "code").alias("label")), dictionary)


RULE_PATTERN = r"^(.*?)\s*==>\s*(.*?)\s*#SUP:\s*(\d+)(?:\s*#CONF:\s*([0-9.eE+-]+))?\s*$"


def parse_rules(lines: DataFrame, col: str = "value") -> DataFrame:
    """Rule text ``A B ==> C #SUP: n #CONF: x`` to columns, highest support first."""
    part = lambda i: F.regexp_extract(col, RULE_PATTERN, i)
    confidence = F.round(F.nullif(part(4), F.lit("")).cast("double"), 3)
    return (lines.filter(F.col(col).rlike(RULE_PATTERN))
            .select(F.split(part(1), r"\s+").alias("antecedent"),
                    F.split(part(2), r"\s+").alias("consequent"),
                    part(3).cast("long").alias("support"), confidence.alias("confidence"))
            .orderBy(F.col("support").desc(), "antecedent", "consequent"))
