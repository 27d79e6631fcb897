from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.operators import eda, eventlog, shaping
from lynceus.sources import files, messages


def test_pivot_strict_refuses_duplicates(spark):
    df = spark.createDataFrame([("d1", "a", 1.0), ("d1", "b", 2.0), ("d2", "a", 3.0)], "date string, target string, value double")
    out = {r["date"]: (r["a"], r["b"]) for r in shaping.pivot_sensors(df, "date", "target", "value", ["a", "b"], "strict").collect()}
    assert out == {"d1": (1.0, 2.0), "d2": (3.0, None)}
    twice = df.union(df.limit(1))
    with pytest.raises(Exception, match="two readings"):
        shaping.pivot_sensors(twice, "date", "target", "value", ["a", "b"], "strict").collect()


def test_time_formats(spark):
    df = spark.createDataFrame([(1514764800000, "01/02/2018", "2018-03-04 05:06:07")], "e long, d string, t string")
    df = shaping.normalize_ts(shaping.normalize_ts(shaping.normalize_ts(df, "e", "ms"), "d", "%d/%m/%Y"), "t")
    row = df.select(*[F.col(c).cast("string") for c in df.columns]).first()
    assert list(row) == ["2018-01-01 00:00:00", "2018-02-01 00:00:00", "2018-03-04 05:06:07"]
    with pytest.raises(ValueError, match="unknown directive"):
        shaping.datetime_pattern("%Q")
    with pytest.raises(ValueError, match="missing columns"):
        shaping.to_series(df, "nope", "e")


def test_batches_halve_with_the_smaller_half_first():
    assert shaping.batch_starts(11, 2) == [0, 2, 5, 8]
    assert shaping.batch_starts(8, 3) == list(range(8))


def test_columnar_json_round_trip(spark):
    df = spark.createDataFrame([(0, 1, 1.5, "x"), (0, 2, None, "y"), (1, 1, 2.5, None)], "m int, k int, v double, s string")
    sent = messages.encode_columnar_json(df, "m", "k", ["v", "s"])
    schema = T.StructType([T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType())])
    back = messages.decode_columnar_json(sent, "body", schema, "m").orderBy("m", "row_key").collect()
    assert [tuple(r) for r in back] == [(0, "1", 1.5, "x"), (0, "2", None, "y"), (1, "1", 2.5, None)]


def test_nested_records_then_pivot(spark):
    text = ('{"tsdata": [{"target": "p1", "date": "2024-01-01T00:00:00", "value": 1.0},'
            ' {"target": "p2", "date": "2024-01-01T00:00:00", "value": 2.0}]}')
    rows = messages.explode_records(spark.createDataFrame([(text,)], "body string"), "body")
    out = shaping.pivot_sensors(rows, "date", "target", "value", ["p1", "p2"], "strict").first()
    assert (out["p1"], out["p2"]) == (1.0, 2.0)


def test_traces_are_cut_into_bounded_rows(spark):
    log = spark.createDataFrame([("c", i, f"a{i % 3}") for i in range(25)] + [("d", 0, "z")], "case string, t int, act string")
    out = eventlog.build_traces(log, "case", "t", "act", segment=10).orderBy("case", "segment_no").collect()
    assert [(r["case"], r["segment_no"], r["n_events"]) for r in out] == [("c", 0, 10), ("c", 1, 10), ("c", 2, 5), ("d", 0, 1)]
    assert sum((r["trace"] for r in out[:3]), []) == [f"a{i % 3}" for i in range(25)]


def test_trace_and_rule_files(spark, tmp_path):
    p = tmp_path / "traces.txt"
    p.write_text("@CONVERTED_FROM_TEXT\n@ITEM=1=ID1\n@ITEM=2=ID2\n1 2 1\n2\n")
    events, names = eventlog.parse_traces(files.read_text_lines(spark, str(p)))
    got = [tuple(r) for r in events.orderBy("seq_id", "pos").select("pos", "code", "label").collect()]
    assert got == [(0, "1", "ID1"), (1, "2", "ID2"), (2, "1", "ID1"), (0, "2", "ID2")]
    assert names.count() == 2
    lines = spark.createDataFrame([("A B  ==> C #SUP: 11 #CONF: 0.84615",), ("X -1 #SUP: 3",), ("D ==> E #SUP: 4",)], "value string")
    rules = [tuple(r) for r in eventlog.parse_rules(lines).collect()]
    assert rules == [(["A", "B"], ["C"], 11, 0.846), (["D"], ["E"], 4, None)]


def test_production_log_names(spark):
    cols = ", ".join(f"`{c}` string" for c in eventlog.PRODUCTION_LOG)
    row = ["c1", "cut", "r", "2012/01/29 23:24:00.000", "2012/01/30 05:43:00.000", "1", "1", "0", "0", "Cable Head"]
    df = spark.createDataFrame([row], cols)
    out = eventlog.parse_event_ts(eventlog.to_event_log(df), ["start:timestamp", "time:timestamp"])
    assert str(out.first()["start:timestamp"]) == "2012-01-29 23:24:00"
    kept = eventlog.filter_log(out, F.col("Part") == "Cable Head")
    assert kept.count() == 1 and set(out.columns) == set(eventlog.PRODUCTION_LOG.values())


def test_tables_by_ending(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    df.write.csv(str(tmp_path / "t.csv"), header=True)
    files.export_json(df, str(tmp_path / "t.json"))
    for name in ("t.csv", "t.json"):
        back = files.read_table(spark, str(tmp_path / name), "i int, s string")
        assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="format"):
        files.read_table(spark, "x.xlsx", "i int")


def test_regular_axis_and_history(spark):
    df = spark.createDataFrame([(i, float(i)) for i in (3, 1, 2)], "i int, v double")
    out = shaping.assign_regular_ts(df, "i", datetime(2018, 1, 1), timedelta(hours=1)).orderBy("i")
    assert [str(r["ds"]) for r in out.collect()] == [f"2018-01-01 0{h}:00:00" for h in range(3)]
    joined = shaping.join_history(df, df.selectExpr("i + 3 as i", "v"), "i", 4)
    assert sorted(r["i"] for r in joined.collect()) == [3, 4, 5, 6]


def test_large_tail_window_equals_the_top_k_plan(spark, monkeypatch):
    df = spark.range(500).selectExpr("id as t", "id * 2 as v")
    want = sorted(map(tuple, shaping.tail_window(df, "t", 123).collect()))
    monkeypatch.setattr(shaping, "TOP_K_ROWS", 10)
    assert sorted(map(tuple, shaping.tail_window(df, "t", 123).collect())) == want


def test_scaler_round_trip_and_constant_column(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(10)], "a double, c double")
    scaler = eda.Scaler.fit(df, ["a", "c"])
    scaled = scaler.transform(df)
    assert all(r["c"] == 0.0 for r in scaled.collect())
    back = scaler.inverse(scaled).orderBy("a").collect()
    assert [round(r["a"], 9) for r in back] == [float(i) for i in range(10)]


def test_quantile_bins_follow_right_closed_edges(spark):
    import pandas as pd
    values = [1.0, 2.0, 2.0, 2.0, 3.0, 4.0, 5.0, 9.0, 9.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = eda.QuantileBinner.fit(df, ["v"], q=4)
    got = [r[0] for r in df.select(out.bin_of("v")).collect()]
    assert got == pd.qcut(pd.Series(values), 4, labels=False, duplicates="drop").tolist()
