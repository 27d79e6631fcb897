"""Association rules of a small production log: expected supports and confidences.

Fixed values: the traces, their dictionary and the rules are given data.
"""

from lynceus.operators import eventlog, itemsets
from pyspark.sql import functions as F

TRACES = """\
@CONVERTED_FROM_TEXT
@ITEM=1=ID0998
@ITEM=2=ID4385
@ITEM=3=ID4355
@ITEM=4=ID4163
@ITEM=5=ID4872
@ITEM=6=ID4820
@ITEM=7=ID4445
@ITEM=8=ID4882
@ITEM=9=ID4528
@ITEM=10=ID4493
@ITEM=11=ID0937
@ITEM=12=ID4932
@ITEM=13=ID4429
@ITEM=14=ID4167
@ITEM=15=ID4529
@ITEM=16=ID4641
@ITEM=17=ID0420
@ITEM=18=ID4491
@ITEM=19=ID4132
@ITEM=20=ID4287
@ITEM=21=ID4718
@ITEM=22=ID4442
@ITEM=23=ID3846
@ITEM=24=ID4291
@ITEM=25=ID4794
@ITEM=26=ID0997
1 2 2 3 4 4 4 4 5 6 4 4
7 3 5 5 8 1 5 3 2 9 3 3 5 5 5 5 5 5 9 5 9 5 9 5 9 5 9 5 5 10 11 11 11 11
5 4 6 9 4 6 4
12 12 13 12 12 12 13 14 13 12 12 12 14 15 15 12 16 16 4 4 13 12 12 4 14 14 15 15 12 8 4 14 15 8 8 8 4 12 4 12 4 12 14 4 15 12 1 8 14 15 12 4 4 14 14 14 15 15 4 8 4 14 14 1 1 4 4 4 4 4 1 3 1 1 1 7 17 8 1 7 17 9 3 4 4 17 2 3 4 4 3 6 4 4 8 4 3 1 3 3 17 6 8 2 4 3 4 4 4 4 4 1 2 8 8 17 3 1 4 2 6 8 1 7 4 1 17 4 9 1 3 8 8 4 9 17 1 4 8 4 8 3 7 3 3 2 3 17 3 3 9 4 9 4 6 4 6 4 4 4 4 4 4 4 4 9 9 9 4 5 5 6 4 18 4
19 9 6 6 20 20 20 1 1 20 20 1 2 3 3 3 3 20 20 18 20
4 9 10 6
13 15 15 20 13 12 13 21 12 10 8 22 10 3 1 8 1 8 1 1 2 2 3 7 2 9 3 3 2 10 6 6 10 9 6 10 8
8 1 8 8 1 7 7 7 8 3 4 23 16 3 23 7 2 19 3 1 7 19 2 16 4 4 4 16 19 1 16 4 4 4 19 4 4 16 4 4 19 4 4 4 4 1 5 4 4 18 1 2 8 2 2 8 1 8 2 8 8 2 8 7 7 3 8 2 2 4 8 4 4 3 4 2 8 8 1 7 4 4 2 4 6 9 10 9 9 10 10 6 10 4 5 6 6 6 9 24 10 10 18 4 4 4 4 4
11 5 10 10 6 3 3
16 23 16 16 19 23 16 19 10 1 1 2 2 7 10 9 5 9 9 6 10
5 5 5 5 5 8 8 8 7 8 1 2 8 2 2 1 3 7 2 5 1 22 1 1 8 2 4 4 4 2 5 4 1 4 17 4 4 6 6 4 4 4 4 4 4 6 4 5 6 4 4 4 4 4 4 1 4 3 3 6 4 4 4 6 9 9 2 6 4 4 5 6 4 9 1
25 12 13 21 15 13 15 13 25 12 25 15 13 4 4 8 1 8 17 17 5 1 8 17 5 7 5 2 2 17 3 3 4 4 4 4 4 4 6 4 6 4 4 4 4 4 6 4 9 9 1 7 3 17 6 4 9 4 4 4 4 4 6 4 9 5 5 11 6 4 4
4 13 12 13 4 13 20 12 12 13 15 15 16 12 4 4 4 4 4 4 13 7 1 1 8 2 2 3 1 8 4 4 4 1 7 7 17 8 4 2 8 17 17 7 4 4 4 6 4 6 6 4 4 4 4 6 4 4 4 4 4 4 5 9 4 4 9 6 4 6 4
12 12 12 13 10 12 10 10 13 8 10 13 2 8 8 8 8 8 1 8 8 8 8 8 3 2 2 1 8 7 7 17 7 17 17 3 7 7 17 17 9 7 8 7 10 6 10 6 10 9 5 9 10 10 6 10 10 6 6
14 13 12 12 12 12 26 26 14 13 12 10 1 8 1 2 7 2 10 10 6 10 6 5 10
14 12 12 20 14 20 1 1 9 5 9 5 3 2 9 2 2 5 5 5 3 9 5 18 10 9 6 10 9 6 10
"""

RULES = """\
ID4872  ==> ID0998 ID4385  #SUP: 11 #CONF: 0.8461538461538461
ID4355  ==> ID0998 ID4385  #SUP: 11 #CONF: 0.9166666666666666
ID4528  ==> ID0998 ID4385  #SUP: 11 #CONF: 0.8461538461538461
ID0998 ID4385  ==> ID4355  #SUP: 11 #CONF: 0.8461538461538461
ID0998 ID4355  ==> ID4385  #SUP: 11 #CONF: 1.0
ID0998 ID4528  ==> ID4385  #SUP: 11 #CONF: 1.0
ID0998 ID4385  ==> ID4872  #SUP: 11 #CONF: 0.8461538461538461
ID0998 ID4385  ==> ID4528  #SUP: 11 #CONF: 0.8461538461538461
ID4385 ID4355  ==> ID0998  #SUP: 11 #CONF: 1.0
ID4385 ID4872  ==> ID0998  #SUP: 11 #CONF: 1.0
ID4820  ==> ID0998 ID4385  #SUP: 12 #CONF: 0.8
ID0998  ==> ID4385 ID4820  #SUP: 12 #CONF: 0.9230769230769231
ID4385  ==> ID0998 ID4820  #SUP: 12 #CONF: 0.9230769230769231
ID0998 ID4385  ==> ID4820  #SUP: 12 #CONF: 0.9230769230769231
ID4385 ID4820  ==> ID0998  #SUP: 12 #CONF: 1.0
ID0998 ID4820  ==> ID4385  #SUP: 12 #CONF: 1.0
"""


def _lines(spark, text):
    rows = [(i, line) for i, line in enumerate(text.splitlines())]
    return spark.createDataFrame(rows, "line_no long, value string")


def test_rules_of_the_production_log(spark):
    events, _ = eventlog.parse_traces(_lines(spark, TRACES))
    baskets = events.groupBy("seq_id").agg(F.collect_set("label").alias("items"))
    assert baskets.count() == 16
    sets = itemsets.frequent_itemsets(baskets, "items", 11 / 16, max_len=3)
    found = {(frozenset(r["antecedent"]), frozenset(r["consequent"])): (r["support"], round(r["confidence"], 3))
             for r in itemsets.association_rules(sets, 0.8).collect()}
    wanted = eventlog.parse_rules(_lines(spark, RULES)).collect()
    assert len(wanted) == 16
    for r in wanted:
        assert found[frozenset(r["antecedent"]), frozenset(r["consequent"])] == (r["support"], r["confidence"])
    # how many rules of at most three items reach a support
    assert [sum(s >= n for s, _ in found.values()) for n in (13, 12, 11)] == [2, 16, 47]


def test_top_rules_are_ordered_and_cut(spark):
    events, _ = eventlog.parse_traces(_lines(spark, TRACES))
    baskets = events.groupBy("seq_id").agg(F.collect_set("label").alias("items"))
    sets = itemsets.frequent_itemsets(baskets, "items", 11 / 16, max_len=3)
    top = itemsets.top_k_rules(itemsets.association_rules(sets, 0.8), 10, 0.8).collect()
    assert len(top) == 10
    assert [(-r["support"], -r["confidence"], r["rule"]) for r in top] == sorted(
        (-r["support"], -r["confidence"], r["rule"]) for r in top)
