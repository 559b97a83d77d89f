from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators.ordering import number_rows, number_within
from scriptorium.session import read_table

from conftest import SF_SMALL


def test_matches_row_number_and_splits_hot_group(spark):
    li = read_table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keys = ["l_linenumber", "l_partkey", "l_suppkey"]
    exp = li.withColumn("idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*keys)).cast("long"))
    for n in (1, 3, 7):
        got = number_within(li, ["l_orderkey"], keys, ranges=n)
        assert got.exceptAll(exp).count() == 0
    hot = number_within(li.withColumn("g", F.lit(1)), ["g"], ["l_orderkey", *keys], ranges=5)
    total = li.count()
    r = hot.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx")).first()
    assert tuple(r) == (1, total, total)
    whole = number_rows(li, ["l_orderkey", *keys], "n", ranges=6)
    assert whole.exceptAll(li.withColumn("n", F.row_number().over(Window.orderBy("l_orderkey", *keys)).cast("long"))).count() == 0


def test_nulls_ties_and_clashing_names(spark):
    rows = [(None, 1, "a"), (None, 1, "b"), (None, None, "c"), ("g", 2, "d"), ("g", 1, "e"), ("h", None, None)]
    df = spark.createDataFrame(rows, "g string, o int, _part string").withColumn("_row", F.lit(9))
    got = number_within(df, ["g"], ["o"], "i", ranges=3)
    assert got.columns == ["g", "o", "_part", "_row", "i"]
    seen = {}
    for r in got.collect():
        seen.setdefault(r["g"], []).append((r["i"], r["o"]))
        assert r["_row"] == 9
    assert {k: sorted(v) for k, v in seen.items()} == {None: [(1, None), (2, 1), (3, 1)], "g": [(1, 1), (2, 2)], "h": [(1, None)]}
    assert number_rows(df.where("false"), ["o"]).count() == 0 and number_within(df.where("false"), ["g"], ["o"]).count() == 0
