from pyspark.sql import functions as F

from scriptorium.functions import text as X


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("r")).first()["r"]


def test_repair_golden(spark):
    # L3 goldens
    assert one(spark, X.repair_lines("t"), "I1em 3") == "Item 3"
    assert one(spark, X.repair_lines("t"), "Total $ 12") == "Total $12"
    assert one(spark, X.repair_lines("t"), "A - B") == "A-B"
    assert one(spark, X.repair_lines("t"), "   ") == ""


def test_dedup_golden(spark):
    # L4: ' a ', '', 'b', 'a', 'B' -> a, b, B
    assert one(spark, X.dedup_lines("t"), " a \n\nb\na\nB") == "a\nb\nB"


def test_strip_is_python_strip(spark):
    samples = [" x ", "\x1cy\x1f", " z　", " \t\n"]
    for s in samples:
        assert one(spark, X.py_strip("t"), s) == s.strip()


def test_splitlines_like_python(spark):
    s = "a\r\nb\rc\x0bd\x0ce\x1cf g h\x85i"
    got = one(spark, X.clean_lines("t"), s)
    assert got == [x.strip() for x in s.splitlines() if x.strip()]


def test_tokens(spark):
    got = one(spark, X.tokens("t"), 'Deep learning, of the big."data\nsets')
    assert got == ["deep", "learning", ",", "of", "the", "big", '."', "data", "\n", "sets"]


def test_cleanup_keeps_duplicates(spark):
    assert one(spark, X.cleanup_lines("t"), " a\n\na ") == "a\na"
