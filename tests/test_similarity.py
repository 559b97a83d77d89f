import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions.similarity import indel_ratio, lcs_length, similarity_ratio


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def test_goldens():
    assert indel_ratio("kitten", "sitting") == 0.6153846153846154
    assert indel_ratio("Invoice", "Invo1ce") == 0.8571428571428571
    assert indel_ratio("Total", "Tota1") == 0.8
    assert round(indel_ratio("Amount due", "Am"), 6) == 0.333333
    assert indel_ratio("", "") == 1.0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé😀 ", max_size=40), st.text(alphabet="abcé😀 ", max_size=40))
def test_bit_parallel_equals_dp(a, b):
    assert lcs_length(a, b) == lcs_dp(a, b)


def test_udf(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), (None, "x")], "a string, b string")
    got = [r.r for r in df.select(similarity_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [0.6153846153846154, 1.0, None]


def test_replaced_characters_need_no_table():
    """Long lines whose characters differ in place only, and one with an insertion."""
    n = 400_000
    began = time.time()
    assert lcs_length("abe" * n, "abc" * n) == 2 * n
    assert time.time() - began < 20
    for a, b in (("hello world", "hell0 worId"), ("xhello", "hello"), ("ab", "ba"), ("", "a")):
        assert lcs_length(a, b) == lcs_dp(a, b)
