from pyspark.sql import functions as F

from scriptorium.functions.similarity import indel_ratio
from scriptorium.operators import lines as L
from scriptorium.session import read_table
from scriptorium.sources import derived as D

from conftest import SF_SMALL


def test_merge_golden(spark):
    rows = [(1, 1, "Invo1ce", 0.60, "Invoice"), (1, 2, "Tota1", 0.50, "Total"),
            (1, 3, "Am", 0.30, "Amount due"), (1, 4, "Paid", 0.10, ""), (1, 5, "Tax", 0.75, "Fax")]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, text string, conf double, alt_text string")
    got = {r.line_no: r.merged for r in L.merge_alternates(df).collect()}
    assert got == {1: "Invoice", 2: "Tota1", 3: "Amount due", 4: "Paid", 5: "Tax"}


def brute_merge(text, conf, alt):
    if conf >= 0.75:
        return text
    t = (alt or "").strip()
    sim = indel_ratio(t, text) if t else 0
    return t if t and (sim >= 0.85 or len(t) > len(text) + 3) else text


def test_merge_matches_brute_force(spark):
    lines = D.lines(read_table(spark, SF_SMALL, "documents"))
    got = {(r.doc_id, r.line_no): r.merged for r in L.merge_alternates(lines).collect()}
    exp = {(r.doc_id, r.line_no): brute_merge(r.text, r.conf, r.alt_text) for r in lines.collect()}
    assert got == exp


def test_box_golden(spark):
    box = [(10.9, 5.2), (40.1, 5.9), (40.8, 9.7), (10.2, 9.1)]
    df = spark.createDataFrame([(1, 1, "x", [{"x": x, "y": y} for x, y in box])],
                               "doc_id long, line_no int, text string, box array<struct<x:double,y:double>>")
    b = L.box_bounds(df).first()
    assert (b.x_min, b.x_max, b.y_min, b.y_max) == (10, 40, 5, 9)
    assert L.crop_filter(df, 1000, 1000).count() == 0  # height 4 < 5


def test_outcome_messages(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    raw = spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, line_no int")
    kept = spark.createDataFrame([(3, 1)], "doc_id long, line_no int")
    got = {r.doc_id: r.message for r in L.document_outcome(docs, raw, kept).collect()}
    assert got == {1: "No text detected", 2: "No valid text found", 3: "Text extracted"}


def test_batch_details_when_nothing_readable(spark):
    rows = [("b", 1, "a.png", False, "OCR failed: x", ""), ("b", 2, "b.pdf", False, "OCR failed: y", ""),
            ("c", 3, "c.txt", True, "ok", "t")]
    df = spark.createDataFrame(rows, "batch_id string, doc_id long, filename string, success boolean, message string, text string")
    got = {r.batch_id: r.details for r in L.batch_summary(df).collect()}
    assert got == {"b": "Details: a.png (OCR failed: x), b.pdf (OCR failed: y)", "c": None}


def test_null_lines_keep_their_rows(spark):
    from scriptorium.operators import lines as L

    df = spark.createDataFrame([(1, 0.1, None, "alt"), (2, 0.1, None, None), (3, None, "x", "y")], "id long, conf double, text string, alt_text string")
    got = {r["id"]: (r["merged"], r["used_alternate"]) for r in L.merge_alternates(df).collect()}
    assert set(got) == {1, 2, 3}
    texts = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "doc_id long, text string")
    assert L.content_reuse(texts, "doc_id", "text", lambda u: u).count() == 3
