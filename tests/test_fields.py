from scriptorium.operators import fields as X
from scriptorium.operators import lines as L


def test_label_variants_and_item_lines(spark):
    text = "INVOICE NO: A-17\nIssue date: 2 May\nSupplier : Acme\nBill To: Jo\nPen 2 $3.50\nInk bottle x 1 @ 7\nPad x3 @ $1.25\nTotal Due: $9"
    rows = [(1, text), (2, "Dates matter\nTotal:\nGrand Total: 5\nPhone 555 1234"), (3, ""), (4, None)]
    got = {r.doc_id: r for r in X.invoice_fields(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = got[1]
    assert (one.invoice_number, one.date, one.total, one.vendor, one.customer) == ("A-17", "2 May", "$9", "Acme", "Jo")
    assert [tuple(i) for i in one["items"]] == [("Pen", "2", "3.50"), ("Ink bottle", "1", "7"), ("Pad", "3", "1.25")]
    assert (got[2].date, got[2].total, got[2]["items"]) == ("Not found", "5", [])
    assert got[3].total == got[4].total == "Not found"


def test_own_patterns(spark):
    df = spark.createDataFrame([(1, "ref=9\n3*Pen=4")], "doc_id long, text string")
    got = X.invoice_fields(df, patterns={"ref": r"ref=(\w+)"}, item_pattern=r"(?m)^()([0-9]+)\*Pen=([0-9]+)$").first()
    assert got.ref == "9" and [tuple(i) for i in got["items"]] == [("", "3", "4")]


def test_a_question_asked_twice_is_answered_twice(spark):
    text = "1. Ok:\nxYes\nNo\n1. Ok:\nYes\nxNo\n☑Maybe\n2. Empty:\nName: Jo"
    df = spark.createDataFrame([(1, text), (1, "1. Ok:\nxYes"), (2, None), (3, "")], "doc_id long, text string")
    boxes = sorted((r.doc_id, r.line_no, r.question, r.answer) for r in X.checkbox_answers(df).collect())
    assert boxes == [(1, 1, "1. Ok:", "Yes"), (1, 1, "1. Ok:", "Yes"), (1, 4, "1. Ok:", "No, Maybe")]
    form = sorted((r.line_no, r.field, r.value) for r in X.form_fields(df.limit(1)).collect())
    assert form == [(1, "Ok", "Yes"), (4, "Ok", "No, Maybe"), (8, "Empty", ""), (9, "Name", "Jo")]


def test_crop_is_clipped_at_all_edges(spark):
    box = lambda x0, y0, x1, y1: [{"x": float(x0), "y": float(y0)}, {"x": float(x1), "y": float(y1)}]
    rows = [(1, box(0, -10, 20, 2)), (2, box(-10, 0, 2, 20)), (3, box(-5, -5, 5, 5)), (4, box(95, 0, 120, 20)), (5, box(96, 0, 120, 20))]
    df = spark.createDataFrame(rows, "line_no int, box array<struct<x:double,y:double>>")
    assert sorted(r.line_no for r in L.crop_filter(df, 100, 100).collect()) == [3, 4]


def test_batch_files(spark):
    df = spark.createDataFrame([("b", 1, "a.txt", True, "ok", "xy"), ("b", 2, "b.txt", False, "bad", None)],
                               "batch_id string, doc_id long, filename string, success boolean, message string, text string")
    assert sorted((r.filename, r.status, r.error, r.n_chars) for r in L.batch_files(df).collect()) == [
        ("a.txt", "completed", None, 2), ("b.txt", "failed", "bad", 0)]


def test_forms_are_dealt_before_they_are_read(spark):
    from scriptorium.plans import QUERIES
    from conftest import SF_SMALL

    for name in ("checkbox_fields", "quality_pixels"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
