import os

from pyspark.sql import functions as F

from scriptorium.sources import documents as S
from scriptorium.sources import stores as ST
from scriptorium.session import read_table

from conftest import SF_SMALL


def test_scan_and_route(spark, tmpdir_path):
    files = {"a.TXT": "hello\nworld".encode(), "b.csv": b"x,y\n1,2\n", "bad.txt": b"\xff\x41",
             "c.png": b"\x89PNG", "noext": b"zz", "d.weird": b"?"}
    for n, b in files.items():
        with open(os.path.join(tmpdir_path, n), "wb") as f:
            f.write(b)
    got = {r.filename: (r.ext, r.format, r.success, r.text) for r in S.scan_files(spark, tmpdir_path).collect()}
    assert got["a.TXT"] == ("txt", "text", True, "hello\nworld")
    assert got["bad.txt"][3] == ""  # invalid UTF-8 -> empty text
    assert got["c.png"][:2] == ("png", "image") and not got["c.png"][2]
    assert got["noext"][:2] == ("noext", "unsupported")
    assert got["d.weird"][1] == "unsupported"


def test_table_to_text_blocks(spark):
    df = spark.createDataFrame([(i, f"n,{i}" if i % 2 else f'q"{i}') for i in range(2500)], "k long, v string")
    blocks = {r.block_no: r for r in S.table_to_text(df, ["k"], block_rows=1000).collect()}
    assert sorted(blocks) == [0, 1, 2] and blocks[2].n_rows == 500
    lines = blocks[0].text.split("\n")
    assert lines[0] == "k,v" and lines[1] == '0,"q""0"' and lines[2] == '1,"n,1"'
    assert blocks[0].text.endswith("\n")


def test_page_coalesce_modes(spark):
    pages = spark.createDataFrame([(1, 1, " ", "ocr a"), (1, 2, "", "  "), (1, 3, "", "ocr c"), (2, 1, "layer", "x")],
                                  "doc_id long, page_no int, layer_text string, alt_text string")
    got = {r.doc_id: (r.source, r.text) for r in S.coalesce_pages(pages).collect()}
    assert got == {1: ("ocr", "ocr a\nocr c"), 2: ("layer", "layer")}


def test_store_roundtrip(spark, tmpdir_path):
    docs = read_table(spark, SF_SMALL, "documents").withColumnRenamed("source", "store_id")
    chunks = ST.build_chunks(docs)
    path = os.path.join(tmpdir_path, "store")
    ST.write_store(chunks, path)
    n_all = chunks.count()
    first = sorted(r.store_id for r in ST.list_stores(chunks).collect())[0]
    n_first = ST.read_store(spark, path, first).count()
    assert ST.read_store(spark, path).count() == n_all
    # replacing one store leaves the others untouched
    ST.write_store(chunks.filter(F.col("store_id") == first).limit(1), path)
    assert ST.read_store(spark, path).count() == n_all - n_first + 1
    assert ST.delete_store(spark, path, first) is True
    assert ST.delete_store(spark, path, first) is False
    assert ST.read_store(spark, path).count() == n_all - n_first


def test_large_text_files_keep_a_row(spark, tmpdir_path):
    for name, body in {"big.txt": b"x" * 100, "ok.csv": b"a,b", "c.png": b"p" * 500}.items():
        with open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(body)
    got = {r.filename: (r.success, r.message, r.text) for r in S.scan_files(spark, tmpdir_path, max_bytes=50).collect()}
    assert got == {"big.txt": (True, "Text extracted successfully", "x" * 100), "ok.csv": (True, "Text extracted successfully", "a,b"),
                   "c.png": (False, "No extractor for format: image", "")}


def test_csv_numbers_are_plain(spark):
    df = spark.createDataFrame([(1, 1.5e7), (2, 1e-4), (3, -2.25e-9), (4, 0.5), (5, 1e300), (6, None), (7, float("nan"))], "k long, x double")
    text = S.table_to_text(df, ["k"]).first().text
    assert text.split("\n")[1:-1] == ["1,15000000.0", "2,0.0001", "3,-0.00000000225", "4,0.5", "5,1.0E300", "6,", "7,NaN"]


def test_intervals_count_from_the_first_row(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1, 0, 0, 0, 700_000)
    rows = [("a", 0, "one"), ("a", 900, "late"), ("a", 1000, "two"), ("a", 1000, "twp"), ("a", 2500, " "), ("b", 0, "z"), (None, 0, "n")]
    df = spark.createDataFrame([(k, base + dt.timedelta(milliseconds=ms), t) for k, ms, t in rows], "k string, ts timestamp, t string")
    got = {r.k: (r.n_samples, r.text) for r in S.sample_intervals(df, "k", "ts", "t").collect()}
    assert got == {"a": (2, "one\n\ntwo"), "b": (1, "z"), None: (1, "n")}


def test_index_replaces_appends_and_answers(spark, tmpdir_path):
    from scriptorium.operators import vectors as V

    def docs(*rows):
        return spark.createDataFrame(rows, "store_id string, doc_id long, text string")

    def stores():
        return {r.store_id: (r.num_docs, r.num_chunks, r.metadata) for r in ST.read_stores(spark, path).collect()}

    path = os.path.join(tmpdir_path, "index")
    ST.write_index(docs(("a", 1, "the red fox"), ("b", 2, "april taxes"), ("c", 3, None)), path, metadata={"n": "1"})
    assert stores() == {"a": (1, 1, {"n": "1"}), "b": (1, 1, {"n": "1"}), "c": (1, 0, {"n": "1"})}
    for first in (True, False):  # the second run of a version adds nothing
        assert ST.write_index(docs(("a", 4, "a blue bird")), path, append=True, metadata={"n": "2"}, version=1) is first
    assert stores()["a"] == (2, 2, {"n": "2"})
    ST.write_index(docs(("b", 5, " ")), path)
    assert stores()["b"] == (1, 0, {}) and ST.read_index(spark, path, "b").count() == 0
    asked = spark.createDataFrame([(1, "a", "blue bird"), (2, "b", "x"), (3, "zz", "x")], "q long, store_id string, t string")
    got = {r.q: (r.status, r.chunks, r.metadata) for r in ST.query_index(spark, path, V.hash_embed(asked, "t", ["q", "store_id"]), "q").collect()}
    assert got == {1: ("ok", ["a blue bird", "the red fox"], {"n": "2"}), 2: ("ok", [], {}), 3: ("not found", None, None)}
    assert ST.delete_index(spark, path, "a") and "a" not in stores() and not ST.delete_index(spark, path, "a")


NUMBERS = ["007", "7", "1e1", "10", "true", "2024-01-01", "", "a=b/../c", None]


def test_store_ids_stay_text(spark, tmpdir_path):
    docs = spark.createDataFrame([(s, i, f"text of store {i}") for i, s in enumerate(NUMBERS)], "store_id string, doc_id long, text string")
    path, index = os.path.join(tmpdir_path, "plain"), os.path.join(tmpdir_path, "index")
    ST.write_store(ST.build_chunks(docs), path)
    ST.append_store(ST.build_chunks(docs.where("store_id = '7'").withColumn("doc_id", F.lit(70).cast("long"))), path)
    by_text = lambda x: (x is None, x or "")
    assert sorted((r.store_id for r in ST.list_stores(ST.read_store(spark, path)).collect()), key=by_text) == sorted(NUMBERS, key=by_text)
    assert [ST.read_store(spark, path, s).count() for s in ("007", "7", "1e1", "")] == [1, 2, 1, 1]
    ST.write_index(docs, index, version=0)
    ST.write_index(docs.withColumn("doc_id", F.col("doc_id") + 100), index, append=True, version=1)
    rows = {r.store_id: (r.num_docs, r.num_chunks) for r in ST.read_stores(spark, index).collect()}
    assert rows == {s: (2, 2) for s in NUMBERS}
    assert ST.delete_index(spark, index, "7") and ST.read_index(spark, index, "7").count() == 0
    assert sorted(r.doc_id for r in ST.read_index(spark, index, "007").collect()) == [0, 100]
    assert sorted((r.store_id for r in ST.read_stores(spark, index).collect()), key=by_text) == sorted(set(NUMBERS) - {"7"}, key=by_text)


def test_a_stopped_write_shows_nothing(spark, tmpdir_path, monkeypatch):
    from scriptorium.operators import vectors as V

    def docs(*rows):
        return spark.createDataFrame(rows, "store_id string, doc_id long, text string")

    def state():
        return ({r.store_id: (r.num_docs, r.num_chunks) for r in ST.read_stores(spark, path).collect()},
                sorted((r.store_id, r.doc_id) for r in ST.read_index(spark, path).collect()))

    path = os.path.join(tmpdir_path, "index")
    ST.write_index(docs(("a", 1, "one"), ("b", 2, "two")), path)
    before = state()

    def stop(*_):
        raise RuntimeError("stopped")
    for append in (True, False):
        with monkeypatch.context() as m:
            m.setattr(ST, "_commit", stop)
            try:
                ST.write_index(docs(("a", 3, "three")), path, append=append, version="x")
                raise AssertionError
            except RuntimeError:
                pass
        assert state() == before
    assert ST.write_index(docs(("a", 3, "three")), path, append=True, version="x")
    after = state()
    assert after == ({"a": (2, 2), "b": (1, 1)}, [("a", 1), ("a", 3), ("b", 2)])
    ST.write_index(docs(("b", 4, "four")), path)
    after = state()
    assert ST.vacuum_index(spark, path) == 4 - 2 and state() == after  # two stopped writes; a replaced store leaves its write to others
    asked = V.hash_embed(spark.createDataFrame([(1, "b", "four"), (2, "none", "x")], "q long, store_id string, t string"), "t", ["q", "store_id"])
    assert {r.q: (r.status, r.chunks) for r in ST.query_index(spark, path, asked, "q").collect()} == {1: ("ok", ["four"]), 2: ("not found", None)}


def test_results_of_a_batch_run_again(spark, tmpdir_path):
    jobs = spark.createDataFrame([("j1", "completed", "{}"), ("j2", "failed", None)], "job_id string, status string, result_json string")
    for _ in range(2):
        ST.write_results(jobs, tmpdir_path + "/r", batch=7)
    ST.write_results(jobs.where("job_id = 'j1'"), tmpdir_path + "/r")
    assert sorted((r.job_id, r.status) for r in ST.read_results(spark, tmpdir_path + "/r").collect()) == [("j1", "completed"), ("j1", "completed"), ("j2", "failed")]


def test_large_text_files_keep_all_their_text(spark, tmpdir_path):
    import random

    rng = random.Random(2)
    body = lambda n: "\n".join("é" * rng.randrange(0, 30) + str(i) for i in range(n))
    files = {"a.txt": body(900).encode(), "with end [1].txt": (body(500) + "\n").encode(), "100%+c.csv": b"\n\n" + body(300).encode() + b"\n\n", "bad.txt": body(300).encode() + b"\xff\n" + b"x" * 900,
             "small.txt": b"few\n", "crlf.txt": b"a\r\nb\r\n" * 300}
    for name, raw in files.items():
        with open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = S.scan_files(spark, tmpdir_path, max_bytes=1000, part_bytes=700).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(rows, key=lambda r: r.part_no):
        assert r.success and len(r.text.encode()) <= 900
        got.setdefault(r.filename, []).append(r.text)
    assert {k: "".join(v) for k, v in got.items()} == {k: "" if k == "bad.txt" else v.decode() for k, v in files.items()}
    assert len(got["a.txt"]) > 5 and len(got["small.txt"]) == len(got["bad.txt"]) == 1
