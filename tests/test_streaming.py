import datetime as dt
import os
import time

from pyspark.sql import functions as F

from scriptorium.functions.text import dedup_lines
from scriptorium.session import read_table
from scriptorium.operators import jobs as J
from scriptorium.sources import stores as ST
from scriptorium.streaming import pipelines as P

from conftest import SF_SMALL


def test_ingest_equals_batch(spark, tmpdir_path):
    docs = read_table(spark, SF_SMALL, "documents")
    src = os.path.join(tmpdir_path, "in")
    docs.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(tmpdir_path, "out")
    q = P.ingest(stream, out, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(300)
    res = spark.read.parquet(os.path.join(out, "results"))
    exp = docs.select("doc_id", dedup_lines("text").alias("text"))
    assert res.select("doc_id", "text").exceptAll(exp).count() == 0
    assert res.count() == docs.count()
    # a pending and a final event per document, as the job table reads them
    now = J.current_jobs(spark.read.parquet(os.path.join(out, "job_events")))
    assert {r["status"]: r["count"] for r in now.groupBy("status").count().collect()} == {"completed": docs.count()}


def test_index_keeps_every_batch(spark, tmpdir_path):
    src, store = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "store")
    for i in range(2):
        spark.createDataFrame([("s", i, f"document number {i}")], "store_id string, doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("store_id string, doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(src)
    P.index_stream(stream, store, os.path.join(tmpdir_path, "ckpt")).awaitTermination(300)
    assert sorted(r["doc_id"] for r in ST.read_index(spark, store, "s").collect()) == [0, 1]
    assert [(r.store_id, r.num_docs, r.num_chunks) for r in ST.read_stores(spark, store).collect()] == [("s", 2, 2)]
    assert not ST.delete_index(spark, store, "s/../../../in") and not ST.delete_index(spark, store, "../in")
    assert os.path.isdir(src) and ST.delete_index(spark, store, "s") and not ST.delete_index(spark, store, "s")


def test_results_keep_earlier_batches(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "results")
    for i in range(2):
        ST.write_results(spark.createDataFrame([(f"j{i}", "completed", "{}"), (f"k{i}", "failed", None)], "job_id string, status string, result_json string"), path)
    got = spark.read.text(path)
    assert got.count() == 4 and got.filter("status = 'failed' and value like '%\"k1\"%'").count() == 1
    gone = spark.createDataFrame([("k1",), ("zz",)], "job_id string")
    ST.compact_results(spark, path, path + "-left", gone)
    assert sorted((r.job_id, r.status) for r in ST.read_results(spark, path + "-left").collect()) == [
        ("j0", "completed"), ("j1", "completed"), ("k0", "failed")]


def test_store_ids_are_not_paths(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "store")
    ST.write_store(spark.createDataFrame([("a:b/c", 1, 0, "x"), ("ok", 2, 0, "y")], "store_id string, doc_id long, chunk_no int, chunk string"), path)
    assert ST.delete_store(spark, path, "a:b/c")
    assert [r["store_id"] for r in ST.read_store(spark, path).collect()] == ["ok"]


def test_dedup_within_watermark(spark, tmpdir_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i), "same" if i % 2 else f"t{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, ts timestamp, text string")
    src = os.path.join(tmpdir_path, "dd")
    df.write.parquet(src)
    s = P.dedup_contents(spark.readStream.schema(df.schema).parquet(src), watermark="1 hour")
    q = s.writeStream.format("memory").queryName("dd_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dd_out").count() == 6  # 5 distinct t{i} + one 'same'


def test_rate_limit_stream_golden(spark, tmpdir_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB_PROVIDER)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "c", base + dt.timedelta(seconds=s), "/api/x") for i, s in enumerate([0, 10, 20, 60, 69, 70])]
    df = spark.createDataFrame(rows, "event_id long, client string, ts timestamp, path string")
    src = os.path.join(tmpdir_path, "rq")
    df.coalesce(1).write.parquet(src)
    s = P.rate_limit_stream(spark.readStream.schema(df.schema).parquet(src), limit=2, window_s=60)
    q = s.writeStream.format("memory").queryName("rl_out").outputMode("append") \
        .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [r.accepted for r in spark.table("rl_out").orderBy("event_id").collect()]
    assert got == [True, True, False, True, False, True]


def test_job_status_stream(spark, tmpdir_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base, 1, "pending"), ("a", base + dt.timedelta(seconds=5), 2, "completed"),
            ("b", base, 3, "pending")]
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, seq long, status string")
    src = os.path.join(tmpdir_path, "je")
    df.write.parquet(src)
    s = P.job_status_stream(spark.readStream.schema(df.schema).parquet(src))
    q = s.writeStream.format("memory").queryName("js_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.job_id: r.status for r in spark.table("js_out").collect()} == {"a": "completed", "b": "pending"}


def run(stream, name, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(240)


def feed(spark, src, schema, batches):
    """One file per batch, read one at a time in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_sampling_stream_equals_batch(spark, tmpdir_path):
    from scriptorium.sources import documents as S

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB_PROVIDER)
    base, schema = dt.datetime(2024, 1, 1, 0, 0, 0, 700_000), "k string, ts timestamp, text string"
    at = lambda k, ms, x: (k, base + dt.timedelta(milliseconds=ms), x)
    # rows out of order within the watermark, ties, blanks; the last batch moves the watermark past all
    batches = [[at("a", 400, "b"), at("a", 0, "a"), at("b", 5000, "late first")], [at("a", 1300, "d"), at("a", 1000, "c"), at("b", 4900, "first"), at("a", 2100, " "), at("a", 2100, "e")],
               [at("a", 9000, "z"), at("a", 9000, "y"), at("b", 5899, "same"), at("b", 5900, "next")], [at("end", 10**6, "x")], [at("end", 2 * 10**6, "x")]]
    src = os.path.join(tmpdir_path, "smp")
    stream = feed(spark, src, schema, batches)
    run(P.sample_intervals_stream(stream, "k", "ts", "text", 1.0, "10 seconds"), "smp_out", os.path.join(tmpdir_path, "ck"))
    got = {}
    for r in spark.table("smp_out").orderBy("t_us").collect():
        got.setdefault(r["key"], []).append(r["text"])
    want = {r["k"]: r["text"].split("\n\n") for r in S.sample_intervals(spark.read.parquet(src), "k", "ts", "text").collect()}
    assert got["a"] == want["a"] == ["a", "c", "y"] and got["b"] == want["b"] == ["first", "next"]


def test_results_are_reused_on_a_stream(spark, tmpdir_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB_PROVIDER)
    log = os.path.join(tmpdir_path, "log")

    def work(text):
        with open(log, "a") as f:  # the test runs in one process tree
            f.write("run\n")
        return text.upper()
    stream = feed(spark, os.path.join(tmpdir_path, "in"), "doc_id long, text string", [[(1, "a"), (2, "a"), (3, "b")], [(4, "a"), (5, None)], [(6, "b"), (7, "c")]])
    run(P.reuse_results(stream, "doc_id", "text", work), "reuse_out", os.path.join(tmpdir_path, "ck"))
    got = {int(r["key"]): (r["result"], r["reused"]) for r in spark.table("reuse_out").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "A", 2: "A", 3: "B", 4: "A", 5: None, 6: "B", 7: "C"}
    assert [sum(not got[k][1] for k in ks) for ks in ((1, 2, 4), (3, 6), (7,))] == [1, 1, 1]
    assert len(open(log).readlines()) == 3


def test_job_lifecycle_times_out_and_never_goes_back(spark, tmpdir_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB_PROVIDER)
    base, schema = dt.datetime(2024, 1, 1), "job_id string, ts timestamp, status string, error string"
    at = lambda j, s, st, e=None: (j, base + dt.timedelta(seconds=s), st, e)
    batches = [[at("done", 0, "pending"), at("lost", 0, "pending")], [at("done", 5, "processing"), at("bad", 6, "pending"), at("lost", 7, "processing"), at("done", 1, "pending")],
               [at("done", 9, "completed"), at("done", 8, "processing"), at("bad", 10, "failed", "no text")], [at("clock", 5000, "pending")], [at("clock", 5001, "processing")]]
    run(P.job_lifecycle(feed(spark, os.path.join(tmpdir_path, "in"), schema, batches), timeout_s=600), "life_out", os.path.join(tmpdir_path, "ck"))
    rows = spark.table("life_out").collect()
    by = {j: [(r["status"], r["error"]) for r in sorted((r for r in rows if r["job_id"] == j), key=lambda r: r["ts"])] for j in ("done", "bad", "lost")}
    assert by == {"done": [("pending", None), ("processing", None), ("completed", None)], "bad": [("pending", None), ("failed", "no text")],
                  "lost": [("pending", None), ("processing", None), ("failed", P.TIMED_OUT)]}
    assert next(r["ts"] for r in rows if r["error"] == P.TIMED_OUT) == base + dt.timedelta(seconds=607)


def test_ingest_shows_every_state_with_real_times(spark, tmpdir_path, monkeypatch):
    seen, began = [], time.time()
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    stream = feed(spark, src, "doc_id long, text string", [[(1, "a\na"), (2, None)], [(3, "c")]])

    def clock():  # asked before each step's events are written
        path = os.path.join(out, "job_events")
        if os.path.isdir(path):
            seen.append({r["job_id"]: r["status"] for r in J.current_jobs(spark.read.parquet(path)).collect()})
        return time.time()
    P.ingest(stream, out, os.path.join(tmpdir_path, "ck"), clock=clock).awaitTermination(240)
    assert {"1": "pending", "2": "pending"} in seen and {"1": "processing", "2": "processing"} in seen
    now = J.current_jobs(spark.read.parquet(os.path.join(out, "job_events"))).collect()
    assert {r["job_id"]: (r["status"], r["error"]) for r in now} == {"1": ("completed", None), "2": ("failed", "no text"), "3": ("completed", None)}
    assert all(began <= r["created_at"].timestamp() <= r["updated_at"].timestamp() <= time.time() for r in now)


def test_quiet_clients_leave_no_state(spark, tmpdir_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB_PROVIDER)
    base = dt.datetime(2024, 1, 1)
    src, ck = os.path.join(tmpdir_path, "rq"), os.path.join(tmpdir_path, "ck")
    schema = "event_id long, client string, ts timestamp, path string"
    for i, (client, day) in enumerate([("a", 0), ("b", 1), ("b", 2)]):
        spark.createDataFrame([(i, client, base + dt.timedelta(days=day), "/api/x")], schema).coalesce(1).write.mode("append").parquet(src)
    s = P.rate_limit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), limit=2, window_s=60)
    q = s.writeStream.format("memory").queryName("quiet_out").outputMode("append").option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert [r.accepted for r in spark.table("quiet_out").collect()] == [True] * 3
    left = spark.read.format("statestore").option("stateVarName", "log").load(ck)
    assert {r["key"][0] for r in left.select("key").collect()} <= {"b"}
