import datetime as dt

from scriptorium.operators import jobs as J

SCHEMA = "job_id string, ts timestamp, seq long, status string, filename string, result_json string, error string"


def t(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_jobs_golden(spark):
    ev = spark.createDataFrame([
        ("a", t(1), 1, "pending", "a.png", None, None),
        ("b", t(2), 2, "pending", "b.png", None, None),
        ("a", t(3), 3, "pending", "a2.png", None, None),
        ("a", t(4), 4, "completed", None, '{"text": "x"}', None),
        ("a", t(5), 5, "processing", None, None, None),
        ("z", t(6), 6, "completed", None, None, None),
    ], SCHEMA)
    ins = {(r.job_id, r.seq): r.accepted for r in J.insert_outcomes(ev).collect()}
    assert ins == {("a", 1): True, ("b", 2): True, ("a", 3): False}
    cur = {r.job_id: r for r in J.current_jobs(ev).collect()}
    assert set(cur) == {"a", "b"}
    assert cur["a"].status == "processing" and cur["a"].result_json is None
    assert cur["a"].created_at == t(1) and cur["a"].updated_at == t(5) and cur["a"].filename == "a.png"
    assert cur["b"].status == "pending" and cur["b"].updated_at == t(2)
    jobs = J.current_jobs(ev)
    assert [r.job_id for r in J.list_jobs(jobs).collect()] == ["b", "a"]
    assert [r.job_id for r in J.list_jobs(jobs, status="pending").collect()] == ["b"]
    assert [r.job_id for r in J.delete_jobs(jobs, jobs.filter("job_id = 'b'")).collect()] == ["a"]
    got = J.get_job(J.current_jobs(ev.filter("seq <> 5")), "a").first()
    assert got.result == {"text": "x"}
