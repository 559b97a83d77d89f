import datetime as dt
import random

from scriptorium.operators import rate as R


def reqs(spark, rows):
    return spark.createDataFrame(rows, "event_id long, client string, ts timestamp, path string")


def brute(rows, limit, window_s):
    logs, out = {}, {}
    for eid, c, ts, p in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if p in R.EXEMPT_PATHS:
            out[eid] = True
            continue
        t = ts.timestamp()
        log = [x for x in logs.get(c, []) if t - x < window_s]
        if len(log) >= limit:
            out[eid] = False
        else:
            log.append(t)
            out[eid] = True
        logs[c] = log
    return out


def test_golden(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "c", base + dt.timedelta(seconds=s), "/api/x") for i, s in enumerate([0, 10, 20, 60, 69, 70])]
    df = reqs(spark, rows)
    assert [r.accepted for r in R.rate_limit_flags(df, 2, 60).orderBy("event_id").collect()] == [True, True, False, True, False, True]
    assert [r.requests_made for r in R.rate_status(df, 2, 60).orderBy("event_id").collect()] == [1, 2, 3, 3, 4, 4]


def test_hot_client_against_brute_force(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for c, n, span in (("hot", 3000, 3600), ("cold", 200, 36000), ("mid", 600, 7200)):
        for _ in range(n):
            ts = base + dt.timedelta(microseconds=rnd.randrange(span * 1_000_000))
            rows.append((eid, c, ts, "/health" if rnd.random() < 0.05 else "/api/x"))
            eid += 1
    df = reqs(spark, rows)
    for limit, win in ((5, 10), (2, 60), (50, 600)):
        got = {r.event_id: r.accepted for r in R.rate_limit_flags(df, limit, win).collect()}
        assert got == brute(rows, limit, win)


def test_client_key(spark):
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2", None, "h"), ("", "3.3.3.3", "h"), (None, None, None), (None, "", "h")],
                               "x_forwarded_for string, x_real_ip string, host string")
    assert [r.k for r in df.select(R.client_key().alias("k")).collect()] == ["1.1.1.1", "3.3.3.3", "unknown", "h"]


def test_real_limit_bursts_ties_and_nulls(spark, monkeypatch):
    """100 in 60 s: calm hours, bursts that overload several ranges, many requests at
    one time; the plan is the same for any limit."""
    rnd = random.Random(8)
    base = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for c, start, n, span in (("a", 0, 900, 3600), ("a", 3600, 2500, 900), ("a", 5000, 300, 3600), ("b", 0, 1500, 600), ("b", 700, 400, 1), ("z", 0, 250, 0), (None, 0, 300, 100)):
        for _ in range(n):
            rows.append((eid, c, base + dt.timedelta(seconds=start, milliseconds=100 * rnd.randrange(span * 10 + 1)), "/" if rnd.random() < 0.03 else "/api"))
            eid += 1
    want = brute([(i, c or "", t, p) for i, c, t, p in rows], R.DEFAULT_LIMIT, R.DEFAULT_WINDOW_S)
    assert 0 < sum(want.values()) < len(want)
    df = reqs(spark, [*rows, (eid, "a", None, "/api")]).repartition(5)
    for buckets in (1, 4, 32):
        monkeypatch.setattr(R, "RANGE_BUCKETS", buckets)
        got = {r.event_id: r.accepted for r in R.rate_limit_flags(df).collect()}
        assert got.pop(eid) is True and got == want
    size = [len(R.rate_limit_flags(df, limit)._jdf.queryExecution().optimizedPlan().toString()) for limit in (2, 900)]
    assert abs(size[0] - size[1]) < 20


def test_dense_windows_are_running_sums(spark):
    """Many requests in one window, ties at its ends, overload across batches: no sliding
    frame, which would count each window anew."""
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, f"c{i % 2}", base + dt.timedelta(milliseconds=500 * rnd.randrange(600)), "/api") for i in range(12000)]
    df = reqs(spark, rows).repartition(3)
    flags, status = R.rate_limit_flags(df), R.rate_status(df)
    assert {r.event_id: r.accepted for r in flags.collect()} == brute(rows, R.DEFAULT_LIMIT, R.DEFAULT_WINDOW_S)
    made = {r.event_id: r.requests_made for r in status.collect()}
    for i, c, t, _ in rows[::400]:
        assert made[i] == sum(c == c2 and 0 <= (t - t2).total_seconds() < 60 for _, c2, t2, _ in rows)
    for d in (flags, status):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedpreceding" in plan.lower() and "RangeFrame, -" not in plan
