"""Request-rate operators (R1-R3) over a request log ``(client, ts, path)``.

Trailing counts use a time-bucket decomposition instead of one window per
client: every request lands in bucket floor(ts / window) and is copied once
into the following bucket, so the range window runs per (client, bucket) and
a hot client is spread over all its buckets.  A request counts from its time on and
no more when its window ends, so counts are running sums: time grows with the
requests, however many of them are in one window.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import py_strip

# Limits of the reference and its exempt paths.
DEFAULT_LIMIT = 100
DEFAULT_WINDOW_S = 60
EXEMPT_PATHS: tuple[str, ...] = ("/health", "/")
#: time buckets (of one window each) that share one anchor
RANGE_BUCKETS = 32


def client_key(xff: str = "x_forwarded_for", real_ip: str = "x_real_ip", host: str = "host"):
    """First X-Forwarded-For entry (stripped) if the header is non-empty,
    else a non-empty X-Real-IP, else the peer host, else 'unknown'."""
    f, r = F.col(xff), F.col(real_ip)
    return (F.when(f.isNotNull() & (f != ""), py_strip(F.split(f, ",", 2)[0]))
            .when(r.isNotNull() & (r != ""), r)
            .otherwise(F.coalesce(F.col(host), F.lit("unknown"))))


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing_counts(requests: DataFrame, window_s: int, key: str = "client", ts: str = "ts",
                    id_col: str = "event_id") -> DataFrame:
    """Per request: number of requests of the same key with age < window,
    itself included (ties at the same microsecond count each other)."""
    w_us = window_s * 1_000_000
    base = requests.select(key, id_col, _micros(ts).alias("_t")).withColumn("_own", F.floor(F.col("_t") / w_us))
    return _crowd(base, w_us, key, 1).filter("_lag = 0").select(key, id_col, "made")


def _until_now(key: str) -> Window:
    return Window.partitionBy(key, "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)


def _crowd(base: DataFrame, w_us: int, key: str, reach: int) -> DataFrame:
    """``base`` (_t, its bucket _own) in its bucket and the next ``reach``, as ``_b``: a row
    at the request's time (``_d`` 1) and, in later buckets, one at the end of its window
    (``_d`` -1); ``made`` is their sum so far."""
    def row(lag: int, at, d):
        return F.struct(F.lit(lag).alias("_lag"), at.alias("_at"), d.alias("_d"))

    t, ends = F.col("_t"), F.when(F.col("_t").isNotNull(), F.lit(-1))
    rows = [row(i, t, F.lit(1)) for i in range(reach + 1)] + [row(i, t + w_us, ends) for i in range(1, reach + 1)]
    dealt = base.select("*", F.inline(F.array(*rows))).withColumn("_b", F.col("_own") + F.col("_lag"))
    return dealt.withColumn("made", F.sum("_d").over(_until_now(key)))


def rate_status(requests: DataFrame, limit: int = DEFAULT_LIMIT, window_s: int = DEFAULT_WINDOW_S,
                exempt: Sequence[str] = EXEMPT_PATHS) -> DataFrame:
    """R2: requests made in the window and the remaining allowance, as seen
    by every (non-exempt) request."""
    counted = requests.filter(~F.col("path").isin(list(exempt)))
    tc = trailing_counts(counted, window_s)
    return tc.select("client", "event_id", F.col("made").cast("bigint").alias("requests_made"),
                     F.greatest(F.lit(limit) - F.col("made"), F.lit(0)).cast("bigint").alias("remaining"),
                     F.lit(limit).alias("limit"), F.lit(window_s).alias("window_seconds"))


def rate_limit_flags(requests: DataFrame, limit: int = DEFAULT_LIMIT, window_s: int = DEFAULT_WINDOW_S,
                     exempt: Sequence[str] = EXEMPT_PATHS) -> DataFrame:
    """Accepted / rejected per request under the sliding-window log.

    The decision is sequential only inside overload episodes.  A request is a *cut*
    when every request of its client in the window that ends with it had fewer than
    ``limit`` requests in the window before: those were certainly accepted, so the log
    at the cut is the window itself, whatever came earlier.

    1. One window stage finds the cuts.  Requests are dealt by (client, time bucket) and
       copied into the next two buckets, so a bucket sees all that its cuts depend on:
       running counts, and the last request so far that had too many before it.
    2. The first cut of each range of ``RANGE_BUCKETS`` buckets is an *anchor*.  A request
       belongs to the latest anchor up to it; one in the window before the next
       anchor goes there as well, as an entry of its log.
    3. Rows are dealt by (client, anchor) and sorted; one pass per partition carries the
       log from row to row; while the log is full, it goes on at the row for which the
       first entry has expired.  The plan does not grow with ``limit``.

    Only a client in uninterrupted overload has ranges without an anchor, which join the
    pass before them, as the semantics require.  Exempt paths are always accepted and
    never recorded; requests at the same time go by ``event_id``; a null time or client
    is a request of its own kind: null clients are one client, and requests without
    a time are accepted and not recorded.
    """
    w_us = window_s * 1_000_000
    at = F.struct(F.col("_t").alias("t"), F.col("event_id").alias("id"))
    exempted = F.col("path").isin(list(exempt))
    counted = requests.where(~F.coalesce(exempted, F.lit(False)) & F.col("ts").isNotNull())
    base = counted.select("client", "event_id", _micros("ts").alias("_t")).withColumn("_own", F.floor(F.col("_t") / w_us))
    busy = _crowd(base, w_us, "client", 2)
    full = F.max(F.when((F.col("_d") == 1) & (F.col("made") > limit), F.col("_at"))).over(_until_now("client"))
    rows = busy.withColumn("_cut", F.coalesce(F.col("_at") - full >= w_us, F.lit(True))).where("_lag = 0") \
        .select("client", "event_id", "_t", "_cut", F.floor(F.col("_own") / RANGE_BUCKETS).alias("_r"))

    # per (client, range): its anchor, the latest one before it and the first one after it
    anchors = rows.groupBy("client", "_r").agg(F.min(F.when(F.col("_cut"), at)).alias("_here"))
    ranges = Window.partitionBy("client").orderBy("_r")
    anchors = anchors.withColumns({"_last": F.max("_here").over(ranges.rowsBetween(Window.unboundedPreceding, -1)),
                                   "_next": F.min("_here").over(ranges.rowsBetween(1, Window.unboundedFollowing))})
    placed = rows.alias("x").join(anchors.alias("y"), F.expr("x.client <=> y.client and x._r = y._r")) \
        .select("x.client", "event_id", "_t", "_here", "_last", "_next", at.alias("_at"))
    inside = F.col("_at") >= F.col("_here")  # null without an anchor in the range
    start = F.struct(F.lit(-(1 << 62)).alias("t"), F.lit(-(1 << 62)).cast("bigint").alias("id"))  # where many first requests tie
    own = F.coalesce(F.when(inside, F.col("_here")).otherwise(F.col("_last")), start)
    after = F.when(inside | F.col("_here").isNull(), F.col("_next")).otherwise(F.col("_here"))
    entry = F.when(F.col("_t") > after["t"] - w_us, F.struct(after.alias("seg"), F.lit(True).alias("logged")))
    work = placed.select("client", "event_id", "_t", F.explode(F.array_compact(F.array(F.struct(own.alias("seg"), F.lit(False).alias("logged")), entry))).alias("_s")) \
        .select("client", F.col("_s.seg.t").alias("_s_t"), F.col("_s.seg.id").alias("_s_id"), "_t", "event_id", F.col("_s.logged").alias("_logged"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, log = None, deque()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(k) for k in keyed]
            t, logged = batch.column("_t").to_pylist(), batch.column("_logged").to_pylist()
            change = np.ones(n, dtype=bool)
            change[1:] = ~np.logical_and.reduce([pc.equal(k[1:], k[:-1]).fill_null(False).to_numpy(zero_copy_only=False) for k in keys])
            accepted = np.zeros(n, dtype=bool)
            starts = np.flatnonzero(change).tolist()
            for i, end in zip(starts, [*starts[1:], n]):
                here = tuple(k[i].as_py() for k in keys)
                if here != seg:
                    seg, log = here, deque()
                while i < end:
                    while log and t[i] - log[0] >= w_us:
                        log.popleft()
                    if not logged[i] and len(log) >= limit:  # entries of the log come before all others
                        i = bisect_left(t, log[0] + w_us, i + 1, end) if log else end
                        continue
                    accepted[i] = True
                    log.append(t[i])
                    i += 1
            own = pc.invert(batch.column("_logged"))
            yield pa.RecordBatch.from_arrays([c.filter(own) for c in (batch.column("client"), batch.column("event_id"), pa.array(accepted))],
                                             names=["client", "event_id", "accepted"])

    keyed = ["client", "_s_t", "_s_id"]
    decided = work.repartition(*keyed).sortWithinPartitions(*keyed, "_t", "event_id").mapInArrow(
        decide, "client string, event_id bigint, accepted boolean")
    free = requests.where(F.coalesce(exempted, F.lit(False)) | F.col("ts").isNull())
    return decided.unionByName(free.select("client", "event_id", F.lit(True).alias("accepted")))
