"""Job-store and request-rate queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import jobs as J
from scriptorium.operators import rate as R
from scriptorium.plans import sqlfrag as Q
from scriptorium.plans.registry import register
from scriptorium.session import read_table
from scriptorium.sources import derived as D

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
RATE_LIMIT = 2          # small limit and long window so the test data hits the limit
RATE_WINDOW_S = 3600


def _ts(c):
    return F.date_format(c, TS_FMT).alias(c)


def _events(spark, sf):
    return D.job_events(read_table(spark, sf, "events"))


def _current(spark, sf):
    return J.current_jobs(_events(spark, sf))


SQL_JOB_EVENTS = """
je AS (SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq,
              CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_type IN ('view', 'click') THEN 'processing'
                   WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed'
                   ELSE event_type END AS status,
              'file_' || CAST(user_id AS VARCHAR) || '.png' AS filename,
              CASE WHEN event_type = 'purchase' THEN props END AS result_json,
              CASE WHEN event_type = 'error' THEN 'error in event ' || CAST(event_id AS VARCHAR) END AS error
       FROM events),
ins AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS rn FROM je WHERE status = 'pending'),
created AS (SELECT job_id, ts AS c_ts, seq AS c_seq, filename FROM ins WHERE rn = 1),
ups AS (SELECT e.* FROM je e JOIN created c USING (job_id)
        WHERE e.status <> 'pending' AND (e.ts > c.c_ts OR (e.ts = c.c_ts AND e.seq > c.c_seq))),
allst AS (SELECT job_id, 'pending' AS status, CAST(NULL AS VARCHAR) AS result_json, CAST(NULL AS VARCHAR) AS error,
                 c_ts AS ts, c_seq AS seq FROM created
          UNION ALL SELECT job_id, status, result_json, error, ts, seq FROM ups),
latest AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM allst),
jobs AS (SELECT c.job_id, l.status, c.filename, c.c_ts AS created_at, l.ts AS updated_at, l.result_json, l.error
         FROM created c JOIN latest l ON l.job_id = c.job_id AND l.rn = 1)"""

F_TS = "'%Y-%m-%d %H:%M:%S.%f'"


@register("jobs_insert", f"""WITH {SQL_JOB_EVENTS}
SELECT job_id, seq, strftime(ts, {F_TS}) AS ts, rn = 1 AS accepted FROM ins""")
def jobs_insert(spark, sf):
    """Inserts; a repeated id is refused."""
    return J.insert_outcomes(_events(spark, sf)).select("job_id", "seq", _ts("ts"), "accepted")


@register("jobs_current", f"""WITH {SQL_JOB_EVENTS}
SELECT job_id, status, filename, strftime(created_at, {F_TS}) AS created_at,
       strftime(updated_at, {F_TS}) AS updated_at, result_json, error FROM jobs""")
def jobs_current(spark, sf):
    """Current state of every job from the event log."""
    j = _current(spark, sf)
    return j.select("job_id", "status", "filename", _ts("created_at"), _ts("updated_at"), "result_json", "error")


@register("jobs_parsed", f"""WITH {SQL_JOB_EVENTS}
SELECT job_id, status, json_extract_string(result_json, '$.k') AS result_k FROM jobs""")
def jobs_parsed(spark, sf):
    """Job rows with the JSON result parsed (one key shown)."""
    j = J.with_parsed_result(_current(spark, sf))
    return j.select("job_id", "status", F.col("result")["k"].alias("result_k"))


@register("jobs_list", f"""WITH {SQL_JOB_EVENTS}
SELECT job_id, status, strftime(created_at, {F_TS}) AS created_at, strftime(updated_at, {F_TS}) AS updated_at,
       filename, error FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT {J.DEFAULT_LIST_LIMIT}""")
def jobs_list(spark, sf):
    """Newest 100 jobs."""
    j = J.list_jobs(_current(spark, sf))
    return j.select("job_id", "status", _ts("created_at"), _ts("updated_at"), "filename", "error")


@register("jobs_list_completed", f"""WITH {SQL_JOB_EVENTS}
SELECT job_id, status, strftime(created_at, {F_TS}) AS created_at, strftime(updated_at, {F_TS}) AS updated_at,
       filename, error FROM jobs WHERE status = 'completed' ORDER BY created_at DESC, job_id DESC LIMIT {J.DEFAULT_LIST_LIMIT}""")
def jobs_list_completed(spark, sf):
    """J4 with a status filter."""
    j = J.list_jobs(_current(spark, sf), status="completed")
    return j.select("job_id", "status", _ts("created_at"), _ts("updated_at"), "filename", "error")


@register("jobs_delete", f"""WITH {SQL_JOB_EVENTS}
SELECT job_id, status FROM jobs WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'failed')""")
def jobs_delete(spark, sf):
    """The job table after deleting every failed job."""
    jobs = _current(spark, sf)
    return J.delete_jobs(jobs, jobs.filter(F.col("status") == "failed")).select("job_id", "status")


SQL_STATES = """
SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, state,
       CASE state WHEN 'PROCESSING' THEN 'processing' WHEN 'SUCCESS' THEN 'completed' WHEN 'FAILURE' THEN 'failed' END AS job_status,
       CASE WHEN state = 'PENDING' THEN 'Task is waiting to be processed'
            WHEN state = 'FAILURE' THEN 'error in event ' || CAST(event_id AS VARCHAR)
            WHEN state IN ('PROCESSING', 'SUCCESS') THEN props END AS detail
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'PROCESSING'
                     WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' ELSE upper(event_type) END AS state
      FROM events)"""


@register("job_state_map", SQL_STATES)
def job_state_map(spark, sf):
    """Task state -> status response and job status, per event."""
    ev = read_table(spark, sf, "events")
    state = (F.when(F.col("event_type") == "signup", "PENDING")
             .when(F.col("event_type").isin("view", "click"), "PROCESSING")
             .when(F.col("event_type") == "purchase", "SUCCESS")
             .when(F.col("event_type") == "error", "FAILURE")
             .otherwise(F.upper("event_type")))
    t = ev.select("event_id", F.col("user_id").cast("string").alias("job_id"), state.alias("state"),
                  F.col("props").alias("info"),
                  F.concat(F.lit("error in event "), F.col("event_id").cast("string")).alias("error"))
    return J.task_states(t).select("event_id", "job_id", "state", "job_status", "detail")


# ------------------------------------------------------------------ rate


SQL_REQUESTS = """
rq AS (SELECT event_id, CAST(user_id AS VARCHAR) AS client, CAST(ts AS TIMESTAMP) AS ts,
              CASE WHEN event_type = 'view' THEN '/health' ELSE '/api/' || event_type END AS path FROM events)"""


@register("rate_status", f"""WITH {SQL_REQUESTS}
SELECT client, event_id, CAST(made AS BIGINT) AS requests_made, CAST(greatest({RATE_LIMIT} - made, 0) AS BIGINT) AS remaining,
       {RATE_LIMIT} AS "limit", {RATE_WINDOW_S} AS window_seconds
FROM (SELECT *, count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts)
                               RANGE BETWEEN {RATE_WINDOW_S * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS made
      FROM rq WHERE path NOT IN ('/health', '/'))""")
def rate_status(spark, sf):
    """R2: requests made in the trailing window and remaining allowance."""
    return R.rate_status(D.requests(read_table(spark, sf, "events")), RATE_LIMIT, RATE_WINDOW_S)


_W_US = RATE_WINDOW_S * 1_000_000


@register("rate_limit_flags", f"""WITH RECURSIVE {SQL_REQUESTS},
o AS (SELECT client, event_id, epoch_us(ts) AS t,
             row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS rn
      FROM rq WHERE path NOT IN ('/health', '/')),
r(client, rn, event_id, accepted, log) AS (
  SELECT client, rn, event_id, true, [t] FROM o WHERE rn = 1
  UNION ALL
  SELECT o.client, o.rn, o.event_id,
         len(list_filter(r.log, lambda x: o.t - x < {_W_US})) < {RATE_LIMIT},
         CASE WHEN len(list_filter(r.log, lambda x: o.t - x < {_W_US})) < {RATE_LIMIT}
              THEN list_append(list_filter(r.log, lambda x: o.t - x < {_W_US}), o.t)
              ELSE list_filter(r.log, lambda x: o.t - x < {_W_US}) END
  FROM r JOIN o ON o.client = r.client AND o.rn = r.rn + 1)
SELECT client, event_id, accepted FROM r
UNION ALL
SELECT client, event_id, true FROM rq WHERE path IN ('/health', '/')""")
def rate_limit_flags(spark, sf):
    """accepted/rejected under the sliding-window log (limit 2 per hour)."""
    return R.rate_limit_flags(D.requests(read_table(spark, sf, "events")), RATE_LIMIT, RATE_WINDOW_S)


SQL_BUSY = """
rq AS (SELECT 'c' || CAST(user_id % 3 AS VARCHAR) AS client, event_id, epoch_us(ts) // 1000 AS t,
              CASE WHEN event_type = 'view' THEN '/health' ELSE '/api' END AS path FROM events)"""
_MINUTE = 60_000_000


@register("rate_limit_default", f"""WITH RECURSIVE {SQL_BUSY},
o AS (SELECT client, event_id, t, row_number() OVER (PARTITION BY client ORDER BY t, event_id) AS rn FROM rq WHERE path <> '/health'),
r(client, rn, event_id, accepted, log) AS (
  SELECT client, rn, event_id, true, [t] FROM o WHERE rn = 1
  UNION ALL
  SELECT client, rn, event_id, len(live) < 100, CASE WHEN len(live) < 100 THEN list_append(live, t) ELSE live END
  FROM (SELECT o.client, o.rn, o.event_id, o.t, list_filter(r.log, lambda x: o.t - x < {_MINUTE}) AS live
        FROM r JOIN o ON o.client = r.client AND o.rn = r.rn + 1))
SELECT client, event_id, accepted FROM r
UNION ALL
SELECT client, event_id, true FROM rq WHERE path = '/health'""")
def rate_limit_default(spark, sf):
    """R1 at its real limit, 100 in 60 s: three clients send all events, a thousand
    times as fast."""
    ev = read_table(spark, sf, "events")
    busy = ev.select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("client"),
                     F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)).alias("ts"),
                     F.when(F.col("event_type") == "view", "/health").otherwise("/api").alias("path"))
    return R.rate_limit_flags(busy)


@register("client_key", f"""
WITH h AS (SELECT event_id,
             CASE WHEN user_id % 4 = 0 THEN ' 10.1.' || CAST(user_id % 250 AS VARCHAR) || '.' || CAST(event_id % 250 AS VARCHAR) || ' , 172.16.0.1'
                  WHEN user_id % 4 = 1 THEN '' END AS xff,
             CASE WHEN user_id % 3 = 0 THEN '10.2.' || CAST(user_id % 250 AS VARCHAR) || '.' || CAST(event_id % 250 AS VARCHAR)
                  WHEN user_id % 3 = 1 THEN '' END AS real_ip,
             CASE WHEN user_id % 5 <> 0 THEN '192.168.' || CAST(user_id % 250 AS VARCHAR) || '.' || CAST(event_id % 250 AS VARCHAR) END AS host
           FROM events)
SELECT event_id, CASE WHEN xff IS NOT NULL AND xff <> '' THEN {Q.strip("split_part(xff, ',', 1)")}
                      WHEN real_ip IS NOT NULL AND real_ip <> '' THEN real_ip
                      ELSE coalesce(host, 'unknown') END AS client
FROM h""")
def client_key(spark, sf):
    """Client key from proxy headers."""
    h = D.request_headers(read_table(spark, sf, "events"))
    return h.select("event_id", R.client_key().alias("client"))


@register("job_latest_status", f"""WITH {SQL_JOB_EVENTS}
SELECT job_id, status, strftime(updated_at, {F_TS}) AS updated_at FROM (
  SELECT job_id, arg_max(status, (ts, seq)) AS status, max(ts) AS updated_at FROM je GROUP BY job_id)""")
def job_latest_status(spark, sf):
    """R5 (batch form of the streaming status view): latest event status per job."""
    j = J.latest_status(_events(spark, sf))
    return j.select("job_id", "status", _ts("updated_at"))
