"""Job table maintenance over an append-only event log.

The job store is a log of events ``(job_id, ts, seq, status, filename,
result_json, error)``: ``pending`` events are inserts, all others updates.
Current state is derived with per-job aggregates (partial, so a job with a
huge history is pre-aggregated map-side), never by a sort of a whole job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIST_LIMIT = 100

# Task state -> job status written by a status poll, and the
# text shown while a task waits.
TASK_TO_JOB_STATUS = {"PROCESSING": "processing", "SUCCESS": "completed", "FAILURE": "failed"}
WAITING_MESSAGE = "Task is waiting to be processed"


def _order_key():
    return F.struct("ts", "seq")


def insert_outcomes(events: DataFrame) -> DataFrame:
    """Every insert with ``accepted`` = it is the first insert of its id
    (a later insert of an existing id is refused)."""
    ins = events.filter(F.col("status") == "pending")
    first = ins.groupBy("job_id").agg(F.min(_order_key()).alias("_first"))
    return ins.join(first, "job_id").select("job_id", "seq", "ts", (_order_key() == F.col("_first")).alias("accepted"))


def current_jobs(events: DataFrame) -> DataFrame:
    """One row per inserted job with its latest state.

    Updates before the first insert of an id, and updates of unknown ids, are
    ignored; repeated inserts are refused.  Every update overwrites status and
    all result columns (a null result replaces an earlier one).

    One aggregation per job (partial, map-side): the first insert, and the
    latest update overall.  The latest update is applied exactly when it
    comes after the first insert (then it is also the latest applied one);
    otherwise every update predates the insert and the job is still pending.
    """
    key = _order_key()
    is_ins = F.col("status") == "pending"
    agg = events.groupBy("job_id").agg(
        F.min(F.when(is_ins, key)).alias("_c"),
        F.min_by(F.when(is_ins, F.col("filename")), F.when(is_ins, key)).alias("filename"),
        F.max(F.when(~is_ins, key)).alias("_uk"),
        F.max_by(F.when(~is_ins, F.struct("status", "result_json", "error")), F.when(~is_ins, key)).alias("_u"),
    ).filter(F.col("_c").isNotNull())
    applied = F.col("_uk").isNotNull() & (F.col("_uk") > F.col("_c"))
    return agg.select(
        "job_id",
        F.when(applied, F.col("_u.status")).otherwise(F.lit("pending")).alias("status"),
        "filename",
        F.col("_c.ts").alias("created_at"),
        F.when(applied, F.col("_uk.ts")).otherwise(F.col("_c.ts")).alias("updated_at"),
        F.when(applied, F.col("_u.result_json")).alias("result_json"),
        F.when(applied, F.col("_u.error")).alias("error"))


def get_job(jobs: DataFrame, job_id: str) -> DataFrame:
    """Point lookup; the JSON result is parsed (invalid JSON -> null)."""
    return with_parsed_result(jobs.filter(F.col("job_id") == F.lit(job_id)))


def with_parsed_result(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("result", F.from_json("result_json", "map<string,string>", {"mode": "PERMISSIVE"}))


def list_jobs(jobs: DataFrame, limit: int = DEFAULT_LIST_LIMIT, status: str | None = None) -> DataFrame:
    """Newest first (created_at, ties by job_id), optional status filter,
    narrow column list; planned as a top-k (TakeOrderedAndProject)."""
    if status is not None:
        jobs = jobs.filter(F.col("status") == status)
    return jobs.select("job_id", "status", "created_at", "updated_at", "filename", "error") \
        .orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


def delete_jobs(jobs: DataFrame, doomed: DataFrame) -> DataFrame:
    """The job table without the ids in ``doomed``."""
    return jobs.join(doomed.select("job_id").distinct(), "job_id", "left_anti")


def task_states(events: DataFrame) -> DataFrame:
    """Map task states to the status response and the job status a poll
    writes (PENDING writes nothing; unknown states pass through)."""
    st = F.col("state")
    job_status = F.lit(None).cast("string")
    for k, v in reversed(list(TASK_TO_JOB_STATUS.items())):
        job_status = F.when(st == k, F.lit(v)).otherwise(job_status)
    detail = (F.when(st == "PENDING", F.lit(WAITING_MESSAGE))
              .when(st == "FAILURE", F.col("error"))
              .when(st.isin("PROCESSING", "SUCCESS"), F.col("info")))
    return events.withColumns({"job_status": job_status, "detail": detail})


def latest_status(events: DataFrame) -> DataFrame:
    """Latest status per job (usable in streaming update mode)."""
    return events.groupBy("job_id").agg(F.max_by("status", _order_key()).alias("status"),
                                        F.max("ts").alias("updated_at"))
