"""Streaming pipelines.

All of them take a streaming DataFrame (``spark.readStream...``) and return
either a streaming DataFrame or a started query.  Sinks write through
``foreachBatch`` into Parquet with a checkpoint, so a restarted query resumes
exactly where it stopped (idempotent per batch id).
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import dedup_lines, is_blank
from scriptorium.operators import jobs as J
from scriptorium.operators import rate as R
from scriptorium.sources import stores as ST

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_contents(stream: DataFrame, text: str = "text", ts: str = "ts",
                   watermark: str = "1 hour") -> DataFrame:
    """Drop rows whose content digest was already seen within the
    watermark; the state is bounded by the watermark, unlike an unbounded
    process-local cache."""
    return stream.withColumn("content_md5", F.md5(F.col(text).cast("binary"))) \
        .withColumn("_ts", F.col(ts).cast("timestamp")) \
        .withWatermark("_ts", watermark).dropDuplicatesWithinWatermark(["content_md5"]).drop("_ts")


def _us(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _keyed_by(stream: DataFrame, key: str, ts: str, watermark: str, *more: F.Column) -> DataFrame:
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark) \
        .select(F.col(key).cast("string").alias("key"), "_ts", _us("_ts").alias("t_us"), *more)


def sample_intervals_stream(stream: DataFrame, key: str, ts: str, text: str,
                            interval_s: float = 1.0, watermark: str = "10 seconds") -> DataFrame:
    """S5 on a stream: (key, t_us, text) of the earliest row of every interval, blank
    texts dropped; intervals count from the key's first row, as in the batch form.

    Rows wait in state until the watermark has passed them, so that they are taken in
    time order whatever the order of arrival; then the state is the key's first time
    and its current interval.  Needs the RocksDB state store provider."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    step = round(interval_s * 1_000_000)

    class Sampler(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "t long, x string")
            self.place = handle.getValueState("place", "t0 long, w long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for pdf in rows:  # chunk by chunk
                self.waiting.appendList([(int(t), x) for t, x in zip(pdf["t_us"], pdf["text"])])
            self.wake()
            return iter([])

        def wake(self) -> None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            left = [t for t, _ in self.waiting.get()] if self.waiting.exists() else []
            if left:
                self.handle.registerTimer(min(left) // 1000 + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            held = [tuple(r) for r in self.waiting.get()]
            ready = sorted((r for r in held if r[0] < passed), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
            rest = [r for r in held if r[0] >= passed]
            t0, now = self.place.get() if self.place.exists() else (None, -1)
            out = []
            for t, x in ready:
                t0 = t if t0 is None else t0
                if (t - t0) // step > now:
                    now = (t - t0) // step
                    out.append((t, x))
            if t0 is not None:
                self.place.update((t0, now))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            self.wake()
            yield pd.DataFrame({"key": key[0], "t_us": pd.Series([t for t, _ in out], dtype="int64"), "text": pd.Series([x for _, x in out], dtype=object)})

        def close(self) -> None:
            pass

    src = _keyed_by(stream, key, ts, watermark, F.col(text).alias("text")).where("t_us is not null")
    out = src.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Sampler(), outputStructType="key string, t_us long, text string", outputMode="Append", timeMode="EventTime")
    return out.filter(~is_blank("text"))


def reuse_results(stream: DataFrame, key: str, text: str, work: Callable[[str], str], ttl: str = "1 hour") -> DataFrame:
    """L6 / R4 on a stream: every row leaves with its result, and ``work`` runs once per
    content: the result is kept under the content's digest for ``ttl`` (of processing
    time, from when it was made).  Output: (key, content_md5, result, reused); a null
    text has no digest and no result.  Needs the RocksDB state store provider."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    number, unit = ttl.split()
    lifetime = int(float(number) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[unit[0]] * 1000)

    class Reuse(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.result = handle.getValueState("result", "value string", lifetime)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            known = key[0] is None or self.result.exists()
            value = self.result.get()[0] if known and key[0] is not None else None
            for pdf in rows:
                fresh = 0 if known else 1
                if fresh:
                    value = work(pdf["text"].iloc[0])
                    self.result.update((value,))
                    known = True
                yield pd.DataFrame({"key": pdf["key"], "content_md5": key[0], "result": value,
                                    "reused": [key[0] is not None] * len(pdf) if not fresh else [False] + [True] * (len(pdf) - 1)})

        def close(self) -> None:
            pass

    src = stream.select(F.col(key).cast("string").alias("key"), F.md5(F.col(text).cast("binary")).alias("content_md5"), F.col(text).alias("text"))
    return src.groupBy("content_md5").transformWithStateInPandas(
        statefulProcessor=Reuse(), outputStructType="key string, content_md5 string, result string, reused boolean", outputMode="Append", timeMode="ProcessingTime")


STAGES = ("pending", "processing", "completed", "failed")
TIMED_OUT = "timed out"


def job_lifecycle(events: DataFrame, timeout_s: int = 3600, watermark: str = "1 minute") -> DataFrame:
    """Job events (job_id, ts, status, error) as transitions (job_id, ts, status,
    error): pending, processing, then completed or failed.  State is the job's stage; an
    event that would lead back (late, repeated, after the end) is left out, and a job
    without an end ``timeout_s`` after its last event fails with "timed out".  Needs the
    RocksDB state store provider."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    rank = {"pending": 0, "processing": 1, "completed": 2, "failed": 2}
    columns = "job_id string, ts timestamp, status string, error string"

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["job_id", "ts", "status", "error"])
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        return out

    class Lifecycle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.stage = handle.getValueState("stage", "rank int, t long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            now, last = self.stage.get() if self.stage.exists() else (-1, 0)
            seen = sorted(((int(t), rank[s], s, e) for pdf in rows for t, s, e in zip(pdf["t_us"], pdf["status"], pdf["error"]) if s in rank), key=lambda r: r[:3])
            out = []
            for t, r, s, e in seen:
                if r > now:
                    now, last = r, max(last, t)
                    out.append((key[0], t, s, e))
            if not out:
                return
            self.stage.update((now, last))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            # after the end the stage stays as long again, to stop what comes late
            self.handle.registerTimer(max(last // 1000, timerValues.getCurrentWatermarkInMs()) + timeout_s * 1000)
            yield frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now, last = self.stage.get()
            self.stage.clear()
            if now < 2:
                yield frame([(key[0], last + timeout_s * 1_000_000, "failed", TIMED_OUT)])

        def close(self) -> None:
            pass

    src = _keyed_by(events, "job_id", "ts", watermark, F.col("status"), F.col("error")).where("t_us is not null and key is not null")
    return src.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Lifecycle(), outputStructType=columns, outputMode="Append", timeMode="EventTime")


def job_status_stream(events: DataFrame) -> DataFrame:
    """Latest status per job; run with output mode 'update'."""
    return J.latest_status(events)


def ingest(stream: DataFrame, out_dir: str, checkpoint: str, key: str = "doc_id", text: str = "text",
           trigger_once: bool = True, clock: Callable[[], float] = time.time):
    """Queued documents -> line dedup -> results table + job events.

    Each micro-batch writes, per document, a 'pending' event when it arrives, a
    'processing' event before the work, the result, and a 'completed' event (for a null
    text 'failed' with the error) after it, each with the time at which it is written.
    ``jobs.current_jobs`` reads the events at any moment.  A batch that is run again
    replaces its own files; numbers come from the batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        job, none = F.col(key).cast("string").alias("job_id"), F.lit(None).cast("string")

        def events(step: int, status, rows: DataFrame, result=none, error=none) -> None:
            rows.select(job, F.timestamp_micros(F.lit(round(clock() * 1_000_000))).alias("ts"), F.lit(3 * batch_id + step).cast("bigint").alias("seq"),
                        status.alias("status"), job.alias("filename"), result.alias("result_json"), error.alias("error")) \
                .write.mode("overwrite").parquet(f"{out_dir}/job_events/batch_id={batch_id}/step={step}")

        events(0, F.lit("pending"), kept)
        events(1, F.lit("processing"), kept)
        done = f"{out_dir}/results/batch_id={batch_id}"
        kept.select(key, dedup_lines(text).alias("text"), F.md5(F.col(text).cast("binary")).alias("content_md5")) \
            .withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(done)
        results = batch.sparkSession.read.parquet(done)
        bad = F.col("text").isNull()
        events(2, F.when(bad, "failed").otherwise("completed"), results, F.when(~bad, F.to_json(F.struct("text"))), F.when(bad, "no text"))
        kept.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()


def index_stream(stream: DataFrame, path: str, checkpoint: str, splitter: str = "recursive"):
    """Background indexing; every micro-batch (store_id, doc_id, text) is
    appended to the index at ``path`` under the name of this stream (its checkpoint)
    and its batch id, so a batch that is run again adds nothing twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        ST.write_index(kept, path, append=True, version=f"{checkpoint}#{batch_id}", splitter=splitter)
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


# ------------------------------------------------------------ rate limiter


def rate_limit_stream(requests: DataFrame, limit: int = R.DEFAULT_LIMIT, window_s: int = R.DEFAULT_WINDOW_S,
                      watermark: str = "10 minutes") -> DataFrame:
    """R1 on a stream: per-client state holds only the accepted timestamps
    younger than the window (bounded by ``limit``); rows arriving behind the
    watermark are dropped.  A timer at the end of the last timestamp's window
    removes the state of a client that has gone quiet: by then no row that the
    watermark lets pass can meet it.  Needs the RocksDB state store provider."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    w_us = window_s * 1_000_000
    log_schema = T.StructType([T.StructField("t", T.LongType())])

    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.log = handle.getListState("log", log_schema)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # exempt rows leave as they come; of the others time and id are kept, to sort
            times, ids = [], []
            for pdf in rows:
                free = pdf["path"].isin(list(R.EXEMPT_PATHS)).to_numpy()
                if free.any():
                    yield pd.DataFrame({"client": key[0], "event_id": pdf["event_id"].to_numpy()[free], "accepted": True})
                times.append(pdf["t_us"].to_numpy()[~free])
                ids.append(pdf["event_id"].to_numpy()[~free])
            times, ids = np.concatenate(times), np.concatenate(ids)
            order = np.lexsort((ids, times))
            log = deque(sorted(r[0] for r in self.log.get()) if self.log.exists() else ())
            flags = []
            for t in times[order].tolist():
                while log and t - log[0] >= w_us:
                    log.popleft()
                flags.append(len(log) < limit)
                if flags[-1]:
                    log.append(t)
            self.log.clear()
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if log:
                self.log.put([(x,) for x in log])
                self.handle.registerTimer(-(-(log[-1] + w_us) // 1000))
            yield pd.DataFrame({"client": key[0], "event_id": ids[order], "accepted": pd.Series(flags, dtype=bool)})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.log.clear()
            return iter([])

        def close(self) -> None:
            pass

    src = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) \
        .select("client", "event_id", "path", "ts", F.unix_micros("ts").alias("t_us"))
    out = T.StructType([T.StructField("client", T.StringType()), T.StructField("event_id", T.LongType()),
                        T.StructField("accepted", T.BooleanType())])
    return src.groupBy("client").transformWithStateInPandas(
        statefulProcessor=Limiter(), outputStructType=out, outputMode="Append", timeMode="EventTime")
