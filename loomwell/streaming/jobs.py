"""Structured Streaming over job events and arriving articles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwell.functions import columns as C
from loomwell.operators.literature import chunk_articles

TERMINAL = ("COMPLETED", "FAILED", "CANCELED")


def _millis(span: str) -> int:
    """Milliseconds of a text like ``10 minutes``."""
    return int(pd.Timedelta(span).total_seconds() * 1000)


def job_state(events: DataFrame, delay: str = "10 minutes", keep: str = "1 hour", idle: str = "7 days") -> DataFrame:
    """The running state of each job from (job_id, status, ts); a terminal status never goes back.

    Updates come out in update mode. Events that are more than ``delay`` behind the newest are late and
    dropped. State ends by event time: ``keep`` after a terminal status, ``idle`` after the last event of
    another. What comes for a job after that starts it anew. Null times and ids are dropped.
    """
    kept, idled = _millis(keep), _millis(idle)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": pd.Series(dtype="int64"), "status": pd.Series(dtype=object), "events": pd.Series(dtype="int64")})
            return
        status, n, last = state.get if state.exists else ("PENDING", 0, 0)
        for s, ts in pd.concat(list(frames)).sort_values("ts", kind="stable")[["status", "ts"]].itertuples(index=False):
            n, last = n + 1, max(last, int(ts.timestamp() * 1000))
            if status not in TERMINAL:
                status = s
        state.update((status, n, last))
        state.setTimeoutTimestamp(max(last + (kept if status in TERMINAL else idled), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "events": [n]})

    named = events.where("job_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).select("job_id", C.normalize_status(F.col("status")).alias("status"), "ts")
    return named.groupBy("job_id").applyInPandasWithState(update, "job_id long, status string, events long", "status string, events long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def progress_dedup(lines: DataFrame, delay: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """Progress lines of (job_id, seq, line) without blanks and immediate repeats, across batches.

    With a column ``ts`` state ends by event time, ``idle`` after a job's last line, and lines more than
    ``delay`` behind the newest are dropped. A line after that comes out even if it repeats the last.
    Without one nothing tells when a job is over, and its last line is kept.
    """
    timed, wait = "ts" in lines.columns, _millis(idle)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last, newest = state.get if state.exists else (None, 0)
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            for seq, line in rows[["seq", "line"]].itertuples(index=False):
                if line is not None and line.strip() and line != last:
                    out.append((key[0], seq, line))
                    last = line
            if timed:
                newest = max(newest, int(rows["ts"].max().timestamp() * 1000))
                state.update((last, newest))
                state.setTimeoutTimestamp(max(newest + wait, state.getCurrentWatermarkMs() + 1))
            else:
                state.update((last, newest))
        yield pd.DataFrame(out, columns=["job_id", "seq", "line"])

    rows = lines.where("ts IS NOT NULL").withWatermark("ts", delay).select("job_id", "seq", "line", "ts") if timed else lines.select("job_id", "seq", "line")
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("job_id").applyInPandasWithState(keep, "job_id long, seq long, line string", "last string, newest long", "append", timeout)


def stale_pending(events: DataFrame, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Jobs that stay pending for longer than ``seconds`` of event time, once each time that they do.

    A job that goes on to another status in time isn't reported, and its state ends; one that is pending
    again starts anew. Events more than ``delay`` behind the newest are dropped.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "pending_since": [since]})
            return
        since, out = state.get[0] if state.exists else None, []
        for s, ts in pd.concat(list(frames)).sort_values("ts", kind="stable")[["status", "ts"]].itertuples(index=False):
            at = int(ts.timestamp() * 1000)
            if since is not None and at > since + seconds * 1000:  # it was stale before this event came
                out.append((key[0], since))
                since = None
                if s == "PENDING":
                    continue
            since = (at if since is None else since) if s == "PENDING" else None
        if since is not None:
            state.update((since,))
            state.setTimeoutTimestamp(max(since + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"job_id": pd.Series([x[0] for x in out], dtype="int64"), "pending_since": pd.Series([x[1] for x in out], dtype="int64")})

    named = events.where("job_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).select("job_id", C.normalize_status(F.col("status")).alias("status"), "ts")
    return named.groupBy("job_id").applyInPandasWithState(watch, "job_id long, pending_since long", "since long", "append", GroupStateTimeout.EventTimeTimeout)


#: Folders of an index: articles are dealt to them by their source.
BUCKETS = 256


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def known_chunks(spark: SparkSession, index_path: str, buckets: list[int]) -> DataFrame | None:
    """The chunk_ids in some folders of an index; no other is listed or read. None where it has none of them."""
    fs, path = _file_system(spark, index_path)
    there = [p for p in (f"{index_path}/bucket={b}" for b in buckets) if fs.exists(path(p))]
    return spark.read.parquet(*there).select("chunk_id") if there else None


def ingest_batch(articles: DataFrame, number: int, index_path: str) -> bool:
    """Add the chunks of one batch of articles to an index; whether anything was done.

    A batch that is in the index's log isn't added again. The log is written last: if a batch stops
    before, its next run reads the folders of its articles and adds the chunks that are missing, so
    each chunk_id is there once. The first version of a chunk stays.
    """
    spark = articles.sparkSession
    fs, path = _file_system(spark, index_path)
    done = path(f"{index_path}/_log/batch={number}")
    if fs.exists(done):
        return False
    chunks = chunk_articles(articles).dropDuplicates(["chunk_id"]).withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int"))
    buckets = [r["bucket"] for r in articles.select(F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct().collect()]  # BUCKETS at most
    known = known_chunks(spark, index_path, buckets)
    if known is not None:
        chunks = chunks.join(known, "chunk_id", "left_anti")
    chunks.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(index_path)
    fs.create(done, True).close()
    return True


def ingest_chunks(articles: DataFrame, index_path: str, checkpoint: str):
    """Chunks of arriving articles added to an index, batch by batch (see ``ingest_batch``).

    An index belongs to one stream and its checkpoint, as its log knows batches by their numbers.
    """
    return articles.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, number, index_path) and None).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events of each stage and status in tumbling windows; what comes after the watermark is dropped."""
    named = events.withWatermark("ts", delay).select("ts", "stage", C.normalize_status(F.col("status")).alias("status"))
    return named.groupBy(F.window("ts", window).alias("w"), "stage", "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "stage", "status", "n")
