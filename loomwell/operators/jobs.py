"""Job tables: durations, latest rows, duplicate lines, status names, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import columns as C


def job_durations(jobs: DataFrame) -> DataFrame:
    """Jobs and mean and greatest duration in milliseconds of each stage and status."""
    ms = F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return jobs.groupBy("stage", C.normalize_status(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("jobs"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job of each user and sample (ties: greatest id)."""
    return jobs.groupBy("user_id", "sample").agg(F.max_by(F.struct("id", "stage", "status"), F.struct("created_at", "id")).alias("j")).select("user_id", "sample", "j.*")


def with_payload(jobs: DataFrame, field: str = "sra_code") -> DataFrame:
    """Jobs with ``sample`` read from their JSON payload."""
    return jobs.withColumn("sample", F.get_json_object("payload", f"$.{field}"))


def recent_jobs(jobs: DataFrame, stage: str, limit: int = 200, status: str | None = None) -> DataFrame:
    """The newest ``limit`` jobs of a stage, with a status (by its usual name), if one is given."""
    chosen = jobs.where(F.col("stage") == stage)
    if status is not None:
        chosen = chosen.where(C.normalize_status(F.col("status")) == status)
    return chosen.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def consecutive_dedup(lines: DataFrame) -> DataFrame:
    """Progress lines without blank ones and without those equal to the line before, for each job."""
    kept = lines.where(F.trim(F.coalesce("line", F.lit(""))) != "")
    before = F.lag("line").over(Window.partitionBy("job_id").orderBy("seq"))
    return kept.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("line"))).drop("_before")


def expired(created: Column, now: Column, days: int) -> Column:
    return created < now - F.make_interval(days=F.lit(days))


def is_stale(status: Column, created: Column, now: Column, seconds: int = 300) -> Column:
    """Pending for longer than the limit."""
    return (C.normalize_status(status) == "PENDING") & (F.unix_timestamp(now) - F.unix_timestamp(created) > seconds)


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet."""
    return todo.join(done.select(*keys), keys, "left_anti")


def status_counts(jobs: DataFrame, window: str = "1 hour") -> DataFrame:
    """Events of each stage and status in windows of event time."""
    return jobs.groupBy(F.window("created_at", window).alias("w"), "stage", C.normalize_status(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "stage", "status", "n")
