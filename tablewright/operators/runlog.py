"""The run log: append-only events, current state, cached runs, watermarks, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.schemas import RUN_SCHEMA

# Fixed values.
MAX_RETRIES = 3
HISTORY_LENGTH = 30


def run_event(spark, **fields) -> DataFrame:
    """One event row; fields left out are null, ``event_time`` defaults to now."""
    unknown = set(fields) - set(RUN_SCHEMA.names)
    if unknown:
        raise ValueError(f"no such run fields: {sorted(unknown)}")
    row = spark.createDataFrame([tuple(fields.get(n) for n in RUN_SCHEMA.names)], RUN_SCHEMA)
    return row if "event_time" in fields else row.withColumn("event_time", F.current_timestamp())


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def current_runs(events: DataFrame) -> DataFrame:
    """Per run, the newest non-null value of every field."""
    others = [c for c in events.columns if c not in ("run_id", "event_time")]
    # max_by ignores rows whose ordering value is null, which hides unset fields.
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_time"))).alias(c) for c in others]
    return events.groupBy("run_id").agg(*newest, F.max("event_time").alias("event_time"))


def latest_success(runs: DataFrame, run_key: str | None = None) -> DataFrame:
    """The most recent successful run per ``run_key`` (ties by run id)."""
    done = runs.where(F.col("status") == "success")
    if run_key is not None:
        done = done.where(F.col("run_key") == run_key)
    others = [c for c in runs.columns if c != "run_key"]
    best = done.groupBy("run_key").agg(
        F.max_by(F.struct(*others), F.struct("completed_at", "run_id")).alias("_run"))
    return best.select("run_key", "_run.*")


def run_history(runs: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def last_watermarks(runs: DataFrame) -> DataFrame:
    """``(source_path, watermark_column, watermark_value)`` of the last successful run with a watermark."""
    done = runs.where("status = 'success' AND watermark_value IS NOT NULL")
    best = done.groupBy("source_path").agg(F.max_by(
        F.struct("watermark_column", "watermark_value"), F.struct("completed_at", "run_id")).alias("_run"))
    return best.select("source_path", "_run.*")


def outcome(status: Column, retry_count: Column, max_retries: int = MAX_RETRIES) -> Column:
    """What follows a finished quality step: ``publish``, ``retry`` or ``failed``."""
    return (
        F.when(status.isin("success", "catalogue_pending"), "publish")
        .when((status == "retrying") & (F.coalesce(retry_count, F.lit(0)) < max_retries), "retry")
        .otherwise("failed"))


def run_outcomes(runs: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    return runs.withColumn("outcome", outcome(F.col("status"), F.col("retry_count"), max_retries))


def run_metrics(runs: DataFrame, checks: DataFrame, anomalies: DataFrame,
                domains: DataFrame | None = None) -> DataFrame:
    """One row per run: verdict, retries, rows, failed checks, anomalies, domain confidence.

    Checks and anomalies are counted per run before the joins.
    """
    failed = checks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("check_count"), F.count_if(~F.col("passed")).alias("failed_checks"))
    found = anomalies.groupBy("run_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    rows = (
        runs.select("run_id", F.col("quality_passed").cast("double").alias("quality_passed"),
                    F.col("retry_count").cast("double").alias("retry_count"),
                    F.col("rows_output").alias("rows_processed"))
        .join(failed, "run_id", "left").join(found, "run_id", "left")
        .na.fill(0, ["check_count", "failed_checks", "anomaly_count"]))
    if domains is not None:
        rows = rows.join(domains.select("run_id", F.col("confidence").alias("domain_confidence")), "run_id", "left")
    return rows
