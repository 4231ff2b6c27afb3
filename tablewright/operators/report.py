"""The quality report: one nested row per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.checks import verdict


def append_check_results(checks: DataFrame, run_id: str, path: str) -> None:
    checks.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def quality_report(checks: DataFrame, summary: DataFrame, explanations: DataFrame | None = None,
                   by: str = "run_id", gate: tuple[str, ...] = ("critical",)) -> DataFrame:
    """Verdict, checks, anomaly summary and explanations per run.

    The nested lists hold one entry per check and column, and one per anomalous
    column: repeated rows are merged before they are listed, so a list is
    bounded by the width of the tables.
    """
    entries = checks.groupBy(by, "check_name", "column_name").agg(
        F.max("check_type").alias("check_type"), F.bool_and("passed").alias("passed"),
        F.max("severity").alias("severity"), F.max("detail").alias("detail"))
    listed = entries.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(
        "check_name", "column_name", "check_type", "passed", "severity", "detail"))).alias("checks"))
    found = summary.groupBy(by).agg(
        F.sum("anomaly_count").alias("anomaly_count"),
        F.sort_array(F.collect_list(F.struct("column", "anomaly_count", "examples"))).alias("anomalies"))
    report = verdict(checks, gate, (by,)).join(listed, by).join(found, by, "left")
    if explanations is not None:
        texts = explanations.groupBy(by).agg(
            F.sort_array(F.collect_list(F.struct("column", "explanation"))).alias("explanations"))
        report = report.join(texts, by, "left")
    return report.na.fill(0, ["anomaly_count"])


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    report.write.mode("overwrite").format(fmt).save(path)
