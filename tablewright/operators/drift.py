"""Schema drift between two stored schemas, and the gate on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.schemas import DRIFT_SCHEMA


class DriftError(RuntimeError):
    """A critical drift met the policy ``fail``."""


def latest_schema(catalogue: DataFrame, key: str = "source_path") -> DataFrame:
    """``(source_path, schema)`` of each source's most recent catalogue entry."""
    return catalogue.groupBy(key).agg(F.max_by("schema", "created_at").alias("schema"))


def schema_rows(entries: DataFrame, key: str = "source_path") -> DataFrame:
    """Catalogued schemas (maps) as ``(source_path, column, type)`` rows."""
    return entries.select(key, F.explode("schema").alias("column", "type"))


def compare_schemas(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Added, dropped and retyped columns of two ``(column, type)`` frames."""
    a = prior.select("column", F.col("type").alias("prior_type"), F.lit(True).alias("_prior"))
    b = current.select("column", F.col("type").alias("current_type"), F.lit(True).alias("_current"))
    change = (
        F.when(F.col("_prior").isNull(), "added")
        .when(F.col("_current").isNull(), "dropped")
        .when(~F.col("prior_type").eqNullSafe(F.col("current_type")), "type_change")
    )
    return (
        a.join(b, "column", "full").withColumn("change", change).where("change IS NOT NULL")
        .select("column", "change", "prior_type", "current_type").to(DRIFT_SCHEMA)
    )


def drift_summary(changes: DataFrame, prior_exists: bool = True) -> DataFrame:
    """One row: counts per kind, ``has_drift`` and ``drift_severity``."""
    severity = (
        F.when(F.lit(not prior_exists), "none")
        .when((F.col("dropped") > 0) | (F.col("type_changes") > 0), "critical")
        .when(F.col("added") > 0, "warning").otherwise("none")
    )
    return changes.agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "dropped").alias("dropped"),
        F.count_if(F.col("change") == "type_change").alias("type_changes"),
    ).select(
        "added", "dropped", "type_changes", severity.alias("drift_severity"),
        (F.lit(prior_exists) & ((F.col("added") + F.col("dropped") + F.col("type_changes")) > 0)).alias("has_drift"),
        F.lit(not prior_exists).alias("no_prior_run"))


def drift_gate(summary: DataFrame, policy: str = "fail") -> str:
    """The severity, or ``DriftError`` on critical drift unless the policy lets it pass."""
    if policy not in ("fail", "warn", "accept"):
        raise ValueError(f"unknown drift policy: {policy}")
    row = summary.first()
    if row["drift_severity"] == "critical" and policy == "fail":
        raise DriftError(f"{row['dropped']} columns dropped, {row['type_changes']} retyped")
    return row["drift_severity"]
