"""The quality check suite of a transformed table against its original profile."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.profile import column_stats, settle, std_estimate, union_all
from tablewright.schemas import CHECK_SCHEMA

# Pass limits.
MIN_ROW_RATIO = 0.50
MIN_ROW_RATIO_DEDUP = 0.30
MAX_NULL_INCREASE = 0.05
MAX_MEAN_SHIFT = 3.0
NON_NEGATIVE_RULES = ("unit_price_non_negative", "amount_non_negative")
NON_NEGATIVE_NAMES = ("price", "amount", "total", "fee")


def _family(column: str, merge_temporal: bool) -> str:
    temporal = "date" if merge_temporal else "timestamp"
    return (
        f"CASE WHEN {column} RLIKE '^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL|NUMERIC)' THEN 'numeric'"
        f" WHEN {column} RLIKE '^TIMESTAMP' THEN '{temporal}' WHEN {column} = 'DATE' THEN 'date'"
        f" WHEN {column} RLIKE '^BOOL' THEN 'boolean'"
        f" WHEN {column} RLIKE '^(STRING|VARCHAR|CHAR|TEXT)' THEN 'string' ELSE {column} END"
    )


def _checks(frame: DataFrame, name: str, kind: str, severity: str, column, passed, expected, actual, detail):
    return frame.select(
        F.lit(name).alias("check_name"), F.lit(kind).alias("check_type"), column.alias("column_name"),
        F.expr(passed).alias("passed"), F.lit(severity).alias("severity"),
        F.expr(expected).alias("expected"), F.expr(actual).alias("actual"), F.expr(detail).alias("detail"),
    )


def quality_checks(output: DataFrame, original: DataFrame, schema: DataFrame | None = None,
                   transformations: Iterable[str] = (), rules: Iterable[str] = (),
                   std: DataFrame | None = None, merge_temporal: bool = False,
                   max_null_increase: float = MAX_NULL_INCREASE, max_mean_shift: float = MAX_MEAN_SHIFT,
                   min_row_ratio: float = MIN_ROW_RATIO, min_row_ratio_dedup: float = MIN_ROW_RATIO_DEDUP,
                   ) -> DataFrame:
    """All checks (``CHECK_SCHEMA``) from one pass over the output, made at once.

    ``original`` is a profile of the input (or its ``column_stats``), ``schema``
    the inferred types. Columns without a profile are skipped; see
    ``unprofiled_columns``. ``std`` may replace the range/4 estimate.
    """
    deduped = any("dedup" in t.lower() for t in transformations)
    minimum = min_row_ratio_dedup if deduped else min_row_ratio
    # Every check reads the same few rows per column; settled, they are computed once.
    stats, original = settle(column_stats(output)), settle(original)

    sizes = stats.select(F.col("total_rows").alias("n_out"), F.lit(None).cast("long").alias("n_in")).unionByName(
        original.select(F.lit(None).cast("long").alias("n_out"), F.col("total_rows").alias("n_in")))
    totals = sizes.agg(
        F.coalesce(F.max("n_out"), F.lit(0)).alias("n_out"), F.coalesce(F.max("n_in"), F.lit(0)).alias("n_in"),
    ).withColumn("ratio", F.expr("coalesce(try_divide(n_out, n_in), 1.0D)"))
    volume = _checks(
        totals, "row_count", "volume", "critical", F.lit(None).cast("string"), f"ratio >= {minimum}D",
        f"map('min_ratio', '{minimum}')",
        "map('rows_out', CAST(n_out AS STRING), 'rows_in', CAST(n_in AS STRING))",
        f"format_string('Output has %d rows (%.1f%% of %d); at least {minimum:.0%}% expected.', n_out, ratio * 100, n_in)",
    )

    mean = F.col("mean").alias("mean_before")
    before = original.select("column", "null_count", "total_rows", "min", "max", mean).select(
        "column", F.expr("coalesce(try_divide(null_count, total_rows), 0.0D)").alias("nulls_before"), "mean_before")
    joined = (
        stats.withColumn("nulls_after", F.expr("coalesce(try_divide(null_count, total_rows), 0.0D)"))
        .join(F.broadcast(before), "column")
        .join(F.broadcast(std if std is not None else std_estimate(original)), "column", "left")
    )
    nulls = _checks(
        joined.withColumn("rise", F.expr("nulls_after - nulls_before")),
        "null_rate", "completeness", "error", F.col("column"), f"rise <= {max_null_increase}D",
        f"map('max_increase', '{max_null_increase}')",
        "map('before', CAST(nulls_before AS STRING), 'after', CAST(nulls_after AS STRING))",
        "format_string('Null rate %.1f%% before, %.1f%% after.', nulls_before * 100, nulls_after * 100)",
    )
    shift = _checks(
        joined.where("mean IS NOT NULL AND mean_before IS NOT NULL AND std_estimate > 0")
        .withColumn("z", F.expr("abs(mean - mean_before) / std_estimate")),
        "value_range", "distribution", "warning", F.col("column"), f"z <= {max_mean_shift}D",
        f"map('max_std', '{max_mean_shift}')",
        "map('before', CAST(mean_before AS STRING), 'after', CAST(mean AS STRING))",
        "format_string('Mean went from %.4f to %.4f, %.1f standard deviations.', mean_before, mean, z)",
    )
    parts = [volume, nulls, shift]
    if schema is not None:
        types = settle(schema.select("column", "inferred_type").where("inferred_type <> ''"))
        parts.append(_checks(
            joined.join(F.broadcast(types), "column"), "type_conformance", "schema", "error", F.col("column"),
            f"{_family('inferred_type', merge_temporal)} = {_family('dtype', merge_temporal)}",
            "map('type', inferred_type)", "map('type', dtype)",
            "format_string('Expected type %s, found %s.', inferred_type, dtype)",
        ))
    if set(rules) & set(NON_NEGATIVE_RULES):
        named = F.lower("column").rlike("|".join(NON_NEGATIVE_NAMES))
        parts.append(_checks(
            stats.where(named & F.col("negative_count").isNotNull()),
            "non_negative_values", "domain", "error", F.col("column"), "negative_count = 0",
            "map('negative_count', '0')", "map('negative_count', CAST(negative_count AS STRING))",
            "format_string('%d negative values in %s.', negative_count, column)",
        ))
    return union_all(parts).to(CHECK_SCHEMA)


def rule_checks(violations: DataFrame) -> DataFrame:
    """Checks (``CHECK_SCHEMA``) from ``(name, column, violation_count, passed)`` of domain rules and forbidden changes."""
    return violations.select(
        F.col("name").alias("check_name"), F.lit("domain").alias("check_type"), F.col("column").alias("column_name"), "passed",
        F.lit("error").alias("severity"), F.create_map(F.lit("violation_count"), F.lit("0")).alias("expected"),
        F.create_map(F.lit("violation_count"), F.col("violation_count").cast("string")).alias("actual"),
        F.format_string("%d rows violate %s.", "violation_count", "name").alias("detail")).to(CHECK_SCHEMA)


def unprofiled_columns(output: DataFrame, original: DataFrame) -> list[str]:
    known = {r["column"] for r in original.select("column").collect()}
    return [c for c in output.columns if c not in known]


def verdict(checks: DataFrame, gate: tuple[str, ...] = ("critical",), by: tuple[str, ...] = ()) -> DataFrame:
    """``overall_passed`` and the failed gating checks, per ``by`` columns if given."""
    failed = (~F.col("passed")) & F.col("severity").isin(*gate)
    label = F.concat(F.col("check_name"), F.coalesce(F.concat(F.lit("("), "column_name", F.lit(")")), F.lit("")))
    return checks.groupBy(*by).agg(
        F.coalesce(~F.bool_or(failed), F.lit(True)).alias("overall_passed"),
        F.count(F.lit(1)).alias("check_count"),
        F.count_if(~F.col("passed")).alias("failed_count"),
        F.sort_array(F.collect_set(F.when(failed, label))).alias("critical_failures"))


def target_columns(checks: DataFrame, risks: DataFrame) -> DataFrame:
    """``(column)``: those with a failed check or flagged by the profile."""
    failed = checks.where("NOT passed AND column_name IS NOT NULL").select(F.col("column_name").alias("column"))
    return failed.unionByName(risks.select("column")).distinct()
