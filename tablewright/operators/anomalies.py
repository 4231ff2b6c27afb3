"""Outliers by quartile fences and unusual text shapes, exact over the whole table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tablewright.functions import columns as C
from tablewright.functions.sql import letter_pattern
from tablewright.operators.profile import union_all
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.texts import KEY, digest, first_texts

# Fence factor and common shapes.
FENCE = 1.5
COMMON_PATTERNS = 3

Bounds = Mapping[str, tuple[float, float, float, float]]


def quartile_bounds(df: DataFrame, columns: Iterable[str] | None = None, exact: bool = True,
                    factor: float = FENCE) -> Bounds:
    """``{column: (q1, q3, lower, upper)}`` of the numeric columns that hold a value."""
    names = [f.name for f in C.fields(df, columns) if f.name in set(C.numeric_columns(df))]
    if exact:
        quartiles = exact_quantiles(df, names)
    else:
        row = df.agg(*[F.percentile_approx(C.col(c).cast("double"), [0.25, 0.75]).alias(c) for c in names]).first()
        quartiles = {c: row[c] or [None, None] for c in names}
    return {
        c: (q1, q3, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
        for c, (q1, q3) in quartiles.items() if q1 is not None
    }


def bounds_frame(df: DataFrame, bounds: Bounds) -> DataFrame:
    rows = [(c, q1, q3, q3 - q1, low, high) for c, (q1, q3, low, high) in bounds.items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, q3 double, iqr double, lower double, upper double")


def numeric_outliers(df: DataFrame, keys: Sequence[str], bounds: Bounds) -> DataFrame:
    """One row per cell outside its fences; the fences reach the scan as a filter."""
    outside = {c: (C.col(c) < F.lit(low)) | (C.col(c) > F.lit(high)) for c, (_, _, low, high) in bounds.items()}
    cells = F.array_compact(F.array(*[
        F.when(outside[c], F.struct(
            F.lit(c).alias("column"), C.col(c).cast("string").alias("value"),
            F.format_string("IQR outlier: value %s outside [%.2f, %.2f]",
                            C.col(c).cast("string"), F.lit(low), F.lit(high)).alias("reason"),
            F.lit(low).alias("lower"), F.lit(high).alias("upper")))
        for c, (_, _, low, high) in bounds.items()
    ]))
    any_outside = F.lit(False)
    for test in outside.values():
        any_outside = any_outside | test
    return df.where(any_outside).select(*[C.col(k) for k in keys], F.inline(cells))


def _shapes(df: DataFrame, columns: Sequence[str], keys: Sequence[str], mode: str) -> DataFrame:
    texts = df.select(*[C.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[C.col(c) for c in columns])
    ids = [f"_k{i}" for i in range(len(keys))]
    return (
        texts.unpivot(ids, [C.col(c) for c in columns], "column", "value").where(F.col("value").isNotNull())
        .withColumn("pattern", F.expr(letter_pattern("value", mode)))
    )


def common_patterns(df: DataFrame, columns: Sequence[str], k: int = COMMON_PATTERNS,
                    mode: str = "letters") -> DataFrame:
    """``(column, rank, pattern, n)``: the k most frequent shapes, ties by shape. Runs at once; shapes of any length are whole."""
    shapes = _shapes(df, columns, [], mode).select("column", F.col("pattern").alias("value"))
    return df.sparkSession.createDataFrame(first_texts(shapes, k), "column string, rank long, pattern string, n long")


def rare_patterns(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = COMMON_PATTERNS,
                  mode: str = "letters") -> DataFrame:
    """One row per text cell whose shape is not among its column's k common ones."""
    # k digests per column: the broadcast is bounded by the column count.
    common = F.broadcast(common_patterns(df, columns, k, mode).select("column", *digest("pattern")))
    rare = _shapes(df, columns, keys, mode).select("*", *digest("pattern")).join(common, ["column", *KEY], "left_anti")
    return rare.select(
        *[F.col(f"_k{i}").alias(name) for i, name in enumerate(keys)], "column", "value",
        F.concat(F.lit("Unusual pattern for column '"), "column", F.lit("'")).alias("reason"),
        F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))


def detect_anomalies(df: DataFrame, keys: Sequence[str], target_columns: Iterable[str] | None = None,
                     mode: str = "letters", exact: bool = True, bounds: Bounds | None = None) -> DataFrame:
    """All anomalous cells (keys, then ``ANOMALY_SCHEMA``) of numeric and text columns.

    Rows are named by their key columns; unknown target columns are ignored. No
    target columns, or an empty list of them, means all. ``bounds`` are the fences of the numeric columns, if they are known.
    """
    wanted = set(target_columns or ()) or set(df.columns)
    numbers = [c for c in C.numeric_columns(df) if c in wanted]
    texts = [c for c in C.string_columns(df) if c in wanted]
    parts = []
    if numbers:
        if bounds is None:
            bounds = quartile_bounds(df, numbers, exact)
        bounds = {c: b for c, b in bounds.items() if c in numbers}
        if bounds:
            parts.append(numeric_outliers(df, keys, bounds))
    if texts:
        parts.append(rare_patterns(df, keys, texts, mode=mode))
    if not parts:
        return df.select(*[C.col(k) for k in keys]).limit(0).withColumns({
            "column": F.lit(""), "value": F.lit(""), "reason": F.lit(""),
            "lower": F.lit(0.0), "upper": F.lit(0.0)})
    return union_all(parts)


def evidence(anomalies: DataFrame, keys: Sequence[str], per_column: int | None = None) -> DataFrame:
    """Every anomalous cell, or the first ``per_column`` of each column in the order of the keys."""
    if per_column is None:
        return anomalies
    rank = F.row_number().over(W.partitionBy("column").orderBy(*keys, "value"))
    return anomalies.withColumn("_rank", rank).where(F.col("_rank") <= per_column).drop("_rank")


def anomaly_summary(anomalies: DataFrame, keys: Sequence[str], examples: int = 5) -> DataFrame:
    """``(column, anomaly_count, examples)`` with exact counts and a few values."""
    counts = anomalies.groupBy("column").agg(F.count(F.lit(1)).alias("anomaly_count"))
    rank = F.row_number().over(W.partitionBy("column").orderBy(*keys, "value"))
    shown = (
        anomalies.withColumn("_rank", rank).where(F.col("_rank") <= examples)
        .groupBy("column").agg(F.transform(
            F.sort_array(F.collect_list(F.struct("_rank", "value"))), lambda e: e["value"]).alias("examples")))
    return counts.join(F.broadcast(shown), "column")


def anomaly_rates(anomalies: DataFrame, keys: Sequence[str], total_rows: int) -> DataFrame:
    """One row: anomalous cells, anomalous rows and both rates to four places."""
    # One entry per row first, so that the distinct count has no hot group.
    rows = anomalies.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"))
    total = F.lit(total_rows)
    return rows.agg(
        F.coalesce(F.sum("_cells"), F.lit(0)).alias("anomaly_count"), F.count(F.lit(1)).alias("anomalous_rows"),
    ).select(
        "anomaly_count", "anomalous_rows",
        F.coalesce(F.round(F.try_divide("anomaly_count", total), 4), F.lit(0.0)).alias("anomaly_rate"),
        F.coalesce(F.round(F.try_divide("anomalous_rows", total), 4), F.lit(0.0)).alias("anomalous_row_rate"))


def explain_anomalies(summary: DataFrame, prof: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """``(column, anomaly_count, explanation)``: a sentence from counts, fences and profile."""
    joined = summary.join(F.broadcast(prof.select("column", "dtype", "total_rows", "null_rate", "min", "max")), "column", "left")
    if bounds is None:
        joined = joined.withColumns({"lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double")})
    else:
        joined = joined.join(F.broadcast(bounds.select("column", "lower", "upper")), "column", "left")
    share = F.coalesce(F.try_divide(F.col("anomaly_count") * 100.0, F.col("total_rows")), F.lit(0.0))
    fenced = F.format_string(
        "%d of %d values of %s (%.2f%%) lie outside [%.2f, %.2f]; the column runs from %s to %s.",
        "anomaly_count", "total_rows", "column", share, "lower", "upper", "min", "max")
    shaped = F.format_string(
        "%d of %d values of %s (%.2f%%) have an unusual pattern.", "anomaly_count", "total_rows", "column", share)
    return joined.select(
        "column", "anomaly_count",
        F.when(F.col("lower").isNotNull(), fenced).otherwise(shaped).alias("explanation"))
