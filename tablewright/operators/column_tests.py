"""Column tests suggested from a profile, and running tests on a table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from tablewright.functions import sql as S
from tablewright.operators.constraints import repeated_keys
from tablewright.operators.profile import union_all
from tablewright.schemas import CHECK_SCHEMA

# (column, test, accepted values)
ColumnTest = tuple[str, str, Sequence[str] | None]


def suggest_tests(prof: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """``(column, test, values)`` that the profiled data passes: ``unique``, ``not_null``, ``accepted_values``."""
    rows = prof
    boolean = F.col("dtype") == "BOOLEAN"
    if schema is not None:
        rows = prof.join(F.broadcast(schema.select("column", "inferred_type")), "column", "left")
        boolean = boolean | (F.coalesce("inferred_type", F.lit("")) == "BOOLEAN")
    filled = F.col("total_rows") > 0
    accepted = F.when(F.col("dtype") == "BOOLEAN", F.array(F.lit("true"), F.lit("false"))).otherwise(
        F.array(*[F.lit(v) for v in S.BOOLEAN_FALSE + S.BOOLEAN_TRUE]))
    nothing = F.lit(None).cast("array<string>")
    tests = F.array_compact(F.array(
        F.when(filled & (F.col("unique_count") == F.col("total_rows")),
               F.struct(F.lit("unique").alias("test"), nothing.alias("values"))),
        F.when(filled & (F.col("null_count") == 0),
               F.struct(F.lit("not_null").alias("test"), nothing.alias("values"))),
        F.when(boolean, F.struct(F.lit("accepted_values").alias("test"), accepted.alias("values"))),
    ))
    return rows.select("column", F.inline(tests))


def read_tests(tests: DataFrame) -> list[ColumnTest]:
    """The suggested tests as a list (at most three per column)."""
    return [(r["column"], r["test"], r["values"]) for r in tests.collect()]


def run_tests(df: DataFrame, tests: Iterable[ColumnTest]) -> DataFrame:
    """Every test as a check row (``CHECK_SCHEMA``), all but ``unique`` from one aggregate.

    As is usual for column tests, null cells fail only ``not_null``;
    accepted values are compared in lower case.
    """
    aggregates, rows, unique = [], [], []
    for i, (c, test, values) in enumerate(tests):
        q = S.quote(c)
        if test == "unique":
            unique.append(c)
            continue
        if test == "not_null":
            bad = f"{q} IS NULL"
        elif test == "accepted_values":
            bad = f"lower({S.stripped(f'CAST({q} AS STRING)')}) NOT IN ({S.tokens(values)})"
        else:
            raise ValueError(f"unknown test: {test}")
        aggregates.append(F.expr(f"count_if({bad})").alias(f"v_{i}"))
        rows.append(f"named_struct('test', '{test}', 'column', {S.literal(c)}, 'violations', v_{i})")
    parts = []
    if rows:
        parts.append(df.agg(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))"))
    parts += [
        repeated_keys(df, [c]).select(F.lit("unique").alias("test"), F.lit(c).alias("column"),
                                      F.col("violation_count").alias("violations"))
        for c in unique]
    if not parts:
        return df.sparkSession.createDataFrame([], CHECK_SCHEMA)
    return union_all(parts).select(
        F.col("test").alias("check_name"), F.lit("test").alias("check_type"), F.col("column").alias("column_name"),
        (F.col("violations") == 0).alias("passed"), F.lit("error").alias("severity"),
        F.create_map(F.lit("violations"), F.lit("0")).alias("expected"),
        F.create_map(F.lit("violations"), F.col("violations").cast("string")).alias("actual"),
        F.format_string("%d violations of %s on %s.", "violations", "test", "column").alias("detail"),
    ).to(CHECK_SCHEMA)
