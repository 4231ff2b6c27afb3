"""Profiles as mergeable state: one row of bytes and sums for each column.

Distinct values, quantiles and frequent values are kept as sketches that Spark merges, so a table
is profiled without shuffling its values, and the profile of all loads of a source follows
from the states of the loads, without reading the past again.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import fields, groupable, type_name
from tablewright.functions.sql import literal, quote, stripped
from tablewright.schemas import PROFILE_SCHEMA

#: Items that a sketch of frequent values tracks, and the longest text it holds as it is.
ITEMS, LONGEST = 500, 128


def _item(f: T.StructField) -> str:
    """A value as an item of the frequent ones; a longer text stands as its beginning with a digest."""
    c = f"to_json({quote(f.name)})" if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else f"CAST({quote(f.name)} AS STRING)"
    if not isinstance(f.dataType, T.StringType):
        return c
    return f"CASE WHEN length({c}) > {LONGEST} THEN concat(left({c}, {LONGEST - 17}), '#', lower(hex(xxhash64({c})))) ELSE {c} END"


def sketch(df: DataFrame, columns: Iterable[str] | None = None, items: int = ITEMS) -> DataFrame:
    """One row per column: counts, extremes, sum, and the sketches ``distinct``, ``spread`` (numbers only) and ``frequent``.

    One aggregate over the table; a task hands on a few kilobytes for each column. Columns without a value have no ``frequent``.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("total")], []
    for i, f in enumerate(fields(df, columns)):
        c = quote(f.name)
        number = isinstance(f.dataType, T.NumericType)
        aggregates += [F.expr(f"count({c})").alias(f"filled_{i}"), F.hll_sketch_agg(_hashable(f)).alias(f"distinct_{i}"),
                       F.expr(f"approx_top_k_accumulate({_item(f)}, {items})").alias(f"frequent_{i}")]
        blanks, low, high, total, negatives, spread = "0L", "NULL", "NULL", "0D", "NULL", "CAST(NULL AS BINARY)"
        if number:
            zero = f" + CAST(0 AS {f.dataType.simpleString()})" if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else ""
            aggregates += [F.expr(f"min({c}){zero}").alias(f"low_{i}"), F.expr(f"max({c}){zero}").alias(f"high_{i}"),
                           F.expr(f"coalesce(sum(CAST({c} AS DOUBLE)), 0D)").alias(f"sum_{i}"), F.expr(f"count_if({c} < 0)").alias(f"negatives_{i}"),
                           F.expr(f"kll_sketch_agg_double(CAST({c} AS DOUBLE))").alias(f"spread_{i}")]
            low, high, total, negatives, spread = f"low_{i}", f"high_{i}", f"sum_{i}", f"negatives_{i}", f"spread_{i}"
        elif isinstance(f.dataType, T.StringType):
            aggregates.append(F.expr(f"count_if({stripped(c)} = '')").alias(f"blanks_{i}"))
            blanks = f"blanks_{i}"
        rows.append(
            f"named_struct('column', {literal(f.name)}, 'dtype', {literal(type_name(f.dataType))}, 'total_rows', total, 'filled', filled_{i},"
            f" 'blank_count', {blanks}, 'min', CAST({low} AS STRING), 'max', CAST({high} AS STRING), 'low', CAST({low} AS DOUBLE),"
            f" 'high', CAST({high} AS DOUBLE), 'sum', {total}, 'negative_count', CAST({negatives} AS BIGINT), 'distinct', distinct_{i}, 'spread', {spread},"
            f" 'frequent', frequent_{i})")
    return df.agg(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


def _hashable(f: T.StructField) -> Column:
    """A value in a type that the sketch of distinct values takes; numbers that are equal are one."""
    if isinstance(f.dataType, (T.StringType, T.BinaryType, T.LongType, T.IntegerType)):
        return F.col(quote(f.name))
    if isinstance(f.dataType, (T.ShortType, T.ByteType)):
        return F.col(quote(f.name)).cast("int")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return (F.col(quote(f.name)) + F.lit(0.0)).cast("string")
    return F.when(F.col(quote(f.name)).isNotNull(), F.xxhash64(groupable(f)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), items: int = ITEMS) -> DataFrame:
    """The state of the union of all tables whose states are the rows of ``sketches``, per ``by`` and column."""
    return sketches.groupBy(*by, "column").agg(
        F.max("dtype").alias("dtype"), F.sum("total_rows").alias("total_rows"), F.sum("filled").alias("filled"), F.sum("blank_count").alias("blank_count"),
        F.min_by("min", "low").alias("min"), F.max_by("max", "high").alias("max"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("sum").alias("sum"), F.sum("negative_count").alias("negative_count"), F.hll_union_agg("distinct").alias("distinct"),
        F.when(F.count("spread") > 0, F.expr("kll_merge_agg_double(spread)")).alias("spread"),
        F.expr(f"approx_top_k_combine(frequent, {items})").alias("frequent"))


def sketch_profile(state: DataFrame, k: int = 5) -> DataFrame:
    """A profile (``PROFILE_SCHEMA``) from a state: counts and extremes are exact, distinct counts within some 2 % and top values
    as the sketch has them; sample values are the first of these."""
    # Nulls are an item of the sketch.
    items = F.filter(F.transform(F.expr(f"approx_top_k_estimate(frequent, {k + 1})"), lambda e: e["item"]), lambda x: x.isNotNull())
    top = F.slice(items, 1, k)
    # Of equal counts the sketch's order is its own.
    return state.select(
        "column", "dtype", "total_rows", (F.col("total_rows") - F.col("filled")).alias("null_count"),
        F.round(F.coalesce(F.try_divide(F.col("total_rows") - F.col("filled"), F.col("total_rows")), F.lit(0.0)), 4).alias("null_rate"),
        "blank_count", F.hll_sketch_estimate("distinct").alias("unique_count"), "min", "max",
        F.when(F.col("low").isNotNull(), F.round(F.col("sum") / F.col("filled"), 4)).alias("mean"),
        top.alias("top_5_values"), top.alias("sample_values")).to(PROFILE_SCHEMA)


def sketch_quantiles(state: DataFrame, probabilities: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """``(column, quantiles)`` of the numeric columns with values, each within some 1.5 % of its rank."""
    found = [F.expr(f"kll_sketch_get_quantile_double(spread, {float(p)!r}D)") for p in probabilities]
    return state.where("spread IS NOT NULL AND low IS NOT NULL").select("column", F.array(*found).alias("quantiles"))
