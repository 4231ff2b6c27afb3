"""Rows newer than a watermark, compared in the column's own type."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tablewright.functions.columns import col


def _bound(df: DataFrame, column: str, previous: Any) -> Column:
    return F.lit(previous).cast(df.schema[column].dataType)


def new_rows(df: DataFrame, column: str, previous: Any = None, lookback: str | None = None,
             seen: DataFrame | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Rows after the previous watermark, everything if there is none.

    The typed comparison is pushed down to the scan. With the keys ``seen`` by earlier loads, rows that tie with
    the watermark and rows without a watermark value are read again and those with a seen key left out (a null in a key
    equals a null); ``lookback`` (an interval such as ``INTERVAL 2 DAYS`` or a number) reads
    late rows so far back too. Without the keys only rows after the watermark come.
    """
    if previous is None:
        return df
    bound = _bound(df, column, previous)
    if seen is None or not key:
        if lookback is not None:
            raise ValueError("a lookback needs the keys already seen")
        return df.where(col(column) > bound)
    low = bound if lookback is None else bound - F.expr(lookback)
    again = df.where((col(column) >= low) | col(column).isNull())
    names = [f"_seen_{i}" for i in range(len(key))]
    known = seen.select(*[col(k).alias(n) for k, n in zip(key, names)]).distinct()
    return again.join(known, reduce(lambda x, y: x & y, [col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names)]), "left_anti")


def old_rows(column: str, df: DataFrame, previous: Any) -> Column:
    """An aggregate: rows at or before the previous watermark, or without a watermark value."""
    return F.count_if((col(column) <= _bound(df, column, previous)) | col(column).isNull())


def new_watermark(increment: DataFrame, column: str, previous: Any = None) -> DataFrame:
    """``(new_row_count, watermark_value, null_watermarks)`` of an increment.

    Without new rows the previous value stays.
    """
    newest = F.max(col(column))
    if previous is not None:
        newest = F.coalesce(F.greatest(newest, _bound(increment, column, previous)), _bound(increment, column, previous))
    return increment.agg(
        F.count(F.lit(1)).alias("new_row_count"), newest.cast("string").alias("watermark_value"),
        F.count_if(col(column).isNull()).alias("null_watermarks"))


def observe_rows(df: DataFrame, name: str, *more: Column) -> tuple[DataFrame, Observation]:
    """The frame with a row counter (and more aggregates) filled by whatever action runs it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen


def observe_watermark(df: DataFrame, column: str, name: str = "watermark") -> tuple[DataFrame, Observation]:
    """Row count and high-water mark from the same job that writes the increment."""
    return observe_rows(df, name, F.max(col(column)).cast("string").alias("watermark_value"))
