"""Exact interpolated quantiles by radix selection, without sorting or collecting a column.

Every number has a 64-bit key in the order of the numbers. A round counts the rows of all
columns by 16 bits of their keys, finds the bucket that holds each wanted rank, and the
next round looks at those buckets only. Four rounds read every bit, whatever
the values are; a bucket with one value ends sooner. Memory is bounded by the buckets of
a round, and a value held by a third of all rows is one bucket like any other.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tablewright.functions.columns import col, fields, is_integral
from tablewright.functions.sql import quote

#: Bits of a key that one round counts by.
DIGIT = 16
# Fixed values of 64-bit floating point: bits of the fraction, offset of the exponent, least normal and least positive number.
FRACTION, OFFSET, NORMAL, LEAST = 52, 1023, 2.2250738585072014e-308, 5e-324
_TOP = -(1 << 63)
_NAN = (1 << 63) - 1


def _whole(f: T.StructField) -> bool:
    return is_integral(f.dataType) and not (isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 18)


def float_key(values: DataFrame, name: str, key: str) -> DataFrame:
    """Adds ``key``: a long in the order of the doubles in ``name``; both zeros are 0, and no number is above nan.

    For positive numbers it is the number's own 64 bits, put together from exponent and fraction:
    powers of two and quotients by them are exact.
    """
    size, power = F.abs(col(name)), F.pow(F.lit(2.0), F.col("_power").cast("double"))
    low, high = F.pow(F.lit(2.0), F.col("_guess").cast("double")), F.pow(F.lit(2.0), (F.col("_guess") + 1).cast("double"))
    rows = values.withColumn("_size", size)
    # The logarithm may be off by one beside a power of two.
    rows = rows.withColumn("_guess", F.floor(F.log2(F.when((F.col("_size") >= NORMAL) & (F.col("_size") < math.inf), F.col("_size")))).cast("int"))
    rows = rows.withColumn("_power", F.col("_guess") + F.when(F.col("_size") < low, -1).when(F.col("_size") >= high, 1).otherwise(0))
    normal = (F.col("_power") + OFFSET).cast("long") * F.lit(1 << FRACTION) + ((F.col("_size") / power - 1.0) * F.lit(float(1 << FRACTION))).cast("long")
    bits = (F.when(F.col("_size") < NORMAL, (F.col("_size") / F.lit(LEAST)).cast("long"))
            .when(F.col("_size") == math.inf, F.lit((2 * OFFSET + 1) << FRACTION)).otherwise(normal))
    made = F.when(F.isnan(name), F.lit(_NAN)).when(col(name) < 0, -bits).otherwise(bits)
    return rows.withColumn(key, F.when(col(name).isNotNull(), made)).drop("_size", "_guess", "_power")


def key_value(key: int, whole: bool, scale: int = 0) -> float:
    """The number of a key."""
    if whole:
        return key / 10**scale if scale else float(key)
    if key == _NAN:
        return math.nan
    number = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -number if key < 0 else number


def exact_quantiles(df: DataFrame, columns: Iterable[str], probabilities: Sequence[float] = (0.25, 0.75)) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles (``PERCENTILE_CONT``) of numeric columns; null without a value.

    One scan a round for all columns. Later rounds filter by the ranges that the wanted buckets span, which reaches the scan.
    """
    chosen = fields(df, columns)
    if not chosen:
        return {}
    ranks = F.array_sort(F.array_distinct(F.concat(*[
        F.array(F.floor(F.lit(float(p)) * (F.col("total") - 1)).cast("long"), F.ceil(F.lit(float(p)) * (F.col("total") - 1)).cast("long"))
        for p in probabilities])))
    found: dict[int, dict[int, int]] = {i: {} for i in range(len(chosen))}
    totals: dict[int, int] = {}
    #: Open buckets: column, least and greatest key in it, rows before it, the ranks it holds.
    open_: list[tuple[int, int, int, int, list[int]]] = []
    before_, shift = 64, 64 - DIGIT
    while True:
        rows = _keys(df, chosen, open_ if totals else None)
        if totals:
            spans = df.sparkSession.createDataFrame([(i, low >> before_, before, held) for i, low, _, before, held in open_],
                                                    "i int, prefix long, before long, held array<long>")
            # As many rows as there are open buckets: two for each column and probability at most.
            rows = rows.withColumn("prefix", F.shiftright("key", before_)).join(F.broadcast(spans), ["i", "prefix"])
            rows = rows.groupBy("i", "prefix", F.shiftright("key", shift).alias("digit"))
            counts = rows.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"),
                              F.any_value("before").alias("before"), F.any_value("held").alias("held"))
            counts = counts.withColumn("total", F.lit(0).cast("long"))
        else:
            counts = rows.groupBy("i", F.shiftright("key", shift).alias("digit")).agg(
                F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
            counts = counts.withColumn("total", F.sum("n").over(W.partitionBy("i"))).withColumns(
                {"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "held": ranks})
        # 2^16 buckets of a column at most are put in order by one task.
        upto = F.col("before") + F.sum("n").over(W.partitionBy("i", "prefix").orderBy("digit").rowsBetween(W.unboundedPreceding, 0))
        counts = counts.withColumn("upto", upto)
        held = F.filter("held", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
        hit = counts.withColumn("held", held).where(F.size("held") > 0).select("i", "low", "high", (F.col("upto") - F.col("n")).alias("before"), "held", "total", "n")
        open_, left = [], 0
        for r in hit.collect():
            totals.setdefault(r["i"], r["total"])
            if r["low"] == r["high"]:
                found[r["i"]].update(dict.fromkeys(r["held"], r["low"]))
            else:
                open_.append((r["i"], r["low"], r["high"], r["before"], list(r["held"])))
                left += r["n"]
        if not open_:
            break
        # So many rows have no more keys than a round has buckets: all bits that are left make one round.
        before_, shift = shift, 0 if left <= 1 << DIGIT else shift - DIGIT
    result: dict[str, list[float | None]] = {}
    for i, f in enumerate(chosen):
        result[f.name] = []
        for p in probabilities:
            if i not in totals:
                result[f.name].append(None)
                continue
            position = p * (totals[i] - 1)
            scale = f.dataType.scale if isinstance(f.dataType, T.DecimalType) else 0
            lower, upper = (key_value(found[i][r], _is_long(f), scale) for r in (math.floor(position), math.ceil(position)))
            part = position - math.floor(position)
            result[f.name].append(lower if part == 0 or lower == upper else lower + (upper - lower) * part)
    return result


def _is_long(f: T.StructField) -> bool:
    return _whole(f) or isinstance(f.dataType, T.DecimalType) and f.dataType.precision <= 18


def _keys(df: DataFrame, chosen: list[T.StructField], spans: list[tuple] | None) -> DataFrame:
    """``(i, key)`` of the cells that are not null, of all columns in one scan; with ``spans`` only of cells within them."""
    cells, anywhere = [], F.lit(False)
    for i, f in enumerate(chosen):
        c, wanted = col(f.name), col(f.name).isNotNull()
        scale = f.dataType.scale if isinstance(f.dataType, T.DecimalType) else 0
        if spans is not None:
            wanted = F.lit(False)
            for _, low, high, _, _ in (s for s in spans if s[0] == i):
                wanted = wanted | c.between(*(_end(f, k) for k in (low, high)))
        anywhere = anywhere | wanted
        number = F.when(wanted, c)
        whole = (F.expr(f"CAST(CAST({quote(f.name)} * 1e{scale}BD AS DECIMAL(38,0)) AS BIGINT)") if scale else c.cast("long")) if _is_long(f) else None
        cells.append(F.struct(F.lit(i).alias("i"), (F.lit(None).cast("double") if whole is not None else number.cast("double")).alias("number"),
                              (F.lit(None).cast("long") if whole is None else F.when(wanted, whole)).alias("whole")))
    values = df.where(anywhere).select(F.inline(F.array(*cells))).where("number IS NOT NULL OR whole IS NOT NULL")
    return float_key(values, "number", "_bits").select("i", F.coalesce("whole", "_bits").alias("key"))


def _end(f: T.StructField, key: int) -> Column:
    """The value of a key as a literal of the column's type."""
    if isinstance(f.dataType, T.DecimalType) and _is_long(f):
        return F.lit(key).cast("decimal(38,0)").cast(T.DecimalType(38, f.dataType.scale)) / F.lit(10**f.dataType.scale) if f.dataType.scale else F.lit(key).cast(f.dataType)
    if _whole(f):
        return F.lit(key)
    return F.lit(key_value(key, False)).cast("double")
