"""Column statistics: one wide aggregate plus one grouped count per data type."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tablewright.functions.columns import by_type, col, fields, groupable, type_name
from tablewright.functions.sql import literal, quote, stripped
from tablewright.operators.texts import first_texts, ranked, settled, text_counts
from tablewright.schemas import PROFILE_SCHEMA

# Columns per aggregate, to stay inside compiled code on wide tables.
COLUMNS_PER_PASS = 16


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def column_stats(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: counts, extremes and mean, one scan per 16 columns."""
    chosen = fields(df, columns)
    passes = [chosen[i:i + COLUMNS_PER_PASS] for i in range(0, len(chosen), COLUMNS_PER_PASS)]
    return union_all(_stats_pass(df, p) for p in passes)


def _stats_pass(df: DataFrame, chosen: list[T.StructField]) -> DataFrame:
    aggregates, rows = ["count(1) AS total"], []
    for i, f in enumerate(chosen):
        c = quote(f.name)
        aggregates.append(f"count_if({c} IS NULL) AS nulls_{i}")
        blanks = "0L"
        low = high = mean = negatives = "NULL"
        if isinstance(f.dataType, T.NumericType):
            # Adding zero turns a negative zero, which may come first or last, into zero.
            zero = f" + CAST(0 AS {f.dataType.simpleString()})" if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else ""
            aggregates += [f"min({c}){zero} AS min_{i}", f"max({c}){zero} AS max_{i}",
                           f"avg(CAST({c} AS DOUBLE)) AS mean_{i}", f"count_if({c} < 0) AS negatives_{i}"]
            low, high, mean, negatives = f"min_{i}", f"max_{i}", f"mean_{i}", f"negatives_{i}"
        elif isinstance(f.dataType, T.StringType):
            aggregates.append(f"count_if({stripped(c)} = '') AS blanks_{i}")
            blanks = f"blanks_{i}"
        rows.append(
            f"named_struct('column', {literal(f.name)}, 'dtype', {literal(type_name(f.dataType))},"
            f" 'total_rows', total, 'null_count', nulls_{i}, 'blank_count', {blanks},"
            f" 'min', CAST({low} AS STRING), 'max', CAST({high} AS STRING),"
            f" 'mean', CAST({mean} AS DOUBLE), 'negative_count', CAST({negatives} AS BIGINT))"
        )
    wide = df.agg(*[F.expr(a) for a in aggregates])
    return wide.selectExpr(f"inline(array({', '.join(rows)}))")


def typed_values(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """``(column, value)`` of the non-null values, one frame per data type."""
    df = df.select(*[groupable(f) for f in fields(df, columns)])
    return {kind: df.select(*[col(c) for c in names]).unpivot([], [col(c) for c in names], "column", "value").where(F.col("value").isNotNull())
            for kind, names in by_type(df, df.columns).items()}


def value_counts(values: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``(column, value, n)`` of the distinct values of each type; of texts as in :func:`~tablewright.operators.texts.text_counts`.

    Columns of the same type are unpivoted together and grouped in their own
    type: no cast to text before the shuffle, and repeated values are combined
    on the map side, so a hot value costs one row per task. Texts are counted by digest and first
    characters, so a document column does not shuffle the documents.
    """
    return {kind: text_counts(v) if kind == "string" else v.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            for kind, v in values.items()}


def settle(df: DataFrame) -> DataFrame:
    """A report-sized frame (a few rows per column) computed once, for use in several places."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def distinct_counts(df: DataFrame, columns: Iterable[str] | None = None,
                    exact: bool = True, rsd: float = 0.02) -> DataFrame:
    """``(column, unique_count)`` of the non-null values."""
    wanted = [f.name for f in fields(df, columns)]
    if not exact:
        wide = df.agg(*[F.approx_count_distinct(groupable(f), rsd).alias(f.name) for f in fields(df, wanted)])
        return wide.unpivot([], [col(c) for c in wanted], "column", "unique_count")
    return union_all(
        v.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
        for v in value_counts(typed_values(df, wanted)).values()
    )


def top_values(df: DataFrame, columns: Iterable[str] | None = None, k: int = 5) -> DataFrame:
    """``(column, rank, value, n)``: the k most frequent values, ties by value. Runs at once."""
    return _picked(df, columns, k, True)


def sample_values(df: DataFrame, columns: Iterable[str] | None = None, k: int = 5) -> DataFrame:
    """``(column, rank, value, n)``: the k smallest distinct values, whole, with their number. Runs at once."""
    return _picked(df, columns, k, False)


def _picked(df: DataFrame, columns: Iterable[str] | None, k: int, frequent: bool) -> DataFrame:
    values = typed_values(df, columns)
    rows = [r for kind in values if kind == "string" for r in first_texts(values[kind], k, frequent)]
    others = value_counts({kind: v for kind, v in values.items() if kind != "string"})
    if others:
        rows += [tuple(r) for r in union_all(_ranked(v, k, frequent) for v in others.values()).collect()]
    return df.sparkSession.createDataFrame(rows, "column string, rank long, value string, n long")


def approx_top_values(df: DataFrame, columns: Iterable[str] | None = None, k: int = 5) -> DataFrame:
    """``(column, rank, value, n)`` from a mergeable sketch: one pass, no shuffle of values, counts may be off."""
    names = [f.name for f in fields(df, columns)]
    wide = df.agg(*[F.expr(f"approx_top_k(CAST({quote(c)} AS STRING), {k})").alias(c) for c in names])
    return wide.unpivot([], [col(c) for c in names], "column", "found").select(
        "column", F.posexplode("found").alias("_i", "_item")).select(
        "column", (F.col("_i") + 1).cast("long").alias("rank"), F.col("_item.item").alias("value"),
        F.col("_item.count").alias("n"))


def _ranked(counts: DataFrame, k: int, frequent: bool) -> DataFrame:
    # row_number <= k is limited within each task before the rows are shuffled.
    by_column = W.partitionBy("column").orderBy(*([F.desc("n")] if frequent else []), F.asc("value"))
    return (
        counts.withColumn("rank", F.row_number().over(by_column)).where(F.col("rank") <= k)
        .select("column", F.col("rank").cast("long").alias("rank"),
                F.col("value").cast("string").alias("value"), "n")
    )


def profile(df: DataFrame, columns: Iterable[str] | None = None, k: int = 5,
            exact: bool = True) -> DataFrame:
    """The full column profile (``PROFILE_SCHEMA``), whatever the table size.

    Runs at once and keeps its result: some ten values per column come to the driver. Top values are the most frequent, ties by value, and sample
    values the smallest distinct ones; texts among them are whole. With ``exact=False`` everything comes from the
    sketches of :mod:`~tablewright.operators.sketches`, which shuffle no values.
    """
    names = [f.name for f in fields(df, columns)]
    if not exact:
        from tablewright.operators import sketches

        return sketches.sketch_profile(sketches.sketch(df, names), k)
    values = typed_values(df, names)
    counts = value_counts(values)
    stats, unique, top, least = {}, dict.fromkeys(names, 0), {c: [] for c in names}, {c: [] for c in names}
    texts: dict[bool, list] = {True: [], False: []}
    for row in _profile_rows(df, names, counts, k).collect():
        if row["stats"] is not None:
            stats[row["column"]] = row["stats"]
        elif row["unique_count"] is not None:
            unique[row["column"]] = row["unique_count"]
        elif row["head"] is not None:
            texts[row["frequent"]].append(row)
        else:
            (top if row["frequent"] else least)[row["column"]].append((row["rank"], row["value"]))
    for frequent, found in texts.items():
        if found:
            for c, picked in settled(values["string"], counts["string"], found, k, frequent).items():
                (top if frequent else least)[c] = [(i, text) for i, (text, _) in enumerate(picked)]
    rows = []
    for c in names:
        s = stats[c]
        rate = s["null_count"] / s["total_rows"] if s["total_rows"] else 0.0
        rows.append((
            c, s["dtype"], s["total_rows"], s["null_count"], rate, s["blank_count"], unique[c], s["min"],
            s["max"], s["mean"], [v for _, v in sorted(top[c], key=lambda x: x[0])], [v for _, v in sorted(least[c], key=lambda x: x[0])]))
    made = df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)
    return made.withColumns({"null_rate": F.round("null_rate", 4), "mean": F.round("mean", 4)})


def _profile_rows(df: DataFrame, names: list[str], counts: dict[str, DataFrame], k: int) -> DataFrame:
    """A few rows per column: its statistics, its distinct count, its top and its smallest values."""
    stats = column_stats(df, names)
    parts = [stats.select("column", F.struct(*stats.columns[1:]).alias("stats"))]
    # All kinds of rows come from one grouped count, whose shuffle is planned once and reused.
    for kind, c in counts.items():
        parts.append(c.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("unique_count")))
        for frequent in (True, False):
            picked = ranked(c, k, frequent) if kind == "string" else _ranked(c, k, frequent)
            parts.append(picked.withColumn("frequent", F.lit(frequent)).withColumn("rank", F.col("rank").cast("long")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    for name, kind in (("unique_count", "long"), ("head", "string"), ("value", "string"), ("_a", "long"), ("_b", "long"), ("frequent", "boolean"),
                       ("rank", "long"), ("n", "long")):
        if name not in whole.columns:
            whole = whole.withColumn(name, F.lit(None).cast(kind))
    return whole


def row_digest(df: DataFrame, columns: Iterable[str] | None = None) -> list:
    """Two independent 64-bit hashes of a row, with null flags (hashing skips nulls).

    Two different rows among 10^12 share both with a probability of about 10^-15.
    """
    names = [f.name for f in fields(df, columns)]
    cells = [x for f in fields(df, names) for x in (col(f.name).isNull(), groupable(f))]
    return [F.xxhash64(*cells), F.xxhash64(F.lit(len(names)), *reversed(cells))]


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """``(total_rows, distinct_rows, duplicate_row_count)`` from one grouped count.

    Rows are shuffled as 16-byte digests, combined on the map side.
    """
    first, second = row_digest(df)
    groups = df.select(first.alias("_a"), second.alias("_b")).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"),
    )


def merge_counts(*profiles: DataFrame) -> DataFrame:
    """Row and null counts of a union of tables from the tables' profiles."""
    return union_all(p.select("column", "total_rows", "null_count") for p in profiles).groupBy("column").agg(
        F.sum("total_rows").alias("total_rows"), F.sum("null_count").alias("null_count"))


def std_estimate(stats: DataFrame) -> DataFrame:
    """``(column, std_estimate)``: a quarter of the range, null extremes read as 0."""
    low = F.coalesce(F.expr("try_cast(min AS DOUBLE)"), F.lit(0.0))
    high = F.coalesce(F.expr("try_cast(max AS DOUBLE)"), F.lit(0.0))
    return stats.select("column", ((high - low) / 4).alias("std_estimate"))


def exact_std(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    names = list(columns)
    return df.agg(*[F.stddev_samp(col(c)).alias(c) for c in names]).unpivot([], [col(c) for c in names], "column", "std_estimate")


def risk_columns(prof: DataFrame, null_rate: float = 0.10, value_range: float = 1000.0) -> DataFrame:
    """Columns worth a closer look: many nulls, or a wide numeric range."""
    span = F.expr("try_cast(max AS DOUBLE) - try_cast(min AS DOUBLE)")
    wide = F.col("mean").isNotNull() & (F.coalesce(span, F.lit(0.0)) > value_range)
    return (
        prof.select("column", (F.col("null_rate") > null_rate).alias("high_null"), wide.alias("wide_range"))
        .where("high_null OR wide_range")
    )
