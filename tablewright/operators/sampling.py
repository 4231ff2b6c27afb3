"""Head, tail and exact-size samples that stay distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablewright.functions.columns import col

# Fixed value: sample size.
SAMPLE_SIZE = 2000

# The candidates of the tasks are merged in so many groups before the last merge.
MERGE_GROUPS = 256


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows in a given order.

    Every task keeps n candidates, groups of tasks merge theirs, and the last merge
    gets n rows from each group, however many tasks there are.
    """
    within = W.partitionBy("_group").orderBy(*order)
    ranked = (df.withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
              .withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= n))
    return ranked.drop("_group", "_rank").orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return first_rows(df, [F.desc(c) for c in order], n)


def _row_digest(keys: Sequence[str], seed: int) -> Column:
    text = F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.md5(text)


def hash_sample(df: DataFrame, keys: Sequence[str], n: int = SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, those with the smallest digest of their keys."""
    tagged = df.withColumn("_digest", _row_digest(keys, seed))
    return first_rows(tagged, ["_digest", *keys], n).drop("_digest")


def three_bucket_sample(df: DataFrame, order: Sequence[str], n: int = SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """Head, tail and hash-ordered thirds, without repeated rows."""
    third = n // 3
    head = first_rows(df, list(order), third)
    tail = last_rows(df, order, third)
    middle = hash_sample(df, df.columns, n - 2 * third, seed)
    return head.unionByName(tail).unionByName(middle).distinct()


def sample(df: DataFrame, order: Sequence[str], n: int = SAMPLE_SIZE, seed: int = 42, method: str = "hash") -> DataFrame:
    """A sample by ``hash`` or by ``three_bucket``, whatever the size of the table."""
    if method == "hash":
        return hash_sample(df, df.columns, n, seed)
    if method == "three_bucket":
        return three_bucket_sample(df, order, n, seed)
    raise ValueError(f"unknown sampling method: {method}")
