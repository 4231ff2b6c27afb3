"""Cosine similarity and nearest vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tablewright.functions.columns import col

# Rows and queries that meet in one cell on average.
CELL_ROWS, CELL_QUERIES = 32_768, 2048


def cosine_to(vector: str, query: Sequence[float]) -> Column:
    """Cosine similarity of an array column to one vector; null for a zero vector."""
    norm = math.sqrt(sum(float(q) ** 2 for q in query))
    fixed = F.array(*[F.lit(float(q)) for q in query])
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(F.col(vector), fixed, lambda a, b: a.cast("double") * b), zero, lambda s, x: s + x)
    length = F.sqrt(F.aggregate(F.col(vector), zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, length * F.lit(norm))


def most_similar(df: DataFrame, vector: str, query: Sequence[float], k: int = 5, ties: str | None = None) -> DataFrame:
    """The k rows most similar to one vector, with ``similarity`` to four places."""
    order = [F.desc_nulls_last("_similarity")] + ([F.asc(ties)] if ties else [])
    return (
        df.withColumn("_similarity", F.round(cosine_to(vector, query), 10)).orderBy(*order).limit(k)
        .withColumn("similarity", F.round("_similarity", 4)).drop("_similarity"))


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame | Sequence[tuple[object, Sequence[float]]],
            k: int = 5) -> DataFrame:
    """``(query, key, similarity, rank)``: the k nearest rows of each query vector, ties by key.

    ``queries`` is a frame of any size whose first two columns are the query's name and
    its vector, or a short list of such pairs. Blocks of queries meet blocks of rows on a grid of cells; a cell passes on k
    rows for each of its queries, so no row-query pairs are shuffled, and neither side is held whole
    anywhere. Null and zero vectors, and those of another length than the query's, are nobody's neighbours.
    """
    if not isinstance(queries, DataFrame):
        if not queries:
            raise ValueError("no query vectors")
        queries = df.sparkSession.createDataFrame([(q, [float(x) for x in v]) for q, v in queries])
    label, asked = queries.columns[:2]
    rows = df.select(col(key).alias("_key"), col(vector).cast("array<double>").alias("_vector")).where("_vector IS NOT NULL")
    wanted = queries.select(col(label).alias("query"), col(asked).cast("array<double>").alias("_asked")).where("_asked IS NOT NULL")
    n_rows, n_queries = rows.count(), wanted.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    across = max(-(-n_queries // CELL_QUERIES), 1)
    down = max(-(-n_rows // CELL_ROWS), min(-(-2 * cores // across), -(-n_rows // 256)), 1)
    left = (wanted.withColumn("_size", F.size("_asked")).withColumn("_across", F.pmod(F.xxhash64("query", "_asked"), F.lit(across)).cast("int"))
            .withColumn("_down", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))))
    right = (rows.withColumn("_size", F.size("_vector")).withColumn("_down", F.pmod(F.xxhash64("_key", "_vector"), F.lit(down)).cast("int"))
             .withColumn("_across", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))))
    cell = ["_size", "_across", "_down"]
    schema = T.StructType([wanted.schema["query"], rows.schema["_key"], T.StructField("_similarity", T.DoubleType())])
    best = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k), schema)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("_similarity"), F.asc("_key")))
    return (
        best.withColumn("rank", rank).where(F.col("rank") <= k)
        .select("query", F.col("_key").alias(key), F.round("_similarity", 4).alias("similarity"), F.col("rank").cast("long").alias("rank")))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(-1, size) if size else np.zeros((len(column), 0))
    lengths = np.linalg.norm(rows, axis=1)
    lengths[lengths == 0] = np.nan
    return rows / lengths[:, None]


def _cell(k: int):
    def score(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        size = key[0].as_py()
        queries, names = asked.column("query"), rows.column("_key")
        matrix, vectors = _matrix(asked.column("_asked"), size), _matrix(rows.column("_vector"), size)
        # Ties go to the smaller key: rows are put in its order once, and sorts are stable.
        order = pc.sort_indices(names).to_numpy() if len(rows) else np.zeros(0, np.int64)
        vectors, picked, scores = vectors[order], [], []
        for at in range(0, len(matrix), 512):
            # Rounded so that equal vectors tie whatever the order of summation.
            found = np.round(matrix[at:at + 512] @ vectors.T, 10)
            for j, line in enumerate(found):
                good = np.flatnonzero(~np.isnan(line))
                if len(good) > k:
                    # Everything tied with the k-th score stays until the key decides.
                    least = np.partition(line[good], len(good) - k)[len(good) - k]
                    good = good[line[good] >= least]
                good = good[np.argsort(-line[good], kind="stable")][:k]
                picked += [(at + j, i) for i in good.tolist()]
                scores += line[good].tolist()
        who = pa.array([q for q, _ in picked], pa.int64())
        which = pa.array([int(order[i]) for _, i in picked], pa.int64())
        return pa.Table.from_arrays([queries.take(who), names.take(which), pa.array(scores, pa.float64())], names=["query", "_key", "_similarity"])

    return score


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``(group, vector)``: component means of whole vectors, as one aggregate without exploding them.

    Null vectors take no part; vectors of unequal lengths are an error.
    """
    length = F.array_size(F.col(vector))
    shortest, longest = df.agg(F.min(length), F.max(length)).first()
    if shortest != longest:
        raise ValueError(f"{vector} holds vectors of {shortest} to {longest} components")
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(longest or 0)]
    return df.groupBy(group).agg(F.array(*means).cast("array<double>").alias(vector))
