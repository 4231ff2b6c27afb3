"""Exact top-k search by inner product.

Queries and candidates are packed into tiles. Each pair of tiles is one matrix
product, from which the best of each query are picked; the short lists are merged
within a task, then in groups, then for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablewright.llm.tables import store

#: Rows of a tile: its product with another holds as many scores as their product.
CANDIDATES, QUERIES = 4096, 1024
TILE = "dim int, block long, ids binary, vectors binary"
BEST = "query_id long, vec_id long, score long"
_LOW, _HIGH = -(2**63), 2**63 - 1


def integer_vectors(df: DataFrame, column: str = "embedding", factor: int = 256) -> DataFrame:
    """vec_id and the vector of floor(factor * x), x as double; without vectors that are null or hold null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col(column).cast("array<double>")
    good = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(
        "vec_id is not null and v is not null").where(F.forall("v", finite))
    return good.select("vec_id", F.transform("v", lambda x: F.floor(x * factor).cast("double")).alias("v"))


def tiles(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors packed by ``rows``, in order of vec_id within a tile, one dimension in each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def tile(dim: int) -> pa.RecordBatch:
            ids, parts = zip(*sorted(held.pop(dim), key=lambda x: x[0]))
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([hash((ids[0], ids[-1], len(ids))) >> 1], pa.int64()),
                 pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary())],
                names=["dim", "block", "ids", "vectors"])

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = v.values.to_numpy(zero_copy_only=False)
                group = held.setdefault(len(values), [])
                group.append((vec_id, values))
                if len(group) == rows:
                    yield tile(len(values))
        for dim in list(held):
            yield tile(dim)

    return vectors.mapInArrow(run, TILE)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; beyond 64 bits they stay at the ends of that range."""
    if a.size == 0 or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**52:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.clip(exact, _LOW, _HIGH).astype(np.int64)


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lists of the queries met by this task, merged tile by tile, and sent on when they are many.
        held: dict[int, list[tuple[int, int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(q, v, -s) for q, best in held.items() for s, v in best]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))],
                                              names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                queries, ids = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                score = _scores(np.frombuffer(row["query_vectors"]).reshape(len(queries), dim), np.frombuffer(row["vectors"]).reshape(len(ids), dim))
                # Rows with one id are one candidate, with its best score, before any is left out.
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                if len(first) < len(ids):
                    ids, score = ids[first], np.maximum.reduceat(score, first, axis=1)
                own = queries[:, None] == ids[None, :]
                for i, q in enumerate(queries.tolist()):
                    line, others = score[i], np.flatnonzero(~own[i])
                    if len(others) > k:
                        # Everything at or above the k-th best score; ids are in order, so a stable sort breaks ties.
                        least = np.partition(line[others], len(others) - k)[len(others) - k]
                        others = others[line[others] >= least]
                    others = others[np.argsort(-line[others].astype(object) if line[others].min(initial=0) == _LOW else -line[others], kind="stable")]
                    merged: dict[int, int] = {}
                    for s, v in held.get(q, []) + [(-int(line[j]), int(ids[j])) for j in others[:k]]:
                        merged[v] = min(s, merged.get(v, s))
                    held[q] = sorted((s, v) for v, s in merged.items())[:k]
                if len(held) > 100_000:
                    yield out()
        yield out()
    return run


def top_k(df: DataFrame, is_query, k: int = 5, column: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows for each row where ``is_query`` holds.

    The score is the inner product of :func:`integer_vectors`; ties go to the smaller
    vec_id; a row is no candidate for its own vec_id; with fewer rows all are given.
    Vectors meet those of their own length only. Rows with one vec_id are one
    candidate or query with its best score. Null ids take no part. Products beyond 64
    bits are held at the ends of that range. Extra columns are not read.
    """
    vectors = integer_vectors(df, column)
    asked = store(tiles(vectors.where(is_query), queries).select(
        "dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")), "queries")
    shards = store(tiles(vectors, candidates), "shards")
    # Tiles meet tiles, never rows rows; neither side is held whole anywhere.
    pairs = shards.hint("shuffle_replicate_nl").join(asked.withColumnRenamed("dim", "query_dim"), F.col("dim") == F.col("query_dim")).select(
        "dim", "block", "ids", "vectors", "query_ids", "query_vectors")
    best = pairs.mapInArrow(_best(k), BEST).withColumn("_group", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    once = best.groupBy("query_id", "_group", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("vec_id")]
    first = once.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_group").orderBy(*order))).where(F.col("_n") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return first.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
