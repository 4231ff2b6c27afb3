"""Quality rules: an isolation forest over rule statistics.

Random splits isolate unusual texts after few steps. The forest is grown on all
labelled rows outside the held-out fold, a level of all trees at a time, and the path
length below which a text is rejected is calibrated on the labels of the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm import statistics as st
from tablewright.llm.tables import discard, frugal, held_out, store, with_columns

TREES, DEPTH = 200, 10
#: Path lengths are counted in steps of this part of one.
STEPS = 1024
#: Share of the rows labelled good that the threshold may reject.
LOSS = 0.001
#: What each statistic may reach in ordinary text; the forest sees only what goes beyond.
LIMITS = {"symbols": 0.1, "bars": 0.05, "shouts": 0.3, "capitals": 0.3, "word_length": 1.0, "repeats": 0.3, "same_again": 0.1,
          "dup_lines": 0.5, "digits": 2.0, "stops": 1.0}
FIELDS = [*(T.StructField(c, T.LongType()) for c in st.COUNTS), T.StructField("base_failed", T.BooleanType()),
          T.StructField("kept", T.BooleanType()), T.StructField("path_length", T.DoubleType())]


def expected_depth(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random tree of ``n`` points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


#: Instead of a feature: a leaf, and a node that is not split yet.
LEAF, WAITING = -1, -2


class IsolationForest:
    """All trees as flat arrays, of which the first nodes are the roots: feature, split, left child (the right one is next) and, in a leaf, its path length."""

    def __init__(self, trees: int = TREES) -> None:
        self.n = trees
        self.feature, self.split = np.full(trees, WAITING), np.zeros(trees)
        self.left, self.path = np.zeros(trees, np.int64), np.zeros(trees)

    def grow(self, nodes: np.ndarray, counts: np.ndarray, feature: np.ndarray, split: np.ndarray, depth: int) -> None:
        """Splits the waiting ``nodes``, or makes them leaves where ``feature`` says so; no row came to others that wait."""
        self.feature[self.feature == WAITING] = LEAF
        self.feature[nodes], self.split[nodes] = feature, split
        self.path[nodes] = depth + expected_depth(counts)
        inner = nodes[feature >= 0]
        self.left[inner] = len(self.feature) + 2 * np.arange(len(inner))
        more = 2 * len(inner)
        self.feature = np.append(self.feature, np.full(more, WAITING))
        self.split, self.left = np.append(self.split, np.zeros(more)), np.append(self.left, np.zeros(more, np.int64))
        self.path = np.append(self.path, np.full(more, depth + 1.0))

    def nodes(self, tree: int, points: np.ndarray) -> np.ndarray:
        """Where each point comes to in a tree."""
        at = np.full(len(points), tree)
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            node = at[going]
            at[going] = self.left[node] + (points[going, self.feature[node]] > self.split[node])
            going = going[self.feature[at[going]] >= 0]
        return at

    def path_lengths(self, points: np.ndarray) -> np.ndarray:
        """Mean path length of each point: the shorter, the more unusual."""
        # Most texts go beyond no limit and are one point.
        known, which = np.unique(points, axis=0, return_inverse=True)
        total = np.zeros(len(known))
        for tree in range(self.n):
            total += self.path[self.nodes(tree, known)]
        return total[which.reshape(-1)] / max(self.n, 1)


def excesses(shares: np.ndarray) -> np.ndarray:
    """How far each statistic of a text goes beyond its limit, one column for each rule."""
    return np.maximum(shares**2 - np.array([LIMITS[name] for name in st.SHARES]), 0)


def base_rules(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def _points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, len(st.SHARES))


def labelled_points(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(point, n, good): what the forest sees of the labelled rows outside the held-out fold that pass the base rules, and how many of them are labelled good.

    Rows without text or label are passed over. Rows with one id count once for each point.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shares = st.of_texts(batch.column(1))
            passed = np.flatnonzero(~base_rules(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(passed)), pa.array([x.tobytes() for x in excesses(shares)[passed]], pa.binary())],
                                             names=["doc_id", "point"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    seen = rows.where(~held_out())
    seen = seen.mapInArrow(frugal(run), T.StructType([seen.schema["doc_id"], T.StructField("point", T.BinaryType())])).distinct()
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.min("_label").alias("_label"))
    return seen.join(marks, "doc_id").groupBy("point").agg(F.count("*").alias("n"), F.sum("_label").alias("good"))


def grown(points: DataFrame, trees: int = TREES, most: int = DEPTH, seed: int = 5) -> IsolationForest:
    """A forest over all rows of ``points`` (point, n): each pass finds the extents of a level's nodes and splits them."""
    spark, forest, width = points.sparkSession, IsolationForest(trees), len(st.SHARES)
    lows, highs = [f"low_{k}" for k in range(width)], [f"high_{k}" for k in range(width)]
    schema = ", ".join(["node long", "n long", *[f"{c} double" for c in lows + highs]])
    for depth in range(most + 1):
        shared = spark.sparkContext.broadcast(forest)

        def extents(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            f = shared.value
            for batch in batches:
                rows, n = _points(batch.column(0)), batch.column(1).to_numpy()
                for tree in range(f.n):
                    at = f.nodes(tree, rows)
                    order = np.argsort(at, kind="stable")
                    order = order[f.feature[at[order]] == WAITING]
                    if len(order):
                        nodes, starts = np.unique(at[order], return_index=True)
                        p = rows[order]
                        low, high = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes, np.add.reduceat(n[order], starts), *low.T.copy(), *high.T.copy())],
                                                         names=["node", "n", *lows, *highs])

        found = points.select("point", "n").mapInArrow(frugal(extents), schema).groupBy("node").agg(
            F.sum("n").alias("n"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
        found = found.select("node", "n", F.array(*lows).alias("low"), F.array(*highs).alias("high"))
        found = found.withColumn("free", F.expr(f"filter(sequence(0, {width - 1}), k -> high[k] > low[k])"))
        found = found.withColumn("f", F.when((F.col("n") > 1) & (F.size("free") > 0) & F.lit(depth < most),
                                             F.expr(f"free[cast(pmod(xxhash64({seed}, node), size(free)) as int)]")).otherwise(F.lit(LEAF)))
        split = F.expr(f"if(f < 0, 0D, low[greatest(f, 0)] + (high[greatest(f, 0)] - low[greatest(f, 0)]) * pmod(xxhash64({seed + 1}, node), 1L << 52) / (1L << 52))")
        level = found.select("node", "n", "f", split.alias("split")).orderBy("node").toArrow()
        forest.grow(*(level.column(c).to_numpy() for c in ("node", "n", "f", "split")), depth)
        shared.destroy()
        if not (forest.feature == WAITING).any():
            break
    return forest


def threshold(points: DataFrame, forest: IsolationForest) -> float:
    """The least path length of a kept text, from the labels of all ``points``.

    Without rows labelled both ways nothing but the base rules rejects.
    """
    shared = points.sparkSession.sparkContext.broadcast(forest)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = np.floor(shared.value.path_lengths(_points(batch.column(0))) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(steps), *batch.columns[1:]], names=["step", "n", "good"])

    counted = points.select("point", "n", "good").mapInArrow(frugal(lengths), "step long, n long, good long").groupBy("step").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("step").toArrow()
    steps, n, good = (counted.column(c).to_numpy() for c in ("step", "n", "good"))
    bad = n - good
    if len(steps) < 2 or not good.any() or not bad.any():
        return -1.0
    # The threshold that rejects most bad rows for its loss of good ones, within the loss allowed.
    share = np.cumsum(good)[:-1] / good.sum()
    gain = np.cumsum(bad)[:-1] / bad.sum() - 5 * share
    allowed = share <= LOSS
    if not allowed.any() or gain[allowed].max() <= 0:
        return -1.0
    best = np.flatnonzero(allowed & (gain == gain[allowed].max()))[0]
    return float(steps[best] + steps[best + 1] + 1) / 2 / STEPS


def judge(docs: DataFrame, labels: DataFrame, keep_only: bool = False) -> DataFrame:
    """Rule statistics and verdict of every row: its columns and :data:`FIELDS`, or only the kept rows with ``keep_only``.

    Rejected are texts of under 20 words, or with over 30 % of their words in repeated
    8-word windows, or whose path is shorter than the threshold. Null and empty texts
    have no words and are rejected. Null ids and repeated rows are judged like others;
    columns of ``docs`` named like an added one are left out. An empty table stays
    empty; without labels only the base rules reject.
    """
    points = store(labelled_points(docs, labels), "points")
    fitted = grown(points)
    plain = fitted.feature, fitted.split, fitted.left, fitted.path, threshold(points, fitted)
    discard(points)
    model = docs.sparkSession.sparkContext.broadcast(plain)

    def work():
        forest = IsolationForest()
        *arrays, least = model.value
        forest.feature, forest.split, forest.left, forest.path = arrays

        def run(array: pa.Array) -> dict[str, np.ndarray]:
            counts, shares = st.of_texts(array)
            failed, paths = base_rules(counts), forest.path_lengths(excesses(shares))
            return {**counts, "base_failed": failed, "kept": ~failed & (paths >= least), "path_length": paths}
        return run

    return with_columns(docs, "text", FIELDS, work, "kept" if keep_only else None)
