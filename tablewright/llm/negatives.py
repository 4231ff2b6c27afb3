"""Hard-negative mining with bounds along a spanning tree of the anchors.

Anchors of a tile are joined by a minimum spanning tree. A candidate's score at an
anchor differs from its score at the parent by at most the length of the edge times
the candidate's norm, so the parent's score (or bounds) bounds the child's. Only
candidates whose bounds overlap a window that the child asks for are scored anew.

Anchor tiles and candidate tiles meet on a grid of cells. Each cell keeps short lists
only, and the lists of the cells are merged for each anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.llm.tables import store

#: Rows of a tile, and rows of each side that a cell holds at most on average.
ANCHORS, CANDIDATES = 512, 2048
CELL_ANCHORS, CELL_CANDIDATES = 8192, 32_768
#: Components beyond this count as this: their products are far beyond 64 bits.
LARGEST = 1e150
#: Products beyond 64 bits are held at these ends.
_LOW, _HIGH = -(2**63), 2**63 - 1
#: Sums of products up to here are exact in floating point.
_EXACT = 2**52
#: Bounds are widened by this share and amount, far more than rounding can take from them.
_SHARE, _AMOUNT = 1e-12, 1e-6

TILE = "dim int, block long, n int, ids binary, labels binary, vectors binary, parents binary, edges binary, bounds binary"


def labelled_vectors(df: DataFrame, column: str = "embedding", label: Column | None = None) -> DataFrame:
    """vec_id, label and vector (v) of the rows that take part: no null among the three, no null or non-finite component."""
    vector = F.col(column).cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                     vector.alias("v"))
    return rows.where("vec_id is not null and label is not null and v is not null").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def spanning_tree(vectors: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each vector (-1 for a root) and its distance: a minimum spanning tree of each group, by Prim's method."""
    parents, edges = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
    for group in np.unique(groups):
        own = np.flatnonzero(groups == group)
        v = vectors[own]
        square = (v * v).sum(axis=1)
        apart = np.maximum(square[:, None] + square[None, :] - 2 * (v @ v.T), 0)
        root = int(np.sqrt(apart).sum(axis=1).argmin())
        nearest, link = apart[root].copy(), np.full(len(own), root)
        nearest[root] = np.inf
        for _ in range(len(own) - 1):
            k = int(nearest.argmin())
            parents[own[k]] = own[link[k]]
            # The length itself, not from the sum above, which loses digits.
            edges[own[k]] = np.sqrt(((v[k] - v[link[k]]) ** 2).sum())
            closer = (apart[k] < nearest) & np.isfinite(nearest)
            nearest[closer], link[closer] = apart[k][closer], k
            nearest[k] = np.inf
    return parents, edges


def levels(parents: np.ndarray) -> Iterator[np.ndarray]:
    """The nodes of a forest, roots first, each after its parent."""
    level = np.flatnonzero(parents < 0)
    while len(level):
        yield level
        level = np.flatnonzero(np.isin(parents, level))


def walk(anchors: np.ndarray, parents: np.ndarray, edges: np.ndarray, candidates: np.ndarray,
         asked: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, their scores of all candidates, which scores are exact), level by level of the tree.

    ``asked(rows, low, high)`` tells of a level's anchors which candidates' bounds overlap what they ask
    for; those are scored. Roots are scored against all.
    """
    norms = np.sqrt((candidates * candidates).sum(axis=1))
    low, high = (np.empty((len(anchors), len(candidates))) for _ in range(2))
    for rows in levels(parents):
        if parents[rows[0]] < 0:
            scores = anchors[rows] @ candidates.T
            low[rows] = high[rows] = scores
            yield rows, scores, np.ones(scores.shape, bool)
            continue
        reach = edges[rows, None] * norms[None, :]
        reach += reach * _SHARE + _AMOUNT
        under, over = low[parents[rows]] - reach, high[parents[rows]] + reach
        wanted = asked(rows, under, over)
        some = np.flatnonzero(wanted.any(axis=0))
        if len(some):
            scores = anchors[rows] @ candidates[some].T
            hit = wanted[:, some]
            under[:, some] = np.where(hit, scores, under[:, some])
            over[:, some] = np.where(hit, scores, over[:, some])
        low[rows], high[rows] = under, over
        yield rows, under, wanted


def tiles(rows: DataFrame, size: int, trees: str | None = None) -> DataFrame:
    """Rows (vec_id, label, v and perhaps bounds) packed by ``size``, those of a label side by side, one dimension in each tile.

    ``trees`` asks for spanning trees, "all" for one over the tile, "label" for one
    over each label. Whole numbers up to 32,767 are stored in two bytes.
    """
    bounded = "bounds" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def tile(dim: int) -> pa.RecordBatch:
            found = sorted(held.pop(dim), key=lambda r: (r[1], r[0]))
            ids, labels = (np.array([r[k] for r in found], np.int64) for k in (0, 1))
            vectors = np.stack([r[2] for r in found]) if dim else np.zeros((len(found), 0))
            parents, edges = spanning_tree(vectors, labels if trees == "label" else np.zeros(len(found))) if trees else (None, None)
            small = vectors.astype(np.int16) if np.abs(vectors).max(initial=0) <= 32_767 else vectors
            name = int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
            out = [[dim], [name], [len(found)], [ids.tobytes()], [labels.tobytes()], [small.tobytes()],
                   [None if parents is None else parents.tobytes()], [None if edges is None else edges.tobytes()],
                   [np.array([r[3] for r in found], np.int64).tobytes() if bounded else None]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=[f.name for f in schema.fields])

        for batch in batches:
            extra = batch.column(3).to_pylist() if bounded else [None] * batch.num_rows
            for vec_id, label, v, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), extra):
                values = np.floor(256 * np.clip(v.values.to_numpy(zero_copy_only=False), -LARGEST, LARGEST))
                group = held.setdefault(len(values), [])
                group.append((vec_id, label, values, b))
                if len(group) == size:
                    yield tile(len(values))
        for dim in list(held):
            yield tile(dim)

    schema = T._parse_datatype_string(TILE)
    return rows.select("vec_id", "label", "v", *(["bounds"] if bounded else [])).mapInArrow(run, schema)


class Tile:
    """The arrays of one stored tile."""

    def __init__(self, row: dict) -> None:
        n, dim = row["n"], row["dim"]
        self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels"))
        kind = np.int16 if len(row["vectors"]) == 2 * n * dim else np.float64
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, dim).astype(np.float64)
        if row["parents"] is not None:
            self.parents, self.edges = np.frombuffer(row["parents"], np.int32), np.frombuffer(row["edges"])
        if row["bounds"] is not None:
            self.bounds = np.frombuffer(row["bounds"], np.int64).reshape(n, -1, 2)


def _too_large(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(a.size and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] >= _EXACT)


def _big_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.clip(exact, _LOW, _HIGH)


class Lists:
    """The best ``k`` (score, id) of each key; higher scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def least(self, key) -> int:
        """The score below which nothing enters any more."""
        found = self.held.get(key, ())
        return -found[-1][0] if len(found) == self.k else _LOW

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[near], ids[near]
        new = [(-int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist())]
        if new:
            self.held[key] = sorted(self.held.get(key, []) + new)[:self.k]


def _meet(anchors: Tile, candidates: Tile, lists: Lists, same: bool) -> None:
    """Adds to ``lists`` what the candidates bring to the anchors: of their own label, or in the bounds of others."""
    numbers = range(anchors.bounds.shape[1]) if not same else (0,)

    def windows(i: int) -> Iterator[tuple[tuple, int, int]]:
        for k in numbers:
            low, high = (_LOW, _HIGH) if same else anchors.bounds[i, k].tolist()
            if low <= high:
                key = (int(anchors.ids[i]), k)
                yield key, max(low, lists.least(key)), high

    def take(rows: np.ndarray, scores: np.ndarray, exact: np.ndarray, others: Tile) -> None:
        for r, i in enumerate(rows.tolist()):
            fit = exact[r] & (others.ids != anchors.ids[i]) & ((others.labels == anchors.labels[i]) == same)
            where = np.flatnonzero(fit)
            found = scores[r, where]
            for key, low, high in windows(i):
                inside = (found >= low) & (found <= high)
                lists.add(key, found[inside], others.ids[where[inside]])

    if _too_large(anchors.vectors, candidates.vectors):
        scores = _big_scores(anchors.vectors, candidates.vectors)
        take(np.arange(len(anchors.ids)), scores, np.ones(scores.shape, bool), candidates)
        return

    def asked(others: Tile, own: np.ndarray):
        def overlap(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            found = np.zeros(low.shape, bool)
            for r, i in enumerate(own[rows].tolist()):
                for _, least, most in windows(i):
                    found[r] |= (high[r] >= least) & (low[r] <= most)
                found[r] &= (others.labels == anchors.labels[i]) == same
            return found
        return overlap

    if not same:
        own = np.arange(len(anchors.ids))
        for rows, scores, exact in walk(anchors.vectors, anchors.parents, anchors.edges, candidates.vectors, asked(candidates, own)):
            take(rows, scores, exact, candidates)
        return
    # Rows of a label stand side by side on both sides, and so do the nodes of its tree.
    for label in np.intersect1d(anchors.labels, candidates.labels).tolist():
        a, b = np.searchsorted(anchors.labels, [label, label + 1])
        c, d = np.searchsorted(candidates.labels, [label, label + 1])
        part = Tile.__new__(Tile)
        part.ids, part.labels, part.vectors = candidates.ids[c:d], candidates.labels[c:d], candidates.vectors[c:d]
        parents = np.where(anchors.parents[a:b] < 0, -1, anchors.parents[a:b] - a)
        for rows, scores, exact in walk(anchors.vectors[a:b], parents, anchors.edges[a:b], part.vectors, asked(part, np.arange(a, b))):
            take(rows + a, scores, exact, part)


def _grid(anchors: DataFrame, candidates: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, place, vec_id, score): the best ``k`` of each cell."""
    n_anchors, n_candidates = anchors.count(), candidates.count()
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    across = max(-(-n_anchors * ANCHORS // CELL_ANCHORS), 1)
    # No fewer cells than twice the cores, as far as there are tiles.
    down = max(-(-n_candidates * CANDIDATES // CELL_CANDIDATES), min(n_candidates, -(-2 * cores // across)), 1)

    def dealt(tiles_: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        return tiles_.withColumn(own, F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("dim", "_across", "_down")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = Lists(k)
        asking = [Tile(r) for r in left.to_pylist()]
        for i in range(right.num_rows):
            shard = Tile(right.slice(i, 1).to_pylist()[0])
            for tile in asking:
                _meet(tile, shard, lists, same)
        rows = [(a, place, v, -s) for (a, place), best in lists.held.items() for s, v in best]
        columns = zip(*rows) if rows else ([], [], [], [])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                    names=["anchor_id", "place", "vec_id", "score"])

    left = dealt(anchors, "_across", across, "_down", down)
    right = dealt(candidates, "_down", down, "_across", across)
    return left.cogroup(right).applyInArrow(cell, "anchor_id long, place int, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Ranks 1 to ``k`` of each anchor and place; lists are cut in groups first."""
    order = [F.desc("score"), F.asc("vec_id")]
    parts = found.withColumn("_group", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    parts = parts.withColumn("_n", F.row_number().over(Window.partitionBy("anchor_id", "place", "_group").orderBy(*order))).where(F.col("_n") <= k)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(*order))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "place", "rank", "vec_id", "score")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the rows of :func:`labelled_vectors`.

    Scores are inner products of floor(256 * x); higher scores come first, ties by
    smaller vec_id. An anchor's positives are the first ``positives`` rows of its label
    with another vec_id. For each of them the first ``negatives`` rows of other labels are
    returned whose score is from ``low`` to ``high`` percent of the positive's, with rank
    from 1. Anchors without such rows do not appear.

    * rows with null id, label or vector, or a null or non-finite component, take no part
    * vectors of different lengths do not meet; empty vectors have the score 0
    * rows that repeat a vec_id are rows of their own as candidates; of anchors with one id the least (label, vector) counts
    * products beyond 64 bits are held at the ends of that range; there every pair is scored
    * an empty table gives no rows; columns other than vec_id, label and v are not read
    """
    anchors = vectors.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_row")).select("vec_id", "_row.label", "_row.v")
    anchors = store(anchors.sortWithinPartitions("label", "vec_id"), "anchors")
    shards = store(tiles(vectors, CANDIDATES), "shards")
    asked = store(tiles(anchors, ANCHORS, "label"), "asked")
    near = store(_best(_grid(asked, shards, positives, True), positives), "positives")
    # Whole percentages of a score, rounded towards the inside of the window; -1 to -2 is an empty window.
    window = F.array(*[F.coalesce(F.max(F.when(F.col("rank") == k, bound)), F.lit(empty).cast("long")) for k in range(1, positives + 1)
                       for bound, empty in ((F.expr(f"cast(ceil(cast(score as decimal(38,0)) * {low} / 100) as long)"), -1),
                                            (F.expr(f"cast(floor(cast(score as decimal(38,0)) * {high} / 100) as long)"), -2))])
    bounds = near.groupBy("anchor_id").agg(window.alias("bounds"))
    ready = anchors.join(bounds, F.col("vec_id") == F.col("anchor_id")).sortWithinPartitions("label", "vec_id")
    asking = store(tiles(ready.select("vec_id", "label", "v", "bounds"), ANCHORS, "all"), "asking")
    far = _best(_grid(asking, shards, negatives, False), negatives)
    chosen = near.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(chosen, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
