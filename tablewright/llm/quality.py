"""Quality classifier: a factorisation machine.

Features are hashed words and word shapes, statistics of the text's structure and
its length. All pairs of features interact through vectors of low rank; the sum of
squares identity makes the score linear in the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm import statistics as st, text as tx
from tablewright.llm.tables import fit_sample, labelled_sample, with_columns

SAMPLE, LONGEST = 6000, 20_000
#: Bytes of the texts that are worked on at a time: arrays over their words and bytes take a hundred times the room.
RUN = 1 << 18
#: Hash buckets, of which words and shapes share all; dense features come after them.
BUCKETS, RANK = 1 << 16, 8
EPOCHS, BATCH, RATE, DECAY = 5, 32, 0.05, 1e-5
THRESHOLD = 0.7
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def _shape_codes() -> np.ndarray:
    code = np.full(256, 5, np.uint64)
    code[ord("a"):ord("z") + 1], code[ord("A"):ord("Z") + 1], code[ord("0"):ord("9") + 1] = 1, 2, 3
    code[128:] = 4
    for i, c in enumerate("!#*$%&|.,;:?"):
        code[ord(c)] = 6 + i
    return code


def features(array: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows' first entries, bucket of each entry, its value, dense features) for runs of texts.

    Entries of a text have a Euclidean length of 1. ``n_chars`` is taken where it is
    not negative, else the text's length.
    """
    code = _shape_codes()
    for at, end, data, offsets in tx.byte_chunks(array, RUN):
        n = end - at
        starts, ends, rows = tx.words(data, offsets)
        hashes = tx.span_hashes(tx.prefix_sums(data), starts, ends)
        shape = code[data[starts]] * np.uint64(4099) + code[data[ends - 1]] * np.uint64(67) + code[data[np.maximum(ends - 2, starts)]]
        shape = tx.mix(shape * np.uint64(64) + np.minimum(ends - starts, 20).astype(np.uint64) // np.uint64(4) + np.uint64(1))
        keys = np.concatenate([hashes, shape]) % np.uint64(BUCKETS)
        keys, count = np.unique(np.concatenate([rows, rows]).astype(np.int64) * BUCKETS + keys.astype(np.int64), return_counts=True)
        owner, value = keys // BUCKETS, np.log1p(count)
        length = np.sqrt(np.bincount(owner, value**2, minlength=n))
        counts, shares = st.statistics(data, offsets)
        chars = n_chars[at:end]
        chars = np.where(chars >= 0, chars, tx.sums_of((data & 0xC0) != 0x80, offsets))
        dense = np.column_stack([shares, np.log1p(counts["n_words"]) / 5, np.log1p(chars) / 8])
        yield (np.searchsorted(owner, np.arange(n + 1)), (keys % BUCKETS).astype(np.int32),
               (value / np.maximum(length, 1e-9)[owner]).astype(np.float32), dense)


class FactorisationMachine:
    """Bias, weights and vectors; the last rows of both belong to the dense features."""

    def __init__(self, dense: int, seed: int = 3) -> None:
        draw = np.random.default_rng(seed)
        self.bias, self.weights = 0.0, np.zeros(BUCKETS + dense, np.float32)
        self.vectors = draw.normal(0, 0.05, (BUCKETS + dense, RANK)).astype(np.float32)
        self.centre, self.scale = np.zeros(dense), np.ones(dense)

    def entries(self, bounds, index, value, dense) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and value of all entries, dense ones included."""
        n, width = dense.shape
        rows = np.concatenate([np.repeat(np.arange(n), np.diff(bounds)), np.repeat(np.arange(n), width)])
        scaled = np.clip((dense - self.centre) / self.scale, -6, 6)
        return (rows, np.concatenate([index, np.tile(BUCKETS + np.arange(width), n)]),
                np.concatenate([value, scaled.ravel() / 3]).astype(np.float32))

    def margins(self, rows, index, value, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function, and the sums of vectors: half of (sum)^2 less the sum of squares is all pairs' products."""
        linear = np.bincount(rows, self.weights[index] * value, minlength=n)
        part = self.vectors[index] * value[:, None]
        sums = np.stack([np.bincount(rows, part[:, f], minlength=n) for f in range(RANK)], axis=1)
        squares = np.bincount(rows, (part * part).sum(axis=1), minlength=n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def fit(self, parts, target: np.ndarray) -> None:
        """AdaGrad over ``EPOCHS`` passes in small batches, the same for the same rows."""
        dense = np.concatenate([p[3] for p in parts])
        self.centre, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
        bounds, shift = [np.zeros(1, np.int64)], 0
        for p in parts:
            bounds.append(p[0][1:] + shift)
            shift += p[0][-1]
        bounds = np.concatenate(bounds)
        index, value = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        seen_w, seen_v, seen_b = np.full(len(self.weights), 1e-3), np.full(self.vectors.shape, 1e-3), 1e-3
        draw = np.random.default_rng(11)
        for _ in range(EPOCHS):
            order = draw.permutation(len(target))
            for k in range(0, len(order), BATCH):
                pick = np.sort(order[k:k + BATCH])
                own = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in pick])
                local = np.concatenate([[0], np.cumsum(bounds[pick + 1] - bounds[pick])])
                rows, feature, x = self.entries(local, index[own], value[own], dense[pick])
                margin, sums = self.margins(rows, feature, x, len(pick))
                error = (1 / (1 + np.exp(-margin)) - target[pick]) / len(pick)
                used, where = np.unique(feature, return_inverse=True)
                step_w = np.bincount(where, error[rows] * x) + DECAY * self.weights[used]
                slope = (error[rows] * x)[:, None] * (sums[rows] - self.vectors[feature] * x[:, None])
                step_v = np.stack([np.bincount(where, slope[:, f]) for f in range(RANK)], axis=1) + DECAY * self.vectors[used]
                seen_w[used] += step_w**2
                seen_v[used] += step_v**2
                seen_b += error.sum()**2
                self.weights[used] -= (RATE * step_w / np.sqrt(seen_w[used])).astype(np.float32)
                self.vectors[used] -= (RATE * step_v / np.sqrt(seen_v[used])).astype(np.float32)
                self.bias -= RATE * error.sum() / np.sqrt(seen_b)

    def scores(self, parts) -> np.ndarray:
        """Of runs of texts one after another: the entries of one run take many times the room of its texts."""
        found = [self.margins(*self.entries(*p), len(p[3]))[0] for p in parts]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(found), -50, 50))) if found else np.zeros(0)


def train(rows: list[tuple[str, int, int]]) -> FactorisationMachine:
    """The machine of the sampled (text, n_chars, label) rows; without rows every score is one half."""
    machine = FactorisationMachine(len(st.SHARES) + 2)
    machine.vectors *= bool(rows)
    if rows:
        chars = np.array([-1 if r[1] is None else r[1] for r in rows], np.int64)
        machine.fit(list(features(pa.array([r[0] for r in rows], pa.string()), chars)), np.array([r[2] for r in rows], float))
    return machine


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, threshold: float = THRESHOLD,
          keep_only: bool = False) -> DataFrame:
    """``docs`` with score and predicted, or only the rows predicted 1 with ``keep_only``.

    The machine learns from at most ``sample`` labelled rows of at most ``longest``
    characters outside the held-out fold. Null and empty texts are scored by their
    structure alone. Null ids and repeated rows are scored like others; columns named
    score or predicted are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_sample(labelled_sample(docs, labels, "quality", sample, longest), lambda rows: vars(train(rows))))

    def work():
        machine = FactorisationMachine(0)
        vars(machine).update(model.value)

        def run(array: pa.Array, n_chars: pa.Array) -> dict[str, np.ndarray]:
            found = machine.scores(features(array, n_chars.to_numpy(zero_copy_only=False)))
            good = found >= threshold
            return {"score": found, "predicted": good.astype(np.int32), "good": good}
        return run

    n_chars = F.coalesce(F.col("n_chars").cast("long"), F.lit(-1)) if "n_chars" in docs.columns else F.lit(-1).cast("long")
    return with_columns(docs, "text", FIELDS, work, "good" if keep_only else None, n_chars)
