"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to four bytes with escape
probabilities. With its counts frozen, a text's code length under a language is a
sum over its bytes, and the language with the shortest code is the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablewright.llm import text as tx
from tablewright.llm.tables import held_out, with_columns

ORDER = 4
#: Bounds of the sample: documents of a language, and characters of a text.
PER_LANGUAGE, LONGEST = 250, 10_000
UNKNOWN = "und"
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


class KeyTable:
    """Finds the row of a key with a few look-ups in a sparse table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(int(len(keys) * 4).bit_length(), 8))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.rows = np.full(self.mask + 1, -1, np.int32)
        left = np.arange(len(keys))
        place = self._place(keys)
        while len(left):
            free = left[self.rows[place[left]] < 0]
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.keys[place[put]], self.rows[place[put]] = keys[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            place[left] = (place[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        place = self._place(keys)
        rows = self.rows[place]
        rows[self.keys[place] != keys] = -2
        open_ = np.flatnonzero(rows == -2)
        open_ = open_[self.rows[place[open_]] >= 0]
        while len(open_):
            place[open_] = (place[open_] + 1) & self.mask
            found = self.rows[place[open_]]
            same = self.keys[place[open_]] == keys[open_]
            rows[open_[same]] = found[same]
            open_ = open_[~same & (found >= 0)]
        return np.where(rows < 0, -1, rows)


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """For each byte, it and the ``length - 1`` bytes before it as one number; the first ones lack bytes and are not to be used."""
    key = data.astype(np.int64)
    for k in range(1, length):
        key[k:] |= data[:-k].astype(np.int64) << (8 * k)
    return key


class PartialMatching:
    """Code lengths in bits, by context length: of the last byte of each known gram, and of leaving its context."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER) -> None:
        self.names, self.order = sorted(texts), order
        n = len(self.names)
        self.tables, self.cost, self.leave = [], [], []
        joined = [[tx.LOWER[np.frombuffer(t.encode(), np.uint8)] for t in texts[name] if t] for name in self.names]
        for k in range(order + 1):
            each = [np.concatenate([grams(d, k + 1)[k:] for d in docs if len(d) > k] or [np.zeros(0, np.int64)]) for docs in joined]
            keys = np.arange(256) if k == 0 else np.unique(np.concatenate(each or [np.zeros(0, np.int64)]))
            count = np.zeros((len(keys), n))
            for j, found in enumerate(each):
                seen, times = np.unique(found, return_counts=True)
                count[np.searchsorted(keys, seen), j] = times
            # The context is the gram without its last byte: a row of the table before.
            context = np.zeros(len(keys), np.int64) if k == 0 else self.tables[-1].find(keys >> 8)
            m = 1 if k == 0 else len(self.cost[-1])
            total, kinds = np.zeros((m, n)), np.zeros((m, n))
            np.add.at(total, context, count)
            np.add.at(kinds, context, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                own = np.log2((total + kinds)[context] / count)
            shorter = np.full((len(keys), n), 8.0) if k == 0 else self.cost[-1][self.tables[-1].find(keys & ((1 << (8 * k)) - 1))]
            self.tables.append(KeyTable(keys))
            self.leave.append(leave.astype(np.float32))
            self.cost.append(np.where(count > 0, own, leave[context] + shorter).astype(np.float32))

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        data = tx.LOWER[data]
        past = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        whole = grams(data, self.order + 1)
        found = np.zeros((len(data), len(self.names)), np.float32)
        left = np.arange(len(data))
        for k in range(self.order, -1, -1):
            key = whole[left] & ((1 << (8 * (k + 1))) - 1)
            row = self.tables[k].find(key)
            row[past[left] < k] = -1
            hit = row >= 0
            found[left[hit]] += self.cost[k][row[hit]]
            left, key = left[~hit], key[~hit]
            if k:
                # Where the context itself is known, leaving it costs its escape.
                context = self.tables[k - 1].find(key >> 8)
                known = (context >= 0) & (past[left] >= k)
                found[left[known]] += self.leave[k][context[known]]
        sums = np.zeros((len(data) + 1, len(self.names)))
        np.cumsum(found, axis=0, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def sample_texts(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> dict[str, list[str]]:
    """Texts by language of at most ``per_language`` rows each outside the held-out fold, chosen by a hash of their id."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text").between(1, longest)) & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("language"), "doc_id"), "doc_id", "text")
    chosen = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).select("lang", "text")
    texts: dict[str, list[str]] = {}
    for r in sorted(map(tuple, chosen.collect())):
        texts.setdefault(r[0], []).append(r[1])
    return texts


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> DataFrame:
    """``docs`` with lang_pred and score.

    The score is the probability of the language, each being as likely beforehand. A
    null text, one without a letter, and every text when no language could be learned
    are "und" with score 0. Ties go to the first language by name. Null ids and
    repeated rows are judged like others; columns named like an added one are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(PartialMatching(sample_texts(docs, per_language, longest)))

    def work():
        matching = model.value
        names = np.array([*matching.names, UNKNOWN], object)

        def run(array: pa.Array) -> dict[str, object]:
            best, sure = np.full(len(array), len(names) - 1), np.zeros(len(array))
            if len(names) > 1:
                for at, end, data, offsets in tx.byte_chunks(array, 1 << 18):
                    bits = matching.bits(data, offsets)
                    best[at:end] = bits.argmin(axis=1)
                    sure[at:end] = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
                    # Almost every text has an ASCII letter; the others are looked at one by one.
                    plain = tx.sums_of(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128), offsets)
                    for i in np.flatnonzero(plain == 0):
                        if not any(c.isalpha() for c in array[at + int(i)].as_py() or ""):
                            best[at + i], sure[at + i] = len(names) - 1, 0.0
            return {"lang_pred": pa.array(names[best], pa.string()), "score": sure}
        return run

    return with_columns(docs, "text", FIELDS, work)
