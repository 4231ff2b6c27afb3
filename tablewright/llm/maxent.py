"""Language-model scoring by a hashed maximum-entropy model.

The next token's class is one softmax over features of the tokens before it (n-grams
and skips, hashed into rows of weights); a frequent token is then one of its class by a
second softmax, and any other token of its class follows its smoothed corpus count.
Weights are trained by distributed gradient updates: in each round every task takes
AdaGrad steps over its documents from the same weights, and rows of weights are
averaged by how often each task has met them.

Corpus counts are of all training tokens, told apart by their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm import text as tx
from tablewright.llm.language import KeyTable
from tablewright.llm.tables import frugal, store

#: Words with features of their own in classes of SLOTS, and classes of all other words, by their last letters.
FREQUENT, SLOTS, ENDINGS = 2048, 64, 64
GROUPS = FREQUENT // SLOTS
CLASSES = GROUPS + ENDINGS
#: Rows of weights that the features of the class and of the word are hashed into.
CLASS_ROWS, WORD_ROWS = 1 << 15, 1 << 15
#: Words whose counts every task gets; the counts of all others are joined.
HEAD = 1 << 18
ROUNDS, BATCH, RATE = 3, 4096, 0.25
#: Largest size of a weight: the sum of five stays where exponentials are finite.
LIMIT = 15.0
#: Rows of weights that travel together.
BLOCK = 512
#: Bytes of text that are worked on at once; a longer text alone.
CHUNK = 1 << 19

#: Name of the token that ends a text: no word has this length byte.
END_HI, END_LO = 0x7F << 56, 0
#: Numbers of histories: frequent words, endings, and the place before the first token.
START = FREQUENT + ENDINGS
_WIDTH = START + 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Ending of a word by its last two bytes; a word of one byte counts it twice.
_ENDING_OF = (tx.mix((np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * _ODD) % np.uint64(ENDINGS)).astype(np.int64)


@dataclass
class Tokens:
    """The tokens of some texts one after another, each text closed by its end token."""

    hi: np.ndarray
    lo: np.ndarray
    ending: np.ndarray
    place: np.ndarray
    bounds: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return tx.mix(self.hi * _ODD + tx.mix(self.lo)).view(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    data = tx.LOWER[data]
    starts, ends, rows = tx.words(data, offsets)
    n = len(offsets) - 1
    per_text = np.bincount(rows, minlength=n) + 1
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    at = np.arange(len(starts)) + rows
    total = int(bounds[-1])
    hi, lo = np.full(total, END_HI, np.uint64), np.full(total, END_LO, np.uint64)
    hi[at], lo[at] = tx.span_names(data, starts, ends)
    ending = np.zeros(total, np.int64)
    if len(starts):
        ending[at] = _ENDING_OF[(data[ends - 1].astype(np.int64) << 8) | data[np.maximum(ends - 2, starts)]]
    return Tokens(hi, lo, ending, np.arange(total) - np.repeat(bounds[:-1], per_text), bounds)


class Names:
    """Finds the position of a name in a list of names."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.hi, self.lo = hi, lo
        keys = tx.mix(hi * _ODD + tx.mix(lo)).view(np.int64)
        # Of names with one key, which hardly ever are, all but the first are not found here and so counted as joined ones.
        _, first = np.unique(keys, return_index=True)
        self.known = np.sort(first)
        self.table = KeyTable(keys[self.known]) if len(self.known) else None

    def find(self, t: Tokens) -> np.ndarray:
        """Position of each token, -1 where there is none."""
        if self.table is None:
            return np.full(len(t.hi), -1)
        row = self.table.find(t.keys)
        at = np.where(row < 0, -1, self.known[row])
        return np.where((at >= 0) & (self.hi[at] == t.hi) & (self.lo[at] == t.lo), at, -1)


@dataclass
class Weights:
    """Rows of weights for classes and words; the last rows are biases. ``met``: sums of squared slopes of each row."""

    classes: np.ndarray = field(default_factory=lambda: np.zeros((CLASS_ROWS + 1, CLASSES), np.float32))
    words: np.ndarray = field(default_factory=lambda: np.zeros((WORD_ROWS + GROUPS, SLOTS), np.float32))
    class_met: np.ndarray = field(default_factory=lambda: np.zeros(CLASS_ROWS + 1, np.float32))
    word_met: np.ndarray = field(default_factory=lambda: np.zeros(WORD_ROWS + GROUPS, np.float32))


def _hashed(kind: int, rows: int, *parts: np.ndarray) -> np.ndarray:
    key = np.full(len(parts[0]), kind, np.uint64)
    for p in parts:
        key = key * np.uint64(_WIDTH) + p.astype(np.uint64)
    return (tx.mix(key * _ODD) % np.uint64(rows)).astype(np.int64)


def histories(ids: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The tokens one, two and three places before each token."""
    out = []
    for k in (1, 2, 3):
        before = np.full(len(ids), START)
        before[k:] = ids[:-k]
        before[place < k] = START
        out.append(before)
    return out


class MaxEnt:
    """The two softmax models over rows of weights."""

    def __init__(self, weights: Weights, n_frequent: int) -> None:
        self.w = weights
        # Slots and classes without a word have no probability.
        free = np.arange(FREQUENT).reshape(GROUPS, SLOTS) >= n_frequent
        self.no_word = np.where(free, np.float32(-1e9), np.float32(0))
        self.no_class = np.zeros(CLASSES, np.float32)
        self.no_class[:GROUPS][free.all(axis=1)] = -1e9
        one = np.arange(_WIDTH)
        # Features of one token are looked up instead of hashed again.
        self.single = {kind: _hashed(kind, CLASS_ROWS, one) for kind in (1, 3, 4)}

    def class_rows(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
        """Rows of the bigram, trigram and two skip features of each token."""
        return np.stack([self.single[1][w1], _hashed(2, CLASS_ROWS, w1, w2), self.single[3][w2],
                         self.single[4][w3]])

    @staticmethod
    def word_rows(group: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return np.stack([_hashed(5, WORD_ROWS, group, w1), _hashed(6, WORD_ROWS, group, w1, w2), _hashed(7, WORD_ROWS, group, w2)])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        # Weights are held within LIMIT, so that no exponential overflows.
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def class_scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.take(self.w.classes, rows[0], axis=0)
        for r in rows[1:]:
            z += np.take(self.w.classes, r, axis=0)
        z += self.w.classes[CLASS_ROWS] + self.no_class
        return z

    def word_scores(self, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
        z = np.take(self.w.words[WORD_ROWS:] + self.no_word, group, axis=0)
        for r in rows:
            z += np.take(self.w.words, r, axis=0)
        return z

    def log_probabilities(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's probability: of its class, and of the word in it where it is frequent."""
        out = np.empty(len(ids))
        before = histories(ids, place)
        for at in range(0, len(ids), BATCH):
            own = ids[at:at + BATCH]
            w1, w2, w3 = (b[at:at + BATCH] for b in before)
            often = own < FREQUENT
            target = np.where(often, own // SLOTS, own - FREQUENT + GROUPS)
            z = self.class_scores(self.class_rows(w1, w2, w3))
            found = z[np.arange(len(own)), target].astype(np.float64)
            found -= np.log(np.exp(z, out=z).sum(axis=1))
            pick = np.flatnonzero(often)
            if len(pick):
                group, slot = own[pick] // SLOTS, own[pick] % SLOTS
                z = self.word_scores(self.word_rows(group, w1[pick], w2[pick]), group)
                found[pick] += z[np.arange(len(pick)), slot]
                found[pick] -= np.log(np.exp(z, out=z).sum(axis=1))
            out[at:at + BATCH] = found
        return out

    @staticmethod
    def _sums(lines: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of the lines that runs of ``order`` name: short runs line by line, all at once, and each long run by itself."""
        total, length = np.take(lines, order[starts], axis=0), ends - starts
        for i in np.flatnonzero(length > 12).tolist():
            total[i] = np.take(lines, order[starts[i]:ends[i]], axis=0).sum(axis=0)
        left, k = np.flatnonzero((length > 1) & (length <= 12)), 1
        while len(left):
            total[left] += np.take(lines, order[starts[left] + k], axis=0)
            k += 1
            left = left[length[left] > k]
        return total

    @staticmethod
    def _step(weights: np.ndarray, met: np.ndarray, seen: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> None:
        """One AdaGrad step for each row of weights that the batch met; ``rows`` has a line for each feature."""
        flat = rows.ravel().astype(np.uint16 if len(weights) <= 1 << 16 else np.int64)
        order = np.argsort(flat, kind="stable")
        found = flat[order].astype(np.int64)
        starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        ends = np.append(starts[1:], len(found))
        used = found[starts]
        total = MaxEnt._sums(slope, order % len(slope), starts, ends)
        met[used] += np.einsum("ij,ij->i", total, total) / total.shape[1]
        seen[used] += (ends - starts).astype(np.float32)
        total *= (RATE / np.sqrt(met[used] + 1e-6))[:, None]
        total += np.take(weights, used, axis=0)
        weights[used] = np.clip(total, -LIMIT, LIMIT, out=total)

    def learn(self, ids: np.ndarray, place: np.ndarray, class_seen: np.ndarray, word_seen: np.ndarray) -> None:
        """Gradient steps over the tokens in batches; ``*_seen`` count how often each row was met."""
        before = histories(ids, place)
        for at in range(0, len(ids), BATCH):
            own = ids[at:at + BATCH]
            w1, w2, w3 = (b[at:at + BATCH] for b in before)
            often = own < FREQUENT
            target = np.where(often, own // SLOTS, own - FREQUENT + GROUPS)
            rows = self.class_rows(w1, w2, w3)
            slope = self._softmax(self.class_scores(rows))
            np.negative(slope, out=slope)
            slope[np.arange(len(own)), target] += 1
            self._step(self.w.classes, self.w.class_met, class_seen, rows, slope)
            self._step(self.w.classes, self.w.class_met, class_seen, np.array([[CLASS_ROWS]]), slope.sum(axis=0, keepdims=True))
            pick = np.flatnonzero(often)
            if len(pick):
                group, slot = own[pick] // SLOTS, own[pick] % SLOTS
                rows = self.word_rows(group, w1[pick], w2[pick])
                slope = self._softmax(self.word_scores(rows, group))
                np.negative(slope, out=slope)
                slope[np.arange(len(pick)), slot] += 1
                self._step(self.w.words, self.w.word_met, word_seen, np.concatenate([rows, WORD_ROWS + group[None, :]]), slope)


COUNTS = "hi long, lo long, ending int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in tx.byte_chunks(batch.column(0), 4 * CHUNK):
            t = tokens(data, offsets)
            order = np.argsort(t.keys)
            hi, lo = t.hi[order], t.lo[order]
            # Names that share a key may be counted in several rows, which are summed like those of other tasks.
            starts = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi[starts].view(np.int64)), pa.array(lo[starts].view(np.int64)), pa.array(t.ending[order[starts]].astype(np.int32)),
                 pa.array(np.diff(np.append(starts, len(hi))))], names=["hi", "lo", "ending", "n"])


def token_counts(docs: DataFrame) -> DataFrame:
    """(hi, lo, ending, n) of every distinct token of the texts, in a stored table; the end token is one of them."""
    found = docs.select("_text").mapInArrow(frugal(_count), COUNTS)
    return store(found.groupBy("hi", "lo").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "counts")


@dataclass
class Vocabulary:
    """The head of the counts, most frequent first (the end token before all), and totals."""

    hi: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    tokens: int
    distinct: int
    #: Tokens and distinct tokens of each ending that are not frequent.
    ending_tokens: np.ndarray
    ending_distinct: np.ndarray

    @property
    def n_frequent(self) -> int:
        return min(len(self.hi), FREQUENT)

    def class_size(self) -> np.ndarray:
        """What the counts of an ending's tokens, each plus one, and one for all unseen tokens of the ending sum to."""
        return self.ending_tokens + self.ending_distinct + 1.0


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the counts that are not in its head.

    The head holds the words above a count: as many sixteenths of a power of two as
    fit into ``head`` words, so that no task sorts the vocabulary.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    is_end = (F.col("hi") == END_HI) & (F.col("lo") == END_LO)
    # A few hundred levels and ENDINGS endings, whatever the corpus.
    levels_ = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for at, words_ in levels_:
        if total + words_ > head:
            break
        least, total = at, total + words_
    sums = counts.groupBy("ending").agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    inside = (level >= least) | is_end
    top = counts.where(inside).toArrow()
    hi, lo, ending, n = (top.column(c).to_numpy() for c in ("hi", "lo", "ending", "n"))
    hi, lo = hi.astype(np.int64).view(np.uint64), lo.astype(np.int64).view(np.uint64)
    order = np.lexsort((lo, hi, -n, ~((hi == END_HI) & (lo == END_LO))))
    hi, lo, ending, n = hi[order], lo[order], ending[order], n[order]
    words_, tokens_ = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in sums:
        words_[r["ending"]], tokens_[r["ending"]] = r["words"], r["tokens"]
    known = Vocabulary(hi, lo, n, int(tokens_.sum()), int(words_.sum()),
                       tokens_ - np.bincount(ending[:FREQUENT], n[:FREQUENT], ENDINGS).astype(np.int64),
                       words_ - np.bincount(ending[:FREQUENT], minlength=ENDINGS))
    return known, counts.where(~inside)


def _ids(names: Names, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Position of each token in the head (-1: not there) and its number in histories."""
    at = names.find(t)
    return at, np.where((at >= 0) & (at < FREQUENT), at, FREQUENT + t.ending)


_UPDATE = "part int, block int, seen binary, met binary, change binary"


def _blocks(part: int, old: np.ndarray, new: np.ndarray, old_met: np.ndarray, new_met: np.ndarray, seen: np.ndarray) -> Iterator[tuple]:
    for at in range(0, len(seen), BLOCK):
        s = slice(at, at + BLOCK)
        if seen[s].any():
            yield (part, at // BLOCK, seen[s].tobytes(), (new_met[s] - old_met[s]).tobytes(), (new[s] - old[s]).astype(np.float16).tobytes())


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    """Mean change of each row of weights in a block, weighed by how often each task met it, and mean growth of its squared slopes."""
    seen = met = change = 0.0
    for i in range(rows.num_rows):
        r = rows.slice(i, 1).to_pylist()[0]
        own = np.frombuffer(r["seen"], np.float32).astype(np.float64)
        seen = seen + own
        met = met + own * np.frombuffer(r["met"], np.float32)
        change = change + own[:, None] * np.frombuffer(r["change"], np.float16).reshape(len(own), -1)
    scale = 1 / np.maximum(seen, 1)
    out = [[key[0].as_py()], [key[1].as_py()], [seen.astype(np.float32).tobytes()], [(met * scale).astype(np.float32).tobytes()],
           [(change * scale[:, None]).astype(np.float32).tobytes()]]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), *[pa.binary()] * 3))],
                                names=["part", "block", "seen", "met", "change"])


def train(docs: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights after one pass over all texts of ``docs``, in ``rounds`` rounds of documents by the hash of their id.

    A round's tasks start from the same weights. What they send back is bounded by the
    size of the weights, whatever the size of their texts.
    """
    spark = docs.sparkSession
    weights = Weights()
    cores = spark.sparkContext.defaultParallelism
    split = docs.select("_text", F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)).alias("_round"))
    # A quarter as many updates, each of four times the texts, as far as all cores have work.
    tasks = docs.rdd.getNumPartitions()
    split = split.coalesce(max(tasks // 4, min(tasks, 2 * cores), 1))
    names = spark.sparkContext.broadcast((known.hi[:FREQUENT], known.lo[:FREQUENT]))
    for number in range(rounds):
        start = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            w = start.value
            own = Weights(w.classes.copy(), w.words.copy(), w.class_met.copy(), w.word_met.copy())
            found, model = Names(*names.value), MaxEnt(own, len(names.value[0]))
            class_seen, word_seen = np.zeros(len(own.classes), np.float32), np.zeros(len(own.words), np.float32)
            for batch in batches:
                for _, _, data, offsets in tx.byte_chunks(batch.column(0), CHUNK):
                    t = tokens(data, offsets)
                    model.learn(_ids(found, t)[1], t.place, class_seen, word_seen)
            for part in (_blocks(0, w.classes, own.classes, w.class_met, own.class_met, class_seen),
                         _blocks(1, w.words, own.words, w.word_met, own.word_met, word_seen)):
                for row in part:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 3))],
                                                     names=["part", "block", "seen", "met", "change"])

        updates = split.where(F.col("_round") == number).select("_text").mapInArrow(frugal(learn), _UPDATE)
        merged = updates.groupBy("part", "block").applyInArrow(_merge, _UPDATE).toArrow()
        weights = Weights(weights.classes.copy(), weights.words.copy(), weights.class_met.copy(), weights.word_met.copy())
        for r in merged.to_pylist():
            table, met = ((weights.classes, weights.class_met), (weights.words, weights.word_met))[r["part"]]
            s = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            table[s] += np.frombuffer(r["change"], np.float32).reshape(-1, table.shape[1])
            met[s] += np.frombuffer(r["met"], np.float32)
        start.destroy()
    names.destroy()
    return weights


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, head_base double, model double, tail array<struct<hi:long,lo:long,n:int>>"


def score(docs: DataFrame, held_out: Column, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text, ...).

    Tokens are the words of the text, A-Z in lower case, and one end. The model
    learns from the rows where ``held_out`` is not true. base_score is the sum over tokens of
    log10((c + 1) / (N + V + 1)); score the logarithm of the text's probability under the maximum-entropy model,
    which gives all tokens, the unseen ones of an ending together, a total of one after any history.

    * null, empty and blank texts: one token, the end
    * very long texts: scored whole, a batch of tokens at a time
    * null ids and repeated rows are rows like others, learned from and scored each by itself
    * no training rows: N and V are 0, both scores 0; an empty table gives no rows
    * other columns of ``docs`` are not read
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.where("not held_out")
    counts = token_counts(training)
    known, rest = vocabulary(counts, head)
    model = spark.sparkContext.broadcast((known, train(training, known, rounds) if known.tokens else Weights()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = model.value
        names, maxent = Names(known.hi, known.lo), MaxEnt(weights, known.n_frequent)
        size = np.log10(known.class_size())
        logs = np.log10(known.n + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, end, data, offsets in tx.byte_chunks(batch.column(1), CHUNK):
                t = tokens(data, offsets)
                place, ids = _ids(names, t)
                inside = place >= 0
                often = inside & (place < FREQUENT)
                own = np.zeros(len(ids))
                own[inside] = logs[place[inside]]
                chance = maxent.log_probabilities(ids, t.place) / math.log(10)
                chance += np.where(often, 0.0, own - size[np.where(often, 0, ids - FREQUENT)])
                add = lambda x: np.add.reduceat(x, t.bounds[:-1])
                rows = np.repeat(np.arange(end - at), np.diff(t.bounds))
                out = np.flatnonzero(~inside)
                # Each text's other tokens once, with their number.
                out = out[np.lexsort((t.lo[out], t.hi[out], rows[out]))]
                hi, lo, owner = t.hi[out], t.lo[out], rows[out]
                first = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (owner[1:] != owner[:-1]))) if len(out) else out
                items = pa.StructArray.from_arrays(
                    [pa.array(hi[first].view(np.int64)), pa.array(lo[first].view(np.int64)),
                     pa.array(np.diff(np.append(first, len(out))).astype(np.int32))], names=["hi", "lo", "n"])
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[first], np.arange(end - at + 1)).astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + end - at)), batch.column(0).slice(at, end - at), batch.column(2).slice(at, end - at),
                     pa.array(np.diff(t.bounds)), pa.array(add(inside.astype(np.int64))), pa.array(add(own)), pa.array(add(chance)), tail],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_head", "head_base", "model", "tail"])
                row += end - at

    scored = store(docs.select("doc_id", "_text", "held_out").mapInArrow(frugal(measure), _SCORED), "scored")
    tail = scored.select("row", F.inline("tail")).toDF("row", "hi", "lo", "times")
    met = tail.join(rest.select("hi", "lo", "n"), ["hi", "lo"])
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_log"), F.sum("times").alias("_known"))
    total = math.log10(known.tokens + known.distinct + 1)
    base = F.col("head_base") + F.coalesce("_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)
    found = F.col("model") + F.coalesce("_log", F.lit(0.0)) if known.tokens else base
    return scored.drop("tail").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), found.alias("score"))
