"""The maximum-entropy model: counts against a plain version, probabilities that sum to one, held-out likelihood."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import maxent, text as tx



def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def corpus():
    draw = np.random.default_rng(8)
    follow = {w: draw.choice(40, 3, replace=False) for w in range(40)}
    rows = []
    for i in range(250):
        w, out = int(draw.integers(0, 40)), []
        for _ in range(int(draw.integers(5, 120))):
            out.append(f"Wort{w}" if w % 2 else f"word{w}")
            w = int(draw.choice(follow[w])) if draw.random() < 0.9 else int(draw.integers(0, 40))
        rows.append((i, " ".join(out) + f" once{i} {'long' * 6}{i % 9}"))
    odd = [(None, "no id"), (300, None), (301, ""), (302, " \n\t"), (303, "A a\x00b É é 日本 \U0001f600"), (304, "x" * 70_000 + " y"), (304, "again"),
           (305, "word1 " * 30_000), (306, "fifteenletters1 fifteenletters12 fifteenletters1"), (306, "again")]
    return rows + odd


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in corpus()], "doc_id long, text string, score double, row int").repartition(4)
    return [maxent.score(docs, held(), head=head).collect() for head in (1 << 18, 3)]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_counts_and_base_scores_equal_a_plain_version(scored):
    counts = Counter(w for i, t in corpus() if not is_held(i) for w in words_of(t))
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted(((i is None, i or 0), len(words_of(t)), is_held(i), sum(counts[w] > 0 for w in words_of(t)),
                       round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words_of(t)), 6)) for i, t in corpus())
    for rows in scored:
        assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"], r["held_out"], r["n_known"], round(r["base_score"], 6))
                      for r in rows) == expected
        assert {r["train_tokens"] for r in rows} == {total}


def test_held_out_texts_are_likelier_than_under_the_base(scored):
    rows = [r for r in scored[0] if r["held_out"]]
    assert len(rows) > 20 and sum(r["score"] for r in rows) > 0.8 * sum(r["base_score"] for r in rows)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in scored[0])


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in
            maxent.score(docs, F.lit(True)).orderBy("doc_id").collect()] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert maxent.score(docs.limit(0), held()).count() == 0


def test_probabilities_sum_to_one_after_any_history():
    draw, n = np.random.default_rng(5), 150
    w = maxent.Weights()
    w.classes[:] = draw.normal(0, 1, w.classes.shape)
    w.words[:] = draw.normal(0, 1, w.words.shape)
    model = maxent.MaxEnt(w, n)
    every = np.concatenate([np.arange(n), maxent.FREQUENT + np.arange(maxent.ENDINGS)])
    for history in ([], [3], [7, 2060], [1, 2, 3], [2100, 5, 149]):
        ids = np.concatenate([[*history, x] for x in every]).astype(np.int64)
        place = np.tile(np.arange(len(history) + 1), len(every))
        found = model.log_probabilities(ids, place)[len(history)::len(history) + 1]
        assert np.isclose(np.exp(found).sum(), 1, atol=1e-5)
    # The counts of an ending's tokens share its class with the unseen ones.
    known = maxent.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), 10, 4, np.full(64, 9), np.full(64, 4))
    assert ((9 + 4 + 1) / known.class_size() == 1).all()


def test_learning_follows_the_gradient():
    draw = np.random.default_rng(6)
    ids = np.tile(draw.integers(0, 60, 50), 400)
    place = np.arange(len(ids))
    w = maxent.Weights()
    model = maxent.MaxEnt(w, 60)
    seen = np.zeros(len(w.classes), np.float32), np.zeros(len(w.words), np.float32)
    before = model.log_probabilities(ids, place).mean()
    model.learn(ids, place, *seen)
    after = model.log_probabilities(ids, place).mean()
    assert before < -4 and after > -0.7
    lines = draw.normal(0, 1, (500, 4)).astype(np.float32)
    starts = np.unique(np.append(0, draw.integers(0, 500, 60)))
    order = draw.permutation(500)
    assert np.allclose(maxent.MaxEnt._sums(lines, order, starts, np.append(starts[1:], 500)), np.add.reduceat(lines[order], starts, axis=0), atol=1e-4)


def test_names_are_the_bytes_or_a_digest():
    texts = ["a", "ab", "ba", "a\x00", "fifteenletters1", "fifteenletters12", "x" * 5000, "x" * 5001, "é", "日本語日本語"]
    _, _, data, offsets = next(tx.byte_chunks(pa.array(texts)))
    hi, lo = tx.span_names(data, offsets[:-1], offsets[1:])
    assert len(set(zip(hi.tolist(), lo.tolist()))) == len(texts)
    again = tx.span_names(data[offsets[3]:], offsets[3:-1] - offsets[3], offsets[4:] - offsets[3])
    assert (again[0] == hi[3:]).all() and (again[1] == lo[3:]).all()
    # Words that defeat polynomial hashes modulo a power of two.
    word = "a"
    for _ in range(12):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    _, _, data, offsets = next(tx.byte_chunks(pa.array([word, other])))
    hi, lo = tx.span_names(data, offsets[:-1], offsets[1:])
    assert hi[0] != hi[1] or lo[0] != lo[1]
