"""Workers give back what other work has left in them, and large batches are worked on some rows at a time."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tablewright.llm import caches, packing, quality, tables
from tablewright.llm.queries import tokenizer_path


def private_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\n(?:Private_Dirty):\s+(\d+)", f.read()))) / 1024


def small_blocks(_):
    # Blocks too small to be mapped one by one; the last keeps the heap from shrinking by itself.
    blocks = [np.ones(12_000) for _ in range(1500)]
    last, full = np.ones(12_000), private_mb()
    del blocks
    return last, full


def test_unused_memory_goes_back():
    caches.kept("blocks", lambda: np.ones(1))
    last, full = small_blocks(None)
    work = tables.frugal(lambda batches: iter(()))
    list(work(iter(())))
    assert full - private_mb() > 100 and last[0] == 1
    assert not hasattr(caches.sys.modules.get("_tablewright_kept"), "blocks")


def test_placing_pieces_lets_go_of_the_tokenizer(spark, monkeypatch):
    wrapped = []
    monkeypatch.setattr(packing, "frugal", lambda work: wrapped.append(work.__name__) or tables.frugal(work))
    docs = spark.createDataFrame([(i, f"word{i} other") for i in range(40)], "doc_id long, text string")
    assert packing.pack(docs.repartition(4), tokenizer_path("word_bpe_49k.json")).count() == 40
    assert wrapped == ["place"]


@pytest.mark.parametrize("keep", [None, "even"])
def test_batches_are_cut(spark, keep):
    def work():
        def run(array):
            assert len(array) <= 1024
            value = np.array([int(x) for x in array.to_pylist()])
            return {"twice": 2 * value, "even": value % 2 == 0}
        return run

    df = spark.range(0, 5000, 1, 1).selectExpr("cast(id as string) as text")
    found = tables.with_columns(df, "text", [T.StructField("twice", T.LongType())], work, keep).collect()
    assert sorted(int(r["text"]) for r in found) == (list(range(0, 5000, 2)) if keep else list(range(5000)))
    assert keep or all(r["twice"] == 2 * int(r["text"]) for r in found)


def test_scores_take_one_run_of_texts_at_a_time():
    array = pa.array(["some words of a text " * 20_000] * 4)
    parts = quality.features(array, np.full(4, -1))
    first = next(parts)
    assert len(first[3]) == 1
    machine = quality.FactorisationMachine(first[3].shape[1])
    assert len(machine.scores(parts)) == 3
    assert len(machine.scores(quality.features(array, np.full(4, -1)))) == 4
