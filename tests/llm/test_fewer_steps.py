"""Shared keys from one sorted scan, few edges joined by one task, all pairs at once after the pivots."""

import numpy as np
import pyarrow as pa

from tablewright.llm import signatures as sg, similar
from tablewright.llm.minhash import _expand
from tablewright.llm.tables import store


def test_shared_keys_across_batches():
    draw = np.random.default_rng(1)
    for _ in range(500):
        n = int(draw.integers(0, 40))
        bands, ids = np.sort(draw.integers(0, n // draw.integers(1, 6) + 1, n)), draw.integers(0, draw.integers(1, 5), n)
        cuts = [0, *sorted(draw.integers(0, n + 1, 4).tolist()), n]
        parts = (pa.RecordBatch.from_arrays([pa.array(ids[a:z]), pa.array(bands[a:z])], names=["id", "band"]) for a, z in zip(cuts, cuts[1:]))
        found = {pair for part in similar._shared(parts) for pair in zip(*(c.to_pylist() for c in part.columns))}
        assert found == {(int(i), int(b)) for i, b in zip(ids, bands) if len(set(ids[bands == b].tolist())) > 1}


def test_shared_bands_buffer_no_key(spark, monkeypatch):
    plans = []

    def seen(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(similar, "store", seen)
    rows = [(i, i % 50) for i in range(80)] + [(7, 1000), (7, 1000), (8, 1001)]
    found = {tuple(r) for r in similar.shared_bands(spark.createDataFrame(rows, "id long, band long").repartition(5)).collect()}
    assert found == {(i, i % 50) for i in range(80) if i % 50 < 30}
    assert not any("Window" in plan for plan in plans)


def test_few_edges_take_one_step(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(similar, "store", lambda df, label: labels.append(label) or store(df, label))
    found = similar.union_find(spark.createDataFrame([(3, 1), (3, 5), (1, 3), (9, 8), (4, 4), (3, 1)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (3, 1), (5, 1), (8, 8), (9, 8)]
    assert labels == ["edges", "forest"]


def test_all_pairs_follow_the_first_pivots(spark, monkeypatch):
    draw, labels = np.random.default_rng(2), []
    base = draw.integers(0, 2**64, 70, dtype=np.uint64)
    sets = {i: np.sort(draw.choice(base, 45, replace=False)) for i in range(150)}
    sets[140] = sets[131][:-1]
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert near == {(131, 140)}
    content = spark.createDataFrame(
        [(i, sg.signatures(s, np.zeros(1, np.int64), 128)[0].astype(np.uint16).tobytes(), s.tobytes()) for i, s in sets.items()],
        "id long, signature binary, content binary")
    members = spark.createDataFrame([(i, 1) for i in sets], "id long, band long")
    monkeypatch.setattr(similar, "EVERY", 0)
    sets_, members = store(content, "s"), store(members, "m")
    monkeypatch.setattr(similar, "store", lambda df, label: labels.append(label) or store(df, label))
    found = similar.linked(members, sets_, 85, 128, _expand, 16, similar.union_find)
    assert sorted(map(tuple, found.collect())) == [(131, 131), (140, 131)]
    assert labels.count("links") == 3
