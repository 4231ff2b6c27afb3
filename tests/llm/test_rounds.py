"""Rounds of pivots: no key's rows meet its counted keys in a join, and few pairs take one round."""

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import signatures as sg, similar
from tablewright.llm.minhash import _expand
from tablewright.llm.tables import store


def test_keys_are_closed_without_joins_and_small_ones_in_one_round(spark, monkeypatch):
    draw, plans = np.random.default_rng(2), []
    base = draw.integers(0, 2**64, 70, dtype=np.uint64)
    sets = {i: np.sort(draw.choice(base, 45, replace=False)) for i in range(40)}
    sets[29], sets[33] = np.sort(np.append(sets[28][1:], base[:1])), sets[28][:-1]
    sets = {i: np.unique(s) for i, s in sets.items()}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert near and len(near) < 5
    content = spark.createDataFrame(
        [(i, sg.signatures(s, np.zeros(1, np.int64), 128)[0].astype(np.uint16).tobytes(), s.tobytes()) for i, s in sets.items()],
        "id long, signature binary, content binary")
    # The first key holds all, the second one the odd ones.
    members = spark.createDataFrame([(i, 1) for i in sets] + [(i, 2) for i in sets if i % 2], "id long, band long")

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return store(df, label)

    for every, rounds in ((1 << 22, 2), (0, 3)):
        plans.clear()
        monkeypatch.setattr(similar, "store", seen)
        monkeypatch.setattr(similar, "EVERY", every, raising=False)
        found = {r["id"]: r["component"] for r in similar.linked(store(members, "m"), store(content, "s"), 85, 128, _expand, 16).collect()}
        root = {i: i for pair in near for i in pair}
        for _ in root:
            for a, b in near:
                root[a] = root[b] = min(root[a], root[b])
        assert found == root
        joins = [line for _, plan in plans for line in plan.splitlines() if "Join Inner" in line and "band#" in line]
        assert all("part#" in line for line in joins) and joins
        assert sum(label == "links" for label, _ in plans) == rounds
