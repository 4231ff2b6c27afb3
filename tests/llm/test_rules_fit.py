"""The forest and its threshold come from all labelled rows, whole texts included."""

import zlib

import numpy as np
import pyarrow as pa

from tablewright.llm import rules, statistics as st


def _rows(n, long_text):
    draw, rows = np.random.default_rng(4), []
    words = [f"{a}{b}" for a in "abcdefghklmnop" for b in ("ender", "ily", "orous", "atch")]
    for i in range(n):
        text = ". ".join(" ".join(draw.choice(words, 9)) for _ in range(6)) + "."
        if i % 5 == 0:
            text = " ".join(w + "%%%" for w in draw.choice(words, 4000 if long_text else 60))
        rows.append((i, text, int(i % 5 != 0)))
    return rows


def test_long_labelled_texts_are_learnt_from(spark):
    rows = _rows(160, True)
    assert all(len(t) > 20_000 for _, t, good in rows if not good)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in rules.judge(docs, labels).collect()}
    plain = [i for i, _, _ in rows if not found[i]["base_failed"]]
    assert {rows[i][2] for i in plain} == {0, 1}
    assert all(found[i]["kept"] == bool(rows[i][2]) for i in plain)


def test_every_labelled_row_counts_and_trees_hold_all(spark):
    rows = _rows(120, False)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "x"), (7, None), rows[3][:2]], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (999, 0)], "doc_id long, quality int")
    points = rules.labelled_points(docs, labels).cache()
    counts, shares = st.of_texts(pa.array([r[1] for r in rows]))
    used = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2 and not rules.base_rules(counts)[i]]
    assert points.groupBy().sum("n", "good").first()[:] == (len(used), sum(rows[i][2] for i in used))
    forest = rules.grown(points, trees=5, most=4)
    seen = rules.excesses(shares)[used]
    for tree in range(5):
        # Each leaf's path length follows from its depth and the rows that come to it.
        at, depth = forest.nodes(tree, seen), {tree: 0}
        for node in range(len(forest.feature)):
            if node in depth and forest.feature[node] >= 0:
                depth[int(forest.left[node])] = depth[int(forest.left[node]) + 1] = depth[node] + 1
        for node, n in zip(*np.unique(at, return_counts=True)):
            assert forest.path[node] == depth[node] + rules.expected_depth(n)
            assert forest.feature[node] == rules.LEAF and depth[node] <= 4
    points.unpersist()
