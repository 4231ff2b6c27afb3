"""No row or line is lost: ids with several texts, words that defeat weak hashes, clashing columns, long texts, components."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import lines, minhash, similar
from tablewright.llm.tables import bit_map, discard, has_bit, store, unused


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_one_id_with_several_texts_keeps_its_lines(spark):
    rows = [(5, "unique first line of the text\nshared line that stands in several texts"),
            (5, "line of doc 1 that also stands there\nshared line that stands in several texts"),
            (1, "line of doc 1 that also stands there\nanother line of one"), (5, "line of doc 1 that also stands there\nshared line that stands in several texts")]
    found = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {(r["doc_id"], r["text"]): r["_clean"] for r in found}
    assert len(found) == 4 and texts[1, rows[2][1]] == rows[2][1]
    # Every line stands once in what is left.
    left = [x for t in texts.values() for x in t.split("\n") if x]
    assert sorted(left) == sorted({x for _, t in rows for x in t.split("\n")})


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_and_lines_that_defeat_weak_hashes(spark, n):
    one, other = thue_morse(n)
    docs = spark.createDataFrame([(1, one), (2, other), (3, one), (4, f"x\n{one} y"), (5, f"x z\n{other} y")], "doc_id long, text string")
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert found == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True), 5: (5, True)}
    # As lines both are the same few shingles but for their ends; equal lines go, and so do those with like sets.
    sets = {}
    for r in docs.collect():
        for k, x in enumerate(r["text"].split("\n")):
            sets[r["doc_id"], k] = {x[i:i + 8] for i in range(max(len(x) - 7, 1))}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    # Versions, not ids, order documents of one id only, so the first place is the smallest (doc_id, line).
    gone = {(r["doc_id"], k) for r in lines.repeated_lines(docs).collect() for k in r["gone"]}
    assert gone == {k for k in sets if root[k] != k}


def test_columns_of_any_name_stay(spark):
    names = ["gone", "_clean", "_text_", "_gone_id", "_dropped", "version", "_row", "line", "a.b", "_key", "_version", "digest"]
    line = "the same line stands in both documents here"
    rows = [(1, line + "\nfirst", *names), (2, line + "\nsecond", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    clean, dropped = unused(docs, "_clean", "_dropped")
    found = lines.drop_repeated_lines(docs, clean=clean, dropped=dropped).orderBy("doc_id").collect()
    assert [r[clean] for r in found] == [line + "\nfirst", "second"] and all(tuple(r)[2:2 + len(names)] == tuple(names) for r in found)
    assert minhash.drop_near_duplicates(docs).columns == docs.columns
    found = lines.drop_repeated_lines(docs).collect()
    assert sorted(r["_dropped"] for r in found) == [0, 1]


def test_only_linked_rows_are_dropped(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two"))
    rows = [(7, one), (7, two), (7, one), (3, two.replace("two9 ", "other ")), (9, ""), (9, None), (None, one), (None, one), (8, "  ")]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept)) == sorted(
        [(False, 7, one), (False, 3, rows[3][1]), (False, 9, ""), (False, 9, ""), (False, 8, "  "), (True, 0, one), (True, 0, one)])


def test_a_text_of_some_megabytes(spark):
    draw = np.random.default_rng(9)
    big = "\n".join(" ".join(f"w{k}" for k in draw.integers(0, 50_000, 20)) for _ in range(40_000))
    docs = spark.createDataFrame([(1, big), (2, "short\n" + big[:3000]), (3, big + " end")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    clean = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs).collect()}
    assert clean[1]["_dropped"] == 0 and clean[3]["_dropped"] == 40_000 and clean[2]["_clean"].startswith("short")


def test_union_find_equals_stars(spark):
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 900, (700, 2))] + [(i, i + 1) for i in range(2000, 2300)] + [(5000, 5000 + i) for i in range(1, 400)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    stars = {r["id"]: r["component"] for r in similar.connected_components(df).collect()}
    assert {r["id"]: r["component"] for r in similar.union_find(df).collect()} == stars
    # In many small tasks, where rounds and then stars have to finish.
    limit, similar.LAST = similar.LAST, 60
    try:
        assert {r["id"]: r["component"] for r in similar.union_find(df).collect()} == stars
    finally:
        similar.LAST = limit
    assert similar.union_find(df.limit(0)).count() == 0


def test_line_recall_against_all_pairs(spark, data_dir):
    """Every pair of like lines of the small documents is linked, directly or through others."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    places = {}
    for r in docs.collect():
        for k, x in enumerate(r["text"].split("\n")):
            x = " ".join(re.sub("[A-Z]", lambda m: m.group().lower(), x).split())
            if x:
                places.setdefault(x, []).append((r["doc_id"], k))
    texts = sorted(places)
    sets = [{x[i:i + 8] for i in range(max(len(x) - 7, 1))} for x in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if 100 * small >= 80 * large and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i, x in enumerate(texts):
        groups.setdefault(top(i), []).extend(places[x])
    expected = {p for g in groups.values() for p in g if p != min(g)}
    gone = {(r["doc_id"], k) for r in lines.repeated_lines(docs).collect() for k in r["gone"]}
    assert gone <= expected and len(gone) >= 0.995 * len(expected)


def test_bits_and_discarded_tables(spark):
    df = spark.range(0, 5000, 7).withColumn("p", F.xxhash64("id").bitwiseAND((1 << 26) - 1))
    bits = bit_map(df, F.col("p"))
    places = np.array([r["p"] for r in df.collect()])
    assert has_bit(bits, places).all() and int(np.bitwise_count(bits).sum()) == len(set(places.tolist()))
    stored = store(df, "bits")
    discard(stored, None)
    assert "PATH_NOT_FOUND" in str(pytest.raises(Exception, lambda: spark.read.parquet(stored._stored_at)).value)


def test_no_local_checkpoints_or_cross_joins():
    import pathlib

    import tablewright.llm
    for path in pathlib.Path(tablewright.llm.__file__).parent.glob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, path
