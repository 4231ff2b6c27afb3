"""Mergeable profiles, late stream rows, vector search with many queries, registered transforms."""

import numpy as np
from pyspark.sql import functions as F

from tablewright.functions.vectors import nearest
from tablewright.operators import profile as A, sketches as K


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_the_state_of_a_union_is_the_merged_state(spark):
    df = spark.range(60_000).selectExpr("id", "id % 50 AS few", "IF(id % 3 = 0, NULL, concat('t', id % 7)) AS t", "CAST(id % 1000 AS DOUBLE) / 4 AS x",
                                        "CAST(NULL AS DOUBLE) AS gone", "id % 2 = 0 AS flag", "DATE'2024-01-01' AS day", "array(id % 4) AS a")
    parts = [K.sketch(df.where(F.col("id") % 4 == r)) for r in range(4)]
    merged = K.merge_sketches(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))
    whole, exact = by_column(K.sketch_profile(merged)), by_column(A.profile(df))
    for c, e in exact.items():
        got = whole[c]
        for name in ("dtype", "total_rows", "null_count", "null_rate", "blank_count", "min", "max", "mean"):
            assert got[name] == e[name], (c, name)
        assert abs(got["unique_count"] - e["unique_count"]) <= 0.03 * e["unique_count"]
    assert set(whole["t"]["top_5_values"]) <= {f"t{i}" for i in range(7)} and len(whole["t"]["top_5_values"]) == 5
    assert by_column(A.profile(df, exact=False))["few"]["unique_count"] == 50
    for row in K.sketch_quantiles(merged, (0.1, 0.5, 0.9)).collect():
        values = {"id": np.arange(60_000), "few": np.arange(60_000) % 50, "x": np.arange(60_000) % 1000 / 4}[row["column"]]
        for p, q in zip((0.1, 0.5, 0.9), row["quantiles"]):
            assert (values < q).mean() - 0.02 <= p <= (values <= q).mean() + 0.02


def test_a_sketch_profile_shuffles_no_values(spark):
    df = spark.range(100).selectExpr("id", "repeat('long text ', 500) AS t").repartition(3)
    plan = K.sketch(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "hashpartitioning" not in plan and "Generate" in plan
    state = K.sketch(df)
    assert len(state.where("column = 't'").first()["frequent"]["sketch"]) < 5000
    empty = by_column(K.sketch_profile(K.sketch(df.limit(0))))
    assert empty["t"]["total_rows"] == 0 and empty["id"]["unique_count"] == 0 and empty["id"]["mean"] is None


def test_many_query_vectors(spark):
    draw = np.random.default_rng(7)
    vectors = [(i, [float(x) for x in draw.integers(-3, 4, 6)]) for i in range(400)] + [(900, None), (901, [0.0] * 6), (902, [1.0, 2.0])]
    asked = [(f"q{i}", [float(x) for x in draw.integers(-3, 4, 6)]) for i in range(5000)] + [("short", [2.0, 1.0]), ("none", None), ("zero", [0.0] * 6)]
    df = spark.createDataFrame(vectors, "id long, v array<double>").repartition(3)
    found = nearest(df, "id", "v", spark.createDataFrame(asked, "name string, w array<double>"), 3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["id"], r["similarity"]))
    matrix, ids = np.array([v for i, v in vectors[:400]]), np.arange(400)
    lengths = np.linalg.norm(matrix, axis=1)
    for name, w in asked[:5000]:
        if not any(w):
            assert name not in got
            continue
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = np.round(matrix @ np.array(w) / lengths / np.linalg.norm(w), 9)
        scores[lengths == 0] = -9
        order = np.lexsort((ids, -scores))[:3]
        assert np.allclose([s for _, s in got[name]], scores[order], atol=6e-5)
    assert [i for i, _ in got["short"]] == [902] and "none" not in got and "zero" not in got
    few = nearest(df, "id", "v", [("a", vectors[5][1])], 2).collect()
    assert few[0]["similarity"] == 1.0


def test_late_rows_go_to_a_table_of_their_own(spark, tmp_path):
    from tablewright.streaming import ingest as S
    schema = "at timestamp, id long, v string"

    def deliver(rows):
        spark.createDataFrame(rows, "at string, id long, v string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
        run = S.split_late(str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "state"), "at", ["id"], "1 day")
        stream = S.new_file_rows(spark, str(tmp_path / "in"), T._parse_datatype_string(schema), files_per_trigger=1)
        S.ingest_split(stream, run, str(tmp_path / "checkpoint")).awaitTermination()
        return run

    from pyspark.sql import types as T
    run = deliver([("2024-01-01", 1, "a"), ("2024-01-02", 2, "b"), ("2024-01-02", 2, "b"), (None, 3, "no time")])
    deliver([("2024-01-05", 4, "c"), ("2024-01-01 12:00", 5, "in time"), ("2024-01-02", 2, "again")])
    deliver([("2024-01-03 23:00", 6, "late"), ("2024-01-04", 7, "on the line"), ("2024-01-05", None, "null key"), ("2024-01-05", None, "null key")])
    batch = spark.createDataFrame([("2024-01-03 23:00", 6, "late"), ("2024-01-04", 7, "on the line"), ("2024-01-05", None, "null key")], "at string, id long, v string")
    run(batch.withColumn("at", F.col("at").cast("timestamp")), 2)   # a replayed batch leaves one copy
    taken = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str(r["id"]) for r in taken.collect()) == ["1", "2", "4", "5", "7", "None"]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "late")).collect()) == [3, 6]
    marks = [(r["accepted"], r["repeated"], r["late"]) for r in S.batch_marks(spark, str(tmp_path / "state")).orderBy("batch_id").collect()]
    assert marks == [(2, 1, 1), (2, 1, 0), (2, 0, 1)]
