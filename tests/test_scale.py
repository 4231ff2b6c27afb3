"""Plans and behaviour that matter on large and skewed tables."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import anomalies as N, constraints as V, domain as M, incremental as I, profile as A, rows
from tablewright.functions.vectors import nearest


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of 30,000 rows share one key and one text."""
    return spark.range(30_000).selectExpr(
        "id", "CASE WHEN id % 3 > 0 THEN -1 ELSE id END AS k", "CASE WHEN id % 3 > 0 THEN 'same' ELSE concat('t', id) END AS t",
        "CASE WHEN id % 3 > 0 THEN 5.0D ELSE CAST(id % 1000 AS DOUBLE) END AS v").repartition(8)


def test_keep_first_limits_before_the_shuffle(spark, hot):
    first = rows.keep_first(hot, ["k"], ["id"])
    text = plan(first)
    assert "WindowGroupLimit" in text
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")
    assert first.count() == 10_001 and first.where("k = -1").first()["id"] == 1


def test_top_values_limit_before_the_shuffle(hot):
    counts = A.value_counts(A.typed_values(hot, ["k", "t"]))
    assert plan(A._profile_rows(hot, ["k", "t"], counts, 5)).count("WindowGroupLimit") >= 4
    assert A.top_values(hot, ["t"]).orderBy("rank").first()["n"] == 20_000


def test_profile_reuses_its_grouped_counts(spark, hot):
    rows_ = A._profile_rows(hot, hot.columns, A.value_counts(A.typed_values(hot)), 5)
    rows_.collect()
    final = plan(rows_).split("== Initial Plan ==")[0]
    # Distinct count, top and smallest values of each data type (ids and keys, texts, numbers) read one exchange.
    assert final.count("ReusedExchange") == 6


def test_duplicate_count_shuffles_digests_only(hot):
    text = plan(A.duplicate_row_count(hot.drop("id")))
    assert "hashpartitioning(_a" in text
    assert A.duplicate_row_count(hot.drop("id")).first()["duplicate_row_count"] == 19_999


def test_filters_reach_the_scan(spark, data_dir):
    events = spark.read.parquet(f"{data_dir}/events.parquet")
    text = plan(I.new_rows(events, "ts", "2024-01-20 00:00:00").select("event_id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text
    bounds = N.quartile_bounds(events, ["value"])
    text = plan(N.numeric_outliers(events, ["event_id"], bounds))
    assert "PushedFilters: [Or(LessThan(value," in text


def test_rare_patterns_join_is_a_bounded_broadcast(hot):
    text = plan(N.rare_patterns(hot, ["id"], ["t"]))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text and "CartesianProduct" not in text


def test_no_pairs_in_vector_search(spark, data_dir):
    vectors = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    text = plan(nearest(vectors, "vec_id", "embedding", [(1, [1.0] * 64), (2, [-1.0] * 64)], 3))
    assert "FlatMapCoGroupsInArrow" in text and "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_domain_scores_cut_tokens_before_the_shuffle(spark, hot):
    datasets = hot.select(F.col("k").alias("dataset_id"), F.lit("order stock price the").alias("goal"))
    scores = M.domain_scores(M.goal_tokens(datasets))
    text = plan(scores)
    assert text.index("Exchange hashpartitioning") < text.index("BroadcastHashJoin")
    assert scores.where("dataset_id = -1 AND domain = 'retail'").first()["hits"] == 2


def test_orphans_join_counted_keys(hot):
    got = rows.orphan_counts(hot, "k", hot.where("k >= 0"), "k").first()
    assert (got["orphan_keys"], got["orphan_rows"]) == (1, 20_000)


def test_hot_values_in_quantiles_and_checks(hot):
    bounds = N.quartile_bounds(hot, ["v"])
    assert bounds["v"][:2] == (5.0, 5.0) or bounds["v"][0] == 5.0
    assert V.repeated_keys(hot, ["k"]).first()["violation_count"] == 1


def test_no_local_checkpoints_or_cross_joins():
    import pathlib
    for path in pathlib.Path(__file__).parent.parent.glob("tablewright/**/*.py"):
        if "llm" in path.parts:
            continue
        text = path.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, path
