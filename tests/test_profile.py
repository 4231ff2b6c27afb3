import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from fixtures import sample_rows
from tablewright.operators import infer, profile as A, quantiles as Z, sampling as S


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_null_rate_and_duplicates(spark):
    rows = sample_rows()
    for r in rows[:5]:
        r["quantity"] = None
    prof = by_column(A.profile(spark.createDataFrame(rows)))
    assert prof["quantity"]["null_rate"] == 0.25
    assert prof["quantity"]["total_rows"] == 20
    rows = sample_rows()
    repeated = spark.createDataFrame(rows + rows[:3])
    assert A.duplicate_row_count(repeated).first()["duplicate_row_count"] == 3


def test_duplicates_tell_nulls_apart(spark):
    rows = [(None, 5), (5, None), (None, 5), (None, None)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert A.duplicate_row_count(df).first().asDict() == {
        "total_rows": 4, "distinct_rows": 3, "duplicate_row_count": 1}


def test_numeric_statistics(spark):
    df = spark.createDataFrame([(float(i), "x") for i in range(1, 11)], "price double, label string")
    prof = by_column(A.profile(df))
    assert (prof["price"]["mean"], prof["price"]["min"], prof["price"]["max"]) == (5.5, "1.0", "10.0")
    assert prof["label"]["mean"] is None and prof["label"]["min"] is None
    assert prof["label"]["top_5_values"] == ["x"] and prof["label"]["sample_values"] == ["x"]
    assert len(prof["price"]["sample_values"]) == 5


def test_long_texts_are_counted_by_digest_and_shown_whole(spark):
    long = "word " * 40
    df = spark.createDataFrame([(long,), (long,), ("short",), (None,)], "text string")
    row = A.profile(df).first()
    assert row["unique_count"] == 2 and row["top_5_values"] == [long, "short"]
    assert A.top_values(df).orderBy("rank").first()["value"] == long


def test_texts_that_agree_in_their_first_characters(spark):
    same = "the same beginning of all the texts, " * 3
    texts = [same + c for c in "hgfedcba"] + ["zz", "zz", "yy", "yy"] + [same + "b"] * 2 + [same + "g"] * 2
    df = spark.createDataFrame([(t, t[::-1]) for t in texts], "t string, back string").repartition(5)
    for k in (1, 2, 3, 5, 20):
        count = {t: texts.count(t) for t in texts}
        top = [r["value"] for r in A.top_values(df, ["t"], k).orderBy("rank").collect()]
        assert top == sorted(count, key=lambda t: (-count[t], t))[:k]
        rows = A.sample_values(df, ["t", "back"], k).orderBy("column", "rank").collect()
        assert [r["value"] for r in rows if r["column"] == "t"] == sorted(count)[:k]
        assert [r["value"] for r in rows if r["column"] == "back"] == sorted(t[::-1] for t in count)[:k]
    row = by_column(A.profile(df))["t"]
    assert row["top_5_values"] == sorted(count, key=lambda t: (-count[t], t))[:5] and row["sample_values"] == sorted(count)[:5]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    prof = by_column(A.profile(df))
    assert prof["a"]["total_rows"] == 0 and prof["b"]["unique_count"] == 0 and prof["a"]["null_rate"] == 0.0
    assert A.duplicate_row_count(df).first()["duplicate_row_count"] == 0
    assert by_column(infer.infer_schema(df))["b"]["inferred_type"] == "STRING"


def test_profile_of_a_union(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "v") for i in range(30)], "a int, b string")
    parts = [A.profile(df.where("a < 10")), A.profile(df.where("a >= 10"))]
    merged = by_column(A.merge_counts(*parts))
    assert (merged["b"]["total_rows"], merged["b"]["null_count"]) == (30, 20)


def test_approximate_distinct(spark):
    df = spark.range(10_000).selectExpr("id", "id % 7 AS k")
    got = {r["column"]: r["unique_count"] for r in A.distinct_counts(df, exact=False).collect()}
    assert got["k"] == 7 and abs(got["id"] - 10_000) < 600


def test_inferred_types(spark):
    got = by_column(infer.infer_schema(spark.createDataFrame(sample_rows())))
    assert (got["unit_price_gbp"]["inferred_type"], got["unit_price_gbp"]["needs_cast"]) == ("DOUBLE", True)
    assert (got["transaction_date"]["inferred_type"], got["transaction_date"]["needs_cast"]) == ("DATE", True)
    assert got["transaction_date"]["detected_formats"] == ["YYYY-MM-DD"]
    assert got["is_returned"]["inferred_type"] == "BOOLEAN"
    assert (got["quantity"]["inferred_type"], got["quantity"]["needs_cast"]) == ("BIGINT", False)
    assert got["transaction_id"]["inferred_type"] == "STRING"


def test_inference_limits(spark):
    rows = [("12" if i < 9 else "x", "2024-01-01" if i < 7 else "y", "05/01/2024" if i < 6 else "z", "  ", i % 2, 20240101)
            for i in range(10)]
    df = spark.createDataFrame(rows, "n string, d string, e string, blank string, flag int, day_code int")
    got = by_column(infer.infer_schema(df))
    assert got["n"]["inferred_type"] == "DOUBLE"      # nine of ten
    assert got["d"]["inferred_type"] == "DATE"        # seven of ten
    assert got["e"]["inferred_type"] == "STRING"      # six of ten
    assert (got["blank"]["inferred_type"], got["blank"]["needs_cast"]) == ("STRING", False)
    assert got["flag"]["inferred_type"] == "BOOLEAN"
    assert got["day_code"]["inferred_type"] == "INT"
    assert by_column(infer.infer_schema(df.withColumnRenamed("day_code", "day_date")))["day_date"]["inferred_type"] == "DATE"


@pytest.mark.parametrize("text, numeric", [
    ("£1,234.50", True), ("$ 5", True), ("-3", True), ("1e5", True), (".5", True), ("nan", True), ("Infinity", True),
    ("5d", False), ("1_0", False), ("£", False), ("1.2.3", False), ("\t7\n", True)])
def test_number_spellings(spark, text, numeric):
    got = infer.infer_schema(spark.createDataFrame([(text,)], "c string")).first()
    assert (got["inferred_type"] == "DOUBLE") == numeric


def check_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = Z.exact_quantiles(df, ["v"], (0.0, 0.25, 0.5, 0.75, 1.0))["v"]
    want = np.quantile(np.array([v for v in values if v is not None]), [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_quantiles_with_a_hot_value(spark):
    rnd = random.Random(3)
    check_quantiles(spark, [7.0] * 4000 + [rnd.gauss(7, 3) for _ in range(8000)] + [None] * 10)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6) | st.sampled_from([0.0, 1.0]), min_size=1, max_size=60))
def test_quantiles_of_anything(spark, values):
    check_quantiles(spark, [v + 0.0 for v in values])


def test_keys_are_in_the_order_of_the_numbers(spark):
    rnd = np.random.default_rng(2)
    bits = rnd.integers(0, 2**64, 3000, dtype=np.uint64).view(np.float64)
    powers = [x for e in range(-1074, 1024, 7) for x in (2.0**e, np.nextafter(2.0**e, 0), np.nextafter(2.0**e, np.inf))]
    values = [float(v) for v in [*bits[np.isfinite(bits)], *powers, 0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]]
    values += [-v for v in values] + [np.inf, -np.inf]
    got = Z.float_key(spark.createDataFrame([(v,) for v in values], "v double"), "v", "key").collect()
    for r in got:
        assert Z.key_value(r["key"], False) == r["v"]
    assert [r["v"] for r in sorted(got, key=lambda r: r["key"])] == sorted(values)
    assert Z.float_key(spark.createDataFrame([(float("nan"),), (None,)], "v double"), "v", "key").collect()[0]["key"] == 2**63 - 1


def test_a_million_values_within_a_hair(spark):
    df = spark.range(1_000_000).selectExpr("1D + id * 2.220446049250313E-16 AS v", "id + 9007199254740993L AS w", "CAST(id AS DECIMAL(12,2)) / 100 AS d")
    df = df.selectExpr("v", "w", "CAST(d AS DECIMAL(14,2)) AS d")
    got = Z.exact_quantiles(df, ["v", "w", "d"], (0.25, 0.5))
    grid = 1 + np.arange(1_000_000) * 2.220446049250313e-16
    assert got["v"] == pytest.approx(list(np.quantile(grid, [0.25, 0.5])), rel=0, abs=2.3e-16)
    assert got["w"] == [9007199254740993 + 249_999.75, 9007199254740993 + 499_999.5]
    assert got["d"] == pytest.approx(list(np.quantile(np.round(np.arange(1_000_000) / 100, 2), [0.25, 0.5])), abs=1e-9)


def test_a_round_reads_all_columns_in_one_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 0.5D AS x", "id * 2 AS y").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    text = Z._keys(df, df.schema.fields, [(1, 0, 4607182418800017408, 0, [1])])._jdf.queryExecution().toString()
    assert text.split("== Physical Plan ==")[1].count("FileScan") == 1 and "PushedFilters: [" in text and "GreaterThanOrEqual(x," in text


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert Z.exact_quantiles(df, ["v"])["v"] == [None, None]


def test_hash_sample_size(spark):
    df = spark.range(100).withColumn("y", F.lit("a"))
    assert S.hash_sample(df, ["id"], 50).count() == 50
    assert S.hash_sample(df, ["id"], 500).count() == 100
    large = spark.range(60_000)
    drawn = {r[0] for r in S.hash_sample(large, ["id"], 500).collect()}
    assert len(drawn) == 500 and drawn == {r[0] for r in S.hash_sample(large.repartition(5), ["id"], 500).collect()}


def test_three_bucket_sample(spark):
    df = spark.range(100).withColumn("val", F.lit("v"))
    rows = S.three_bucket_sample(df, ["id"], 30).collect()
    ids = [r["id"] for r in rows]
    assert 0 in ids and 99 in ids and len(ids) == len(set(ids)) and len(ids) <= 30


def test_sample_by_named_method(spark):
    ids = {r[0] for r in S.sample(spark.range(60_000), ["id"], 300, method="three_bucket").collect()}
    assert set(range(100)) <= ids and set(range(59_900, 60_000)) <= ids and len(ids) <= 300
    assert S.sample(spark.range(60_000), ["id"], 300).count() == 300
    with pytest.raises(ValueError):
        S.sample(spark.range(3), ["id"], method="other")


def test_first_rows_merged_in_groups(spark):
    df = spark.range(5000).repartition(600).withColumn("k", F.lit(1))
    got = [r["id"] for r in S.first_rows(df, ["k", "id"], 7).collect()]
    assert got == list(range(7))


def test_nested_columns(spark):
    df = spark.sql("SELECT id, map('k', id % 2) AS m, array(id % 2, 1) AS a, named_struct('x', id % 3) AS s,"
                   " parse_json('{\"k\": 1}') AS v, to_json(map('k', repeat('x', 80))) AS long FROM range(6)")
    prof = by_column(A.profile(df))
    assert {c: prof[c]["unique_count"] for c in ("m", "a", "s", "v", "long")} == {"m": 2, "a": 2, "s": 3, "v": 1, "long": 1}
    assert prof["m"]["top_5_values"] == ['{"k":0}', '{"k":1}'] and len(prof["long"]["top_5_values"][0]) == 88
    assert A.duplicate_row_count(df.drop("id", "s")).first()["duplicate_row_count"] == 4
    assert A.distinct_counts(df, ["m"], exact=False).first()["unique_count"] == 2
    from tablewright.sources.publish import fingerprint
    assert fingerprint(df).first()["row_count"] == 6
