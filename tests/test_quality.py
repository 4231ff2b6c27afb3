import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.operators import (
    anomalies as N, checks as Q, column_tests as CT, constraints as V, drift as D, profile as A, rows)


def clean(spark):
    return spark.range(1, 101).selectExpr(
        "concat('tx-', id) AS transaction_id", "id AS quantity", "10.0D + 0.5D * id AS unit_price_usd",
        "TIMESTAMP'2024-01-01' AS transaction_date")


def test_clean_output_passes(spark):
    out = clean(spark)
    checks = Q.quality_checks(out, A.profile(out), rules=["unit_price_non_negative"])
    assert Q.verdict(checks).first()["overall_passed"]
    assert checks.where("NOT passed").count() == 0
    assert {r[0] for r in checks.select("check_name").distinct().collect()} == {
        "row_count", "null_rate", "value_range", "non_negative_values"}


def test_lost_rows_fail(spark):
    source = spark.range(500).selectExpr("concat('tx-', id) AS transaction_id", "id AS quantity")
    dirty = source.limit(10).selectExpr("CASE WHEN quantity < 5 THEN transaction_id END AS transaction_id",
                                        "CAST(NULL AS BIGINT) AS quantity")
    verdict = Q.verdict(Q.quality_checks(dirty, A.profile(source))).first()
    assert not verdict["overall_passed"] and verdict["critical_failures"] == ["row_count"]


def test_dedup_lowers_the_row_limit(spark):
    source, out = spark.range(100).toDF("id"), spark.range(35).toDF("id")
    stats = A.column_stats(source)
    assert not Q.verdict(Q.quality_checks(out, stats)).first()["overall_passed"]
    assert Q.verdict(Q.quality_checks(out, stats, transformations=["dedup_by_id"])).first()["overall_passed"]


def test_empty_input_counts_as_full(spark):
    empty = spark.range(0).toDF("id")
    row = Q.quality_checks(empty, A.column_stats(empty)).where("check_name = 'row_count'").first()
    assert row["passed"]


def test_unprofiled_columns(spark):
    out = clean(spark)
    assert Q.unprofiled_columns(out.withColumn("extra", F.lit(1)), A.column_stats(out)) == ["extra"]


def test_outlier_found(spark):
    prices = [9.8, 10.0, 10.1, 10.2, 10.3, 10.5, 10.7, 10.9, 11.0, 9999.0]
    df = spark.createDataFrame([(i, p, "item") for i, p in enumerate(prices)], "id int, price double, label string")
    found = N.detect_anomalies(df, ["id"]).collect()
    assert [(r["id"], r["column"]) for r in found if r["column"] == "price"] == [(9, "price")]
    assert N.detect_anomalies(df, ["id"], ["label", "gone"]).count() == 0


def test_quotes_in_patterns(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["it's", "it's", "a-b", "a b", "1", "2!"])], "id int, t string")
    rare = N.rare_patterns(df, ["id"], ["t"], k=3)
    assert rare.count() == 2
    assert N.common_patterns(df, ["t"]).orderBy("rank").first()["pattern"] == "AA'A"


def test_digit_mode_groups_ids(spark):
    df = spark.createDataFrame([(i, f"CUST-{1000 + i}") for i in range(20)], "id int, t string")
    assert N.rare_patterns(df, ["id"], ["t"]).count() == 17
    assert N.rare_patterns(df, ["id"], ["t"], mode="letters_digits").count() == 0


def test_evidence_holds_every_cell(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id < 100 THEN 1e6 + id ELSE CAST(id % 10 AS DOUBLE) END AS v")
    found = N.detect_anomalies(df, ["id"], ["v"])
    assert N.anomaly_summary(found, ["id"]).first()["anomaly_count"] == 100
    assert N.evidence(found, ["id"]).count() == 100
    assert N.evidence(found, ["id"], per_column=50).count() == 50
    rates = N.anomaly_rates(found, ["id"], 1000).first()
    assert (rates["anomaly_count"], rates["anomaly_rate"]) == (100, 0.1)


@pytest.mark.parametrize("before, after, severity, change", [
    ({"col_a": "A", "col_b": "B"}, {"col_a": "A"}, "critical", ("col_b", "dropped")),
    ({"col_a": "A"}, {"col_a": "A", "col_new": "B"}, "warning", ("col_new", "added")),
    ({"col_a": "A"}, {"col_a": "B"}, "critical", ("col_a", "type_change")),
    ({"col_a": "A"}, {"col_a": "A"}, "none", None)])
def test_drift(spark, before, after, severity, change):
    def frame(d):
        return spark.createDataFrame(list(d.items()), "column string, type string")
    changes = D.compare_schemas(frame(before), frame(after))
    summary = D.drift_summary(changes)
    assert summary.first()["drift_severity"] == severity
    assert [(r["column"], r["change"]) for r in changes.collect()] == ([change] if change else [])
    if severity == "critical":
        with pytest.raises(D.DriftError):
            D.drift_gate(summary)
        assert D.drift_gate(summary, "accept") == "critical"
    else:
        assert D.drift_gate(summary) == severity


def test_no_prior_run_is_no_drift(spark):
    changes = spark.createDataFrame([("a", "added", None, "X")], "column string, change string, prior_type string, current_type string")
    assert D.drift_summary(changes, prior_exists=False).first()["drift_severity"] == "none"


def test_constraints(spark):
    df = spark.createDataFrame(
        [("A12", "1HGCM82633A004352", 1885, 200, datetime.date(2030, 1, 1)), ("bad", "short", 2024, 40, None)],
        "icd string, vin string, year int, hours int, hire_date date")
    got = {r["name"]: r["violation_count"] for r in V.evaluate(
        df, ["icd_format", "vin_length", "year_range", "hours_range", "no_future_hire_date", "transaction_id_unique"],
        datetime.date(2025, 1, 1)).collect()}
    assert got == {"icd_format": 1, "vin_length": 1, "year_range": 1, "hours_range": 1, "no_future_hire_date": 1}


def test_rules_meet_columns_of_many_datasets(spark):
    from tablewright.operators import domain as M
    one = spark.createDataFrame([(1.0, "a", "GBP", 1, True, "x")], "Unit_Price double, Country string, currency string, qty int, is_return boolean, page string")
    other = spark.createDataFrame([(1, "A12", 3, "t", -1)], "patient_age int, diagnosis_code string, quantity int, ward string, note int")
    columns = A.union_all([V.table_columns(one, "one"), V.table_columns(other, "other")])
    domains = spark.createDataFrame([("one", "retail"), ("other", "medical"), ("none", "unknown")], "dataset string, domain string")
    found = {(r["dataset"], r["rule"], r["column"]) for r in M.rule_assignments(columns, domains).collect()}
    assert found == {("one", "unit_price_non_negative", "Unit_Price"), ("one", "quantity_check", "qty"), ("one", "country_canonical", "Country"),
                     ("other", "no_negative_ages", "patient_age"), ("other", "icd_format", "diagnosis_code"),
                     ("other", "null_filled", "diagnosis_code"), ("other", "null_filled", "ward")}
    every = sorted({r[0] for r in V.RULE_COLUMNS})
    wanted = spark.createDataFrame([(d, r) for d in ("one", "other") for r in every], "dataset string, rule string")
    joined = {(r["dataset"], r["rule"], r["column"]) for r in V.match_rules(columns, wanted).collect()}
    assert joined == {(d, *p) for d, df in (("one", one), ("other", other)) for p in V.applicable(df, every)}


def test_lost_rows_are_counted_by_key(spark):
    before = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (2, "x", None), (2, "x", "c"), (None, None, "d")], "k int, u string, v string")
    after = spark.createDataFrame([(1, "filled", "a"), (2, "x", "c")], "k int, u string, v string")
    assert V.lost_null_rows(before, after, ["k"]).first()["violation_count"] == 2      # one of key 1, and the null key
    assert V.lost_null_rows(before, after, ["k"], least=1).first()["violation_count"] == 1
    assert V.lost_repeats(before, after, ["k"]).first()["violation_count"] == 2
    assert V.lost_repeats(before, after, ["k"], least=1).first()["violation_count"] == 0


def test_change_summary_of_maps_texts_and_types(spark):
    before = spark.sql("SELECT id AS k, map('a', id, 'b', 1L) AS m, repeat(concat('long ', id), 2000) AS t, '5.50' AS n, '2024-01-02' AS d,"
                       " if(id = 1, NULL, id) AS x, 'true' AS b FROM range(6)")
    after = spark.sql("SELECT id AS k, map('b', 1L, 'a', if(id = 2, 9L, id)) AS m, repeat(concat('long ', if(id = 3, 33, id)), 2000) AS t,"
                      " if(id = 4, 5.25D, 5.5D) AS n, DATE'2024-01-02' AS d, if(id = 5, NULL, id) AS x, true AS b FROM range(6)")
    got = {r["column"]: (r["changed_cells"], r["set_to_null"]) for r in rows.change_summary(before, after, ["k"]).collect()}
    assert got == {"m": (1, 0), "t": (1, 0), "n": (1, 0), "d": (0, 0), "x": (2, 1), "b": (0, 0)}
    plan = rows.change_summary(before, after, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    shuffled = plan[:plan.index("Union")]
    assert "t#" not in shuffled.split("Aggregate [_k0")[1].split("\n")[0]


def test_column_tests(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "x", False), (3, None, True)], "id int, t string, b boolean")
    tests = CT.read_tests(CT.suggest_tests(A.profile(df)))
    assert {(c, t) for c, t, _ in tests} == {
        ("id", "unique"), ("id", "not_null"), ("b", "not_null"), ("b", "accepted_values")}
    assert CT.run_tests(df, tests).where("NOT passed").count() == 0
    assert not CT.run_tests(df, [("t", "not_null", None)]).first()["passed"]


def test_change_summary_with_repeated_keys(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "k int, v string")
    after = spark.createDataFrame([(1, "A"), (2, "b"), (4, "e")], "k int, v string")
    row = rows.change_summary(before, after, ["k"]).first()
    assert (row["changed_cells"], row["compared_rows"], row["ambiguous_keys"], row["removed_keys"], row["added_keys"]) == (1, 1, 1, 1, 1)


def test_row_differences_count_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (2,)], "x int")
    got = {r["x"]: (r["only_before"], r["only_after"]) for r in rows.row_differences(a, b).collect()}
    assert got == {1: (2, 0), None: (1, 0), 2: (0, 1)}


def test_keep_first_and_null_keys(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (None, 3), (None, 4)], "id int, o int")
    assert sorted(r["o"] for r in rows.keep_first(df, ["id"], ["o"]).collect()) == [1, 3]
    assert sorted(r["o"] for r in rows.keep_first(df, ["id"], ["o"], keep_null_keys=True).collect()) == [1, 3, 4]


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS g").repartition(7)
    got = rows.with_row_index(df, ["g", "id"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in got] == list(range(1000))
    assert [(r["g"], r["id"]) for r in got] == sorted((r["g"], r["id"]) for r in got)


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(i, float(i), "a'b", f"{i}/01/2024") for i in range(1, 13)],
                               ["the id", "a.b", "x`y", "day's date"])
    prof = {r["column"]: r for r in A.profile(df).collect()}
    assert prof["a.b"]["mean"] == 6.5 and prof["x`y"]["unique_count"] == 1
    from tablewright.operators import infer, transforms as TR
    assert infer.infer_schema(df).count() == 4
    assert Q.quality_checks(df, A.profile(df), infer.infer_schema(df)).where("NOT passed AND check_name <> 'type_conformance'").count() == 0
    assert N.detect_anomalies(df, ["the id"]).where("column = 'a.b'").count() == 0
    assert A.duplicate_row_count(df).first()["duplicate_row_count"] == 0
    assert A.top_values(df).where("column = 'x`y'").first()["n"] == 12
    assert TR.apply_transform(df, "standardise_dates").where("`day's date` IS NULL").count() == 0
    assert rows.change_summary(df, df, ["the id"]).where("changed_cells > 0").count() == 0
    assert rows.keep_first(df, ["x`y"], ["a.b"]).first()["the id"] == 1
