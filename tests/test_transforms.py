import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from fixtures import sales
from tablewright.operators import infer, lineage as L, transforms as TR


def cells(spark, name, values, column, kind="string", **params):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {column} {kind}")
    out = TR.apply_transform(df, name, **params)
    target = out.columns[1]
    return [r[target] for r in out.orderBy("i").collect()]


def test_currency(spark):
    assert cells(spark, "strip_currency_symbols", ["£1,234.5", "$ 7", "abc", None, "-2", "5d", ""], "price") == [
        1234.5, 7.0, None, None, -2.0, None, None]
    assert cells(spark, "strip_currency_symbols", [1, None], "total", "int") == [1.0, None]
    assert cells(spark, "convert_currency", ["£10"], "amount", rate=2, rename={"amount": "amount_usd"}) == [20.0]


def test_dates(spark):
    day = datetime.date(2024, 1, 5)
    got = cells(spark, "standardise_dates",
                ["2024-01-05", "05/01/2024", "5-1-2024", "05012024", "1704412800", " 2024-1-5 ", "31/02/2024", "soon", None],
                "order_date")
    assert got == [day] * 6 + [None] * 3
    stamp = datetime.datetime(2024, 1, 5, 23, 59)
    assert cells(spark, "standardise_dates", [stamp], "time", "timestamp_ntz") == [day]


def test_phone_columns_and_numbers(spark):
    assert cells(spark, "normalise_phone", ["07911 123456", "+44 7911 123456", "555-1", "n/a", None], "phone") == [
        "+447911123456", "+447911123456", "5551", None, None]
    df = spark.createDataFrame([("020 7946 0000", "1")], "hotel string, tel string")
    assert TR.apply_transform(df, "normalise_phone").first()["hotel"] == "020 7946 0000"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abzABZ '-3.éßÉñ\t_", max_size=12), min_size=5, max_size=30))
def test_title_case_equals_python(spark, words):
    assert cells(spark, "title_case", words, "full_name") == [w.title() for w in words]


def test_country_fuel_department_codes(spark):
    assert cells(spark, "normalise_country", ["uk", " U.K.", "deutschland", "Spain", None], "country") == [
        "UK", "UK", "Germany", "Spain", None]
    assert cells(spark, "normalise_fuel_type", ["Gasoline", " EV ", "Steam"], "fuel_type") == ["petrol", "electric", "steam"]
    assert cells(spark, "normalise_department", ["  human   RESOURCES "], "department") == ["Human Resources"]
    assert cells(spark, "uppercase_vin", [" abc "], "vin") == ["ABC"]
    assert cells(spark, "uppercase_registration", ["ab12 cde"], "registration_plate") == ["AB12 CDE"]
    assert cells(spark, "uppercase_icd", ["a12.3"], "icd_code") == ["A12.3"]


def test_booleans_fills_flags(spark):
    assert cells(spark, "normalise_boolean", ["False", "f", "YES", "1", "x", None], "is_paid") == [
        False, False, True, True, None, None]
    assert cells(spark, "fill_null_strings", ["a", None], "note") == ["a", "unknown"]
    df = spark.createDataFrame([(1, -2), (2, None), (3, 4)], "id int, quantity int")
    assert [r["is_return"] for r in TR.apply_transform(df, "flag_negative_quantity").orderBy("id").collect()] == [True, False, False]


IDEMPOTENT = ["strip_currency_symbols", "standardise_dates", "flag_negative_quantity", "fill_null_strings",
              "normalise_phone", "title_case", "normalise_country", "normalise_boolean", "normalise_fuel_type",
              "normalise_department", "uppercase_vin"]


@pytest.mark.parametrize("name", IDEMPOTENT)
def test_idempotent(spark, name):
    df = sales(spark, 60).withColumns({
        "phone": F.lit("07911 123456"), "fuel": F.lit("EV"), "department": F.lit(" it  ops"), "vin": F.lit("x1")})
    once = TR.apply_transform(df, name)
    twice = TR.apply_transform(once, name)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def retail_plan():
    return TR.TransformPlan([
        TR.Step("strip_currency_symbols"), TR.Step("standardise_dates"), TR.Step("normalise_country"),
        TR.Step("flag_negative_quantity"), TR.Step("normalise_boolean"),
        TR.Step("dedup_by_id", None, {"order": ("transaction_date", "customer_id", "product_name", "quantity")})])


def test_plan_on_raw_sales(spark):
    raw = sales(spark)
    plan = retail_plan()
    plan.check("retail")
    out = plan.apply(raw).cache()
    assert 400 <= out.count() <= 500
    assert out.select("transaction_id").distinct().count() == out.count()
    assert out.where("unit_price_gbp IS NULL OR transaction_date IS NULL OR is_returned IS NULL").count() == 0
    assert {r[0] for r in out.select("country").distinct().collect()} <= {"UK", "Germany", "France", "Netherlands", "Sweden"}
    assert out.join(raw, "transaction_id", "left_anti").count() == 0
    raw.createOrReplaceTempView("raw_sales")
    by_sql = spark.sql(plan.to_sql(raw, "raw_sales"))
    assert by_sql.schema == out.schema
    assert by_sql.exceptAll(out).isEmpty() and out.exceptAll(by_sql).isEmpty()


def test_plan_rules():
    with pytest.raises(ValueError, match="required"):
        TR.TransformPlan([TR.Step("standardise_dates")]).check("retail")
    with pytest.raises(ValueError, match="forbidden"):
        TR.TransformPlan([TR.Step("dedup_rows")]).check("medical", enforce_required=False)
    with pytest.raises(ValueError, match="unknown transform"):
        TR.TransformPlan([TR.Step("guess")]).check("retail")
    TR.TransformPlan([]).check("unknown")


def test_lineage_edges(spark):
    raw = sales(spark, 5)
    edges = {(r["source_column"], r["target_column"]): r["transformation"]
             for r in L.lineage_edges(retail_plan(), raw, "r1").collect()}
    assert edges["quantity", "is_return"] == "flag_negative_quantity"
    assert edges["quantity", "quantity"] == "passthrough"
    assert edges["country", "country"] == "normalise_country"
    plan = TR.TransformPlan([TR.Step("strip_currency_symbols", ("unit_price_gbp",)),
                             TR.Step("convert_currency", ("unit_price_gbp",), {"rename": {"unit_price_gbp": "unit_price_usd"}})])
    chained = {(r["source_column"], r["target_column"]): r["transformation"] for r in L.lineage_edges(plan, raw, "r2").collect()}
    assert chained["unit_price_gbp", "unit_price_usd"] == "strip_currency_symbols > convert_currency"
    assert "unit_price_gbp" not in {t for _, t in chained}


def test_trace_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source string, target string")
    start = spark.createDataFrame([("a",)], "node string")
    got = {r["node"]: r["depth"] for r in L.trace(edges, start).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    up = {r["node"]: r["depth"] for r in L.trace(edges, spark.createDataFrame([("d",)], "node string"), "up").collect()}
    assert up == {"d": 0, "c": 1, "b": 2, "a": 3}
    assert L.trace(edges, start, max_depth=1).count() == 2


def test_registered_transform(spark):
    TR.register_transform("double_quantity", lambda df: df.withColumn("quantity", F.col("quantity") * 2), ["quantity"], ["quantity"])
    df = spark.createDataFrame([(1, 2)], "id int, quantity int")
    plan = TR.TransformPlan([TR.Step("double_quantity")])
    assert plan.apply(df).first()["quantity"] == 4
    assert ("quantity", "quantity", "double_quantity") in plan.edges(df)
    with pytest.raises(ValueError, match="SQL form"):
        plan.to_sql(df, "t")


def test_casts_and_parse_failures(spark):
    raw = sales(spark, 200)
    typed = TR.apply_casts(raw, infer.infer_schema(raw))
    assert dict(typed.dtypes)["transaction_date"] == "date" and dict(typed.dtypes)["unit_price_gbp"] == "double"
    bad = spark.createDataFrame([("5",), ("five",), ("",), (None,)], "price string")
    assert TR.parse_failures(bad, "strip_currency_symbols").first()["parse_failures"] == 1


def test_repeated_rates_keep_the_row_count(spark):
    amounts = spark.createDataFrame([("GBP", 2.0), ("eur", 3.0), (None, 4.0)], "currency string, amount double")
    rates = spark.createDataFrame([("gbp", 1.5), ("GBP", 1.5), ("EUR", 2.0)], "currency string, rate double")
    out = TR.convert_by_rates(amounts, rates, ["amount"], "currency").collect()
    assert sorted((r["amount"] is None, r["amount"]) for r in out) == [(False, 3.0), (False, 6.0), (True, None)]
    with pytest.raises(Exception, match="different rates"):
        TR.convert_by_rates(amounts, rates.union(spark.createDataFrame([("GBP", 9.0)], rates.schema)), ["amount"], "currency").collect()


def test_default_columns_are_whole_words_of_fitting_type(spark):
    df = spark.createDataFrame([(1.5, "latte", "$2", "2024-01-02")],
                               "overtime double, coffee_type string, service_fee string, order_date string")
    row = TR.apply_transform(TR.apply_transform(df, "strip_currency_symbols"), "standardise_dates").first()
    assert (row["overtime"], row["coffee_type"], row["service_fee"]) == (1.5, "latte", 2.0)
    assert row["order_date"] == datetime.date(2024, 1, 2)
