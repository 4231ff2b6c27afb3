"""Queries: quality checks, constraints, anomalies, row comparisons."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tablewright.operators import (
    anomalies as N, checks as Q, constraints as V, domain as M, infer, profile as A, rows, transforms as TR)
from tablewright.plans.registry import query, table
from tablewright.rules import COUNTRY_VARIANTS, CURRENCY_CODES

KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus"]
FIRST_LINES = (
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY "
    + ", ".join(LINE_ORDER) + ") AS rn FROM lineitem) WHERE rn = 1")

# --- fences -----------------------------------------------------------------

_VALUES = {
    "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "orders": ["o_totalprice"], "events": ["value"], "customer": ["c_acctbal"],
}


def _bounds_sql(t: str, c: str) -> str:
    return (f"SELECT '{c}' AS \"column\", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower,"
            f" q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1,"
            f" quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {t})")


@query("iqr_bounds", "SELECT \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr,"
       " round(lower, 6) AS lower, round(upper, 6) AS upper FROM ("
       + " UNION ALL ".join(_bounds_sql(t, c) for t, cs in _VALUES.items() for c in cs) + ")")
def iqr_bounds(spark, sf):
    frames = []
    for t, columns in _VALUES.items():
        df = table(spark, sf, t)
        frames.append(N.bounds_frame(df, N.quartile_bounds(df, columns)))
    return A.union_all(frames).select("column", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")])


@query("iqr_outliers",
       f"WITH b AS ({_bounds_sql('events', 'value')})"
       " SELECT event_id, \"column\", value, round(lower, 6) AS lower, round(upper, 6) AS upper FROM events, b"
       " WHERE value < lower OR value > upper")
def iqr_outliers(spark, sf):
    events = table(spark, sf, "events")
    found = N.numeric_outliers(events, ["event_id"], N.quartile_bounds(events, ["value"]))
    return found.select("event_id", "column", F.col("value").cast("double").alias("value"),
                        F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query("range_filter", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 2 OR l_quantity > 49")
def range_filter(spark, sf):
    return table(spark, sf, "lineitem").where((F.col("l_quantity") < 2) | (F.col("l_quantity") > 49)).select(
        *KEY, "l_partkey", "l_quantity")


def _shape(c: str) -> str:
    return f"regexp_replace({c}, '[a-zA-Z]', 'A', 'g')"


def _rare_sql(t: str, key: str, c: str) -> str:
    return (f"SELECT {key}::BIGINT AS id, '{c}' AS \"column\", {c} AS value FROM {t} WHERE {c} IS NOT NULL AND {_shape(c)} NOT IN"
            f" (SELECT {_shape(c)} FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)")


@query("rare_patterns", _rare_sql("part", "p_partkey", "p_name") + " UNION ALL " + _rare_sql("part", "p_partkey", "p_brand")
       + " UNION ALL " + _rare_sql("supplier", "s_suppkey", "s_name"))
def rare_patterns(spark, sf):
    part = N.rare_patterns(table(spark, sf, "part"), ["p_partkey"], ["p_name", "p_brand"])
    supplier = N.rare_patterns(table(spark, sf, "supplier"), ["s_suppkey"], ["s_name"])
    return A.union_all([
        part.select(F.col("p_partkey").alias("id"), "column", "value"),
        supplier.select(F.col("s_suppkey").alias("id"), "column", "value")])


_EVENT_ANOMALIES = (
    f"WITH b AS ({_bounds_sql('events', 'value')}),"
    " a AS (SELECT event_id, 'value' AS \"column\", CAST(value AS VARCHAR) AS value, true AS fenced FROM events, b"
    " WHERE value < lower OR value > upper UNION ALL "
    "SELECT id, \"column\", value, false FROM (" + _rare_sql("events", "event_id", "event_type") + " UNION ALL "
    + _rare_sql("events", "event_id", "props") + "))")


def _event_anomalies(spark, sf):
    return N.detect_anomalies(table(spark, sf, "events"), ["event_id"], ["value", "event_type", "props"])


@query("anomaly_scan", _EVENT_ANOMALIES + " SELECT event_id, \"column\", fenced FROM a")
def anomaly_scan(spark, sf):
    return _event_anomalies(spark, sf).select("event_id", "column", F.col("lower").isNotNull().alias("fenced"))


@query("anomaly_summary", _EVENT_ANOMALIES + " SELECT \"column\", count(*) AS anomaly_count,"
       " (SELECT string_agg(event_id, ',' ORDER BY event_id) FROM (SELECT event_id FROM a AS x WHERE x.\"column\" = a.\"column\""
       " ORDER BY event_id LIMIT 5)) AS examples FROM a GROUP BY \"column\"")
def anomaly_summary(spark, sf):
    ids = _event_anomalies(spark, sf).withColumn("value", F.col("event_id").cast("string"))
    return N.anomaly_summary(ids, ["event_id"]).withColumn("examples", F.array_join("examples", ","))


@query("anomaly_rates", _EVENT_ANOMALIES + " SELECT count(*) AS anomaly_count, count(DISTINCT event_id) AS anomalous_rows,"
       " round(count(*) / (SELECT count(*) FROM events), 4) AS anomaly_rate,"
       " round(count(DISTINCT event_id) / (SELECT count(*) FROM events), 4) AS anomalous_row_rate FROM a")
def anomaly_rates(spark, sf):
    return N.anomaly_rates(_event_anomalies(spark, sf), ["event_id"], table(spark, sf, "events").count())


@query("anomaly_evidence", _EVENT_ANOMALIES + " SELECT event_id, \"column\", CASE WHEN fenced THEN NULL ELSE value END AS text FROM a")
def anomaly_evidence(spark, sf):
    cells = N.evidence(_event_anomalies(spark, sf), ["event_id"])
    return cells.select("event_id", "column", F.when(F.col("lower").isNull(), F.col("value")).alias("text"))


@query("anomaly_explanations", _EVENT_ANOMALIES + ", c AS (SELECT \"column\", count(*) AS n FROM a GROUP BY 1),"
       " t AS (SELECT count(*) AS total, min(value) + 0.0::DOUBLE AS low, max(value) + 0.0::DOUBLE AS high FROM events)"
       " SELECT c.\"column\", n AS anomaly_count, CASE WHEN c.\"column\" = 'value' THEN"
       " printf('%d of %d values of %s (%.2f%%) lie outside [%.2f, %.2f]; the column runs from %s to %s.', n, total, c.\"column\","
       " n * 100.0::DOUBLE / total, b.lower, b.upper, CAST(low AS VARCHAR), CAST(high AS VARCHAR))"
       " ELSE printf('%d of %d values of %s (%.2f%%) have an unusual pattern.', n, total, c.\"column\", n * 100.0::DOUBLE / total) END AS explanation"
       " FROM c CROSS JOIN t LEFT JOIN b ON b.\"column\" = c.\"column\"")
def anomaly_explanations(spark, sf):
    events = table(spark, sf, "events")
    bounds = N.bounds_frame(events, N.quartile_bounds(events, ["value"]))
    summary = N.anomaly_summary(_event_anomalies(spark, sf), ["event_id"])
    return N.explain_anomalies(summary, A.profile(events, ["value", "event_type", "props"]), bounds)


@query("redacted_evidence", _rare_sql("part", "p_partkey", "p_name").replace("p_name AS value", "'***' AS value")
       + " UNION ALL " + _rare_sql("part", "p_partkey", "p_brand"))
def redacted_evidence(spark, sf):
    rare = N.rare_patterns(table(spark, sf, "part"), ["p_partkey"], ["p_name", "p_brand"])
    return V.redact(rare, ["p_name"]).select(F.col("p_partkey").alias("id"), "column", "value")


# --- checks -----------------------------------------------------------------

_CHECKED = {"l_orderkey": "num", "l_quantity": "num", "l_extendedprice": "num", "price": "num", "flag": "text"}
_BEFORE = ("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_extendedprice - 5000 AS price,"
           " l_returnflag AS flag FROM lineitem")
_AFTER = ("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity END AS l_quantity,"
          " l_extendedprice * 8 AS l_extendedprice, l_extendedprice - 5000 AS price, l_returnflag AS flag FROM ({})")


def _before_after(spark, sf):
    lines = table(spark, sf, "lineitem")
    before = lines.selectExpr(*KEY, "l_quantity", "l_extendedprice", "l_extendedprice - 5000 AS price", "l_returnflag AS flag")
    after = TR.apply_transform(lines, "dedup_by_id", KEY, order=LINE_ORDER).selectExpr(
        *KEY, "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "l_extendedprice * 8 AS l_extendedprice", "l_extendedprice - 5000 AS price", "l_returnflag AS flag")
    return before, after


def _checks_sql() -> str:
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "price", "flag"]
    parts = ["SELECT 'row_count' AS check_name, 'volume' AS check_type, NULL AS column_name, 'critical' AS severity,"
             " (SELECT count(*) FROM o) / (SELECT count(*) FROM i) >= 0.3 AS passed"]
    for c in columns:
        parts.append(f"SELECT 'null_rate', 'completeness', '{c}', 'error',"
                     f" (SELECT avg(({c} IS NULL)::INT) FROM o) - (SELECT avg(({c} IS NULL)::INT) FROM i) <= 0.05")
        same = "false" if c == "l_quantity" else "true"
        parts.append(f"SELECT 'type_conformance', 'schema', '{c}', 'error', {same}")
        if c != "flag":
            parts.append(f"SELECT 'value_range', 'distribution', '{c}', 'warning', abs((SELECT avg({c}) FROM o) - m) / s <= 3"
                         f" FROM (SELECT avg({c}) AS m, (max({c}) - min({c})) / 4 AS s FROM i) WHERE s > 0")
    parts.append("SELECT 'non_negative_values', 'domain', c, 'error', n = 0 FROM (SELECT 'l_extendedprice' AS c,"
                 " count(*) FILTER (WHERE l_extendedprice < 0) AS n FROM o UNION ALL SELECT 'price',"
                 " count(*) FILTER (WHERE price < 0) FROM o)")
    return f"WITH i AS ({_BEFORE}), o AS ({_AFTER.format(FIRST_LINES)}) " + " UNION ALL ".join(parts)


def _line_checks(spark, sf):
    before, after = _before_after(spark, sf)
    schema = infer.infer_schema(before).withColumn(
        "inferred_type", F.when(F.col("column") == "l_quantity", "DATE").otherwise(F.col("inferred_type")))
    return Q.quality_checks(after, A.column_stats(before), schema, ["dedup_by_id"], ["amount_non_negative"])


@query("quality_checks", _checks_sql())
def quality_checks(spark, sf):
    return _line_checks(spark, sf).select("check_name", "check_type", "column_name", "severity", "passed")


@query("quality_verdict", f"SELECT bool_and(passed OR severity NOT IN ('critical', 'error')) AS overall_passed, count(*) AS check_count,"
       f" count(*) FILTER (WHERE NOT passed) AS failed_count, coalesce(string_agg(CASE WHEN NOT passed AND severity IN"
       f" ('critical', 'error') THEN check_name || coalesce('(' || column_name || ')', '') END, ',' ORDER BY check_name, column_name), '')"
       f" AS critical_failures FROM ({_checks_sql()})")
def quality_verdict(spark, sf):
    return Q.verdict(_line_checks(spark, sf), ("critical", "error")).withColumn(
        "critical_failures", F.array_join("critical_failures", ","))


@query("target_columns", f"SELECT DISTINCT column_name AS \"column\" FROM ({_checks_sql()}) WHERE NOT passed AND column_name IS NOT NULL"
       f" UNION SELECT c FROM (SELECT unnest(['l_orderkey', 'l_extendedprice', 'price']) AS c, unnest([max(l_orderkey) - min(l_orderkey),"
       f" max(l_extendedprice) - min(l_extendedprice), max(price) - min(price)]) AS span FROM ({_BEFORE})) WHERE span > 1000")
def target_columns(spark, sf):
    before, _ = _before_after(spark, sf)
    return Q.target_columns(_line_checks(spark, sf), A.risk_columns(A.profile(before)))


@query("negative_by_keyword", "SELECT 'c_acctbal_total' AS \"column\", count(*) FILTER (WHERE c_acctbal < 0) AS negatives FROM customer"
       " UNION ALL SELECT 's_acctbal_total', count(*) FILTER (WHERE s_acctbal < 0) FROM supplier")
def negative_by_keyword(spark, sf):
    parts = []
    for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal")):
        df = table(spark, sf, t).withColumnRenamed(c, f"{c}_total")
        found = V.evaluate(df, ["amount_non_negative"], columns={"amount_non_negative": [f"{c}_total"]})
        parts.append(found.select("column", F.col("violation_count").alias("negatives")))
    return A.union_all(parts)


# --- constraints ------------------------------------------------------------

AS_OF = datetime.date(1999, 6, 1)


def _rule(name: str, column: str, test: str, source: str) -> str:
    return (f"SELECT '{name}' AS name, '{column}' AS \"column\", count(*) FILTER (WHERE {test}) AS violation_count,"
            f" count(*) FILTER (WHERE {test}) = 0 AS passed FROM ({source})")


_FIN = ("o_orderkey % 5000 AS transaction_id, o_totalprice - 20000 AS amount,"
        " CASE WHEN o_orderkey % 11 = 0 THEN 'gbp' WHEN o_orderkey % 13 = 0 THEN 'QQQ' WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'GBP' END AS currency,"
        " CASE WHEN o_orderkey % 4 = 0 THEN {dmy} WHEN o_orderkey % 15 = 0 THEN '2024-02-30' ELSE {iso} END AS booking_date,"
        " o_orderdate AS value_date")
_FIN_SQL = "SELECT " + _FIN.format(dmy="strftime(o_orderdate, '%d/%m/%Y')", iso="strftime(o_orderdate, '%Y-%m-%d')") + " FROM orders"


@query("constraints_financial", " UNION ALL ".join([
    _rule("amount_non_negative", "amount", "amount < 0", _FIN_SQL),
    _rule("currency_code_format", "currency", "currency NOT IN ('" + "','".join(CURRENCY_CODES) + "')", _FIN_SQL),
    _rule("date_iso8601", "booking_date", "NOT regexp_matches(booking_date, '^\\d{4}-\\d{2}-\\d{2}$') OR try_cast(booking_date AS DATE) IS NULL", _FIN_SQL),
    _rule("date_iso8601", "value_date", "false", _FIN_SQL),
    "SELECT 'transaction_id_unique', 'transaction_id', count(*), count(*) = 0 FROM (SELECT transaction_id FROM"
    f" ({_FIN_SQL}) GROUP BY 1 HAVING count(*) > 1)"]))
def constraints_financial(spark, sf):
    from tablewright.plans.queries_profile import _split
    text = _FIN.format(dmy="date_format(o_orderdate, 'dd/MM/yyyy')", iso="date_format(o_orderdate, 'yyyy-MM-dd')")
    df = table(spark, sf, "orders").selectExpr(*_split(text))
    return V.evaluate(df, ["amount_non_negative", "currency_code_format", "transaction_id_unique", "date_iso8601"])


_MED = ["c_custkey", "CAST(floor(c_acctbal / 100) AS INT) AS patient_age",
        "CASE WHEN c_custkey % 5 = 0 THEN 'A12' WHEN c_custkey % 5 = 1 THEN 'b123' WHEN c_custkey % 5 = 2 THEN 'C12.345' WHEN c_custkey % 5 = 3 THEN 'D1' END AS icd",
        "CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS ward"]
_MED_SQL = f"SELECT {', '.join(_MED)} FROM customer"


@query("constraints_medical", " UNION ALL ".join([
    _rule("no_negative_ages", "patient_age", "patient_age < 0", _MED_SQL),
    _rule("icd_format", "icd", "NOT regexp_matches(replace(icd, '.', ''), '^[A-Z][0-9]{2,5}$')", _MED_SQL),
    _rule("null_filled", "icd", "icd IS NULL", _MED_SQL), _rule("null_filled", "ward", "ward IS NULL", _MED_SQL)]))
def constraints_medical(spark, sf):
    return V.evaluate(table(spark, sf, "customer").selectExpr(*_MED), ["no_negative_ages", "icd_format", "null_filled"])


_CAR = ["concat('WVWZZZ1JZXW', CASE WHEN p_partkey % 6 = 0 THEN '00' ELSE '000001' END) AS vin", "1880 + p_size * 3 AS vehicle_year",
        "p_retailprice - 950 AS mileage", "p_size - 2 AS odometer"]
_CAR_SQL = f"SELECT {', '.join(_CAR)} FROM part"


@query("constraints_automotive", " UNION ALL ".join([
    _rule("vin_length", "vin", "length(vin) <> 17", _CAR_SQL),
    _rule("year_range", "vehicle_year", "vehicle_year NOT BETWEEN 1886 AND 2000", _CAR_SQL),
    _rule("mileage_non_negative", "mileage", "mileage < 0", _CAR_SQL),
    _rule("mileage_non_negative", "odometer", "odometer < 0", _CAR_SQL)]))
def constraints_automotive(spark, sf):
    return V.evaluate(table(spark, sf, "part").selectExpr(*_CAR), ["vin_length", "year_range", "mileage_non_negative"], AS_OF)


_JOB = ["o_totalprice - 50000 AS salary", "CAST(o_orderkey % 200 AS INT) - 10 AS hours", "o_orderdate AS hire_date"]
_JOB_SQL = f"SELECT {', '.join(_JOB)} FROM orders"


@query("constraints_employment", " UNION ALL ".join([
    _rule("salary_non_negative", "salary", "salary < 0", _JOB_SQL),
    _rule("hours_range", "hours", "hours NOT BETWEEN 0 AND 168", _JOB_SQL),
    _rule("no_future_hire_date", "hire_date", "hire_date > TIMESTAMP '1999-06-01'", _JOB_SQL),
    _rule("date_iso8601", "hire_date", "false", _JOB_SQL)]))
def constraints_employment(spark, sf):
    return V.evaluate(table(spark, sf, "orders").selectExpr(*_JOB),
                      ["salary_non_negative", "hours_range", "no_future_hire_date", "date_iso8601"], AS_OF)


_SHOP = ["l_extendedprice - 1500 AS unit_price", "l_quantity - 3 AS quantity", "l_linenumber = 1 AS is_return",
         "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount * 1100 END AS discount_pct",
         "CASE WHEN l_returnflag = 'A' THEN 'UK' WHEN l_linenumber = 4 THEN 'france' WHEN l_linenumber = 5 THEN NULL ELSE 'France' END AS country"]
_SHOP_SQL = f"SELECT {', '.join(_SHOP)} FROM lineitem"


@query("constraints_retail", " UNION ALL ".join([
    _rule("unit_price_non_negative", "unit_price", "unit_price < 0", _SHOP_SQL),
    _rule("quantity_check", "quantity", "quantity < 0 AND NOT is_return", _SHOP_SQL),
    _rule("discount_range", "discount_pct", "discount_pct NOT BETWEEN 0 AND 100", _SHOP_SQL),
    _rule("country_canonical", "country", "country NOT IN ('" + "','".join(COUNTRY_VARIANTS) + "')", _SHOP_SQL)]))
def constraints_retail(spark, sf):
    return V.evaluate(table(spark, sf, "lineitem").selectExpr(*_SHOP),
                      ["unit_price_non_negative", "quantity_check", "discount_range", "country_canonical"])


@query("forbidden_drop_null_rows",
       "SELECT count(*) AS violation_count FROM orders WHERE o_orderkey % 7 = 0 AND o_totalprice < 60000")
def forbidden_drop_null_rows(spark, sf):
    before = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status", "o_totalprice")
    return V.lost_null_rows(before, before.where("o_totalprice >= 60000"), ["o_orderkey"])


@query("forbidden_drop_duplicates", "SELECT CAST(sum(n - 1) AS BIGINT) AS violation_count FROM"
       " (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def forbidden_drop_duplicates(spark, sf):
    keys = table(spark, sf, "lineitem").select(*KEY)
    return V.lost_repeats(keys, keys.distinct(), KEY)


@query("forbidden_drop_negatives", "SELECT count(*) AS violation_count FROM customer WHERE c_acctbal < 0")
def forbidden_drop_negatives(spark, sf):
    customer = table(spark, sf, "customer")
    return V.lost_negative_rows(customer, customer.where("c_acctbal >= 0"), "c_acctbal")


@query("forbidden_masking", "SELECT 'c_name' AS \"column\", count(*) FILTER (WHERE c_nationkey = 5) AS violation_count FROM customer"
       " UNION ALL SELECT 'c_mktsegment', 0 FROM customer GROUP BY 1")
def forbidden_masking(spark, sf):
    customer = table(spark, sf, "customer")
    masked = customer.withColumn("c_name", F.when(F.col("c_nationkey") == 5, F.sha2("c_name", 256)).otherwise(F.col("c_name")))
    return V.altered_sensitive_cells(customer, masked, ["c_custkey"], ["c_name", "c_mktsegment"])


@query("sensitive_columns",
       "WITH c AS (SELECT o_orderkey AS dataset, CASE WHEN o_orderstatus = 'F' THEN 'financial' WHEN o_orderstatus = 'O' THEN 'medical' ELSE 'retail' END AS domain,"
       " unnest(['Address', 'iban', 'postcode', 'customer_id', 'colour']) AS \"column\" FROM orders)"
       " SELECT * FROM c WHERE (domain = 'financial' AND \"column\" = 'iban') OR (domain = 'medical' AND \"column\" IN ('Address', 'postcode'))"
       " OR (domain = 'retail' AND \"column\" IN ('Address', 'customer_id'))")
def sensitive_columns(spark, sf):
    names = F.array(*[F.lit(c) for c in ("Address", "iban", "postcode", "customer_id", "colour")])
    columns = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("dataset"),
        F.when(F.col("o_orderstatus") == "F", "financial").when(F.col("o_orderstatus") == "O", "medical")
        .otherwise("retail").alias("domain"), F.explode(names).alias("column"))
    return V.sensitive_columns(columns)


_LINE_SHOP = ("l_orderkey, l_extendedprice - 1500 AS unit_price, l_quantity - 3 AS quantity, l_linenumber = 1 AS is_return,"
              " CASE WHEN l_returnflag = 'A' THEN 'UK' ELSE 'Atlantis' END AS country, {d} AS ship_date")
_ORDER_PAY = "o_orderkey % 500 AS transaction_id, o_totalprice - 20000 AS amount, CASE WHEN o_orderkey % 11 = 0 THEN 'gbp' ELSE 'GBP' END AS currency, {d} AS order_date"


def _domain_rule(dataset: str, name: str, column: str, test: str, source: str) -> str:
    return f"SELECT '{dataset}' AS dataset, * FROM ({_rule(name, column, test, source)})"


_LINE_SHOP_SQL = "SELECT " + _LINE_SHOP.format(d="strftime(l_shipdate, '%d/%m/%Y')") + " FROM lineitem"
_ORDER_PAY_SQL = "SELECT " + _ORDER_PAY.format(d="strftime(o_orderdate, '%Y-%m-%d')") + " FROM orders"


@query("domain_checks", " UNION ALL ".join([
    _domain_rule("lineitem", "unit_price_non_negative", "unit_price", "unit_price < 0", _LINE_SHOP_SQL),
    _domain_rule("lineitem", "quantity_check", "quantity", "quantity < 0 AND NOT is_return", _LINE_SHOP_SQL),
    _domain_rule("lineitem", "date_iso8601", "ship_date", "true", _LINE_SHOP_SQL),
    _domain_rule("lineitem", "country_canonical", "country", "country <> 'UK'", _LINE_SHOP_SQL),
    _domain_rule("orders", "amount_non_negative", "amount", "amount < 0", _ORDER_PAY_SQL),
    _domain_rule("orders", "currency_code_format", "currency", "currency <> 'GBP'", _ORDER_PAY_SQL),
    _domain_rule("orders", "date_iso8601", "order_date", "false", _ORDER_PAY_SQL),
    f"SELECT 'orders', 'transaction_id_unique', 'transaction_id', count(*), count(*) = 0 FROM (SELECT 1 FROM ({_ORDER_PAY_SQL}) GROUP BY transaction_id HAVING count(*) > 1)"]))
def domain_checks(spark, sf):
    from tablewright.plans.queries_profile import _split
    tables = {"lineitem": table(spark, sf, "lineitem").selectExpr(*_split(_LINE_SHOP.format(d="date_format(l_shipdate, 'dd/MM/yyyy')"))),
              "orders": table(spark, sf, "orders").selectExpr(*_split(_ORDER_PAY.format(d="date_format(o_orderdate, 'yyyy-MM-dd')")))}
    domains = spark.createDataFrame([("lineitem", "retail"), ("orders", "financial")], "dataset string, domain string")
    # Rules meet the columns of all datasets in one join; each table is then read once for all its rules.
    matched = M.rule_assignments(A.union_all([V.table_columns(df, name) for name, df in tables.items()]), domains).collect()
    parts = []
    for name, df in tables.items():
        mine = {}
        for r in matched:
            if r["dataset"] == name:
                mine.setdefault(r["rule"], []).append(r["column"])
        parts.append(V.evaluate(df, mine, columns=mine).select(F.lit(name).alias("dataset"), "*"))
    return A.union_all(parts)


# --- comparisons ------------------------------------------------------------

@query("referential_integrity",
       "SELECT 'lineitem' AS child, count(DISTINCT l_orderkey) AS orphan_keys, count(*) AS orphan_rows FROM lineitem"
       " WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') UNION ALL"
       " SELECT 'orders', count(DISTINCT o_custkey), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"
       " UNION ALL SELECT 'customer', count(DISTINCT c_nationkey), count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def referential_integrity(spark, sf):
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation")}
    return A.union_all([
        rows.orphan_counts(t["lineitem"], "l_orderkey", t["orders"].where("o_orderstatus <> 'F'"), "o_orderkey").withColumn("child", F.lit("lineitem")),
        rows.orphan_counts(t["orders"], "o_custkey", t["customer"], "c_custkey").withColumn("child", F.lit("orders")),
        rows.orphan_counts(t["customer"], "c_nationkey", t["nation"], "n_nationkey").withColumn("child", F.lit("customer"))])


_CHANGED = ("count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_totalprice >= 20000 AND NOT (o_orderstatus = 'F')) AS status_changes,"
            " count(*) FILTER (WHERE o_orderkey % 5 = 0 AND o_totalprice >= 20000) AS price_nulls,"
            " count(*) FILTER (WHERE o_totalprice >= 20000) AS kept, count(*) FILTER (WHERE o_totalprice < 20000) AS gone")


@query("change_summary",
       f"WITH s AS (SELECT {_CHANGED} FROM orders) SELECT 'o_orderstatus' AS \"column\", status_changes AS changed_cells, 0::BIGINT AS set_to_null,"
       " kept AS compared_rows, 0::BIGINT AS ambiguous_keys, gone AS removed_keys, 0::BIGINT AS added_keys FROM s"
       " UNION ALL SELECT 'o_totalprice', price_nulls, price_nulls, kept, 0, gone, 0 FROM s"
       " UNION ALL SELECT c, 0, 0, kept, 0, gone, 0 FROM s, (SELECT unnest(['o_custkey', 'o_orderdate', 'o_orderpriority', 'tags']) AS c)")
def change_summary(spark, sf):
    before = table(spark, sf, "orders").withColumn("tags", F.create_map(F.lit("key"), "o_orderkey", F.lit("customer"), "o_custkey"))
    after = before.where("o_totalprice >= 20000").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice", "CAST(o_custkey AS STRING) AS o_custkey",
        "o_orderdate", "o_orderpriority", "map('customer', o_custkey, 'key', o_orderkey) AS tags")
    return rows.change_summary(before, after, ["o_orderkey"])


@query("row_differences",
       "WITH b AS (SELECT *, count(*) AS n FROM lineitem GROUP BY ALL), a AS (SELECT *, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)"
       " SELECT b.* EXCLUDE (n), b.n AS only_before, 0::BIGINT AS only_after FROM b WHERE l_returnflag = 'R'"
       " UNION ALL SELECT a.* EXCLUDE (n), 0, 0 FROM a WHERE n < 0")
def row_differences(spark, sf):
    lines = table(spark, sf, "lineitem")
    return rows.row_differences(lines, lines.where("l_returnflag <> 'R'"))


@query("row_index", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders")
def row_index(spark, sf):
    return rows.with_row_index(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
