"""Queries: profiling, sampling, inference, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.columns import col, string_columns
from tablewright.functions.sql import quote
from tablewright.operators import anomalies as N, drift as D, infer, profile as A, rows, sampling as S, sketches as K
from tablewright.operators.transforms import ColumnTransform
from tablewright.plans.registry import query, table

LINEITEM = {
    "l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_suppkey": "BIGINT", "l_linenumber": "INT",
    "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE", "l_discount": "DOUBLE", "l_tax": "DOUBLE",
    "l_returnflag": "STRING", "l_linestatus": "STRING", "l_shipdate": "TIMESTAMP_NTZ",
}
ORDERS = {
    "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "STRING", "o_totalprice": "DOUBLE",
    "o_orderdate": "TIMESTAMP_NTZ", "o_orderpriority": "STRING",
}
EVENTS = {
    "event_id": "BIGINT", "ts": "TIMESTAMP_NTZ", "user_id": "BIGINT", "event_type": "STRING", "value": "DOUBLE",
    "props": "STRING",
}
DOCUMENTS = {"doc_id": "BIGINT", "text": "STRING", "lang": "STRING", "source": "STRING", "n_chars": "BIGINT"}
NUMERIC = {"BIGINT", "INT", "DOUBLE"}


def profile_sql(source: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        number = kind in NUMERIC
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) AS total_rows,"
            f" count(*) - count({c}) AS null_count,"
            f" round((count(*) - count({c})) / count(*), 4) AS null_rate,"
            f" {f'count(*) FILTER (WHERE length(trim({c})) = 0)' if kind == 'STRING' else '0::BIGINT'} AS blank_count,"
            f" count(DISTINCT {c}) AS unique_count,"
            f" {f'min({c})::DOUBLE' if number else 'NULL::DOUBLE'} AS min_value,"
            f" {f'max({c})::DOUBLE' if number else 'NULL::DOUBLE'} AS max_value,"
            f" {f'round(avg({c}), 4)' if number else 'NULL::DOUBLE'} AS mean FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _flat(prof):
    return prof.select("column", "dtype", "total_rows", "null_count", "null_rate", "blank_count", "unique_count",
                       F.col("min").cast("double").alias("min_value"), F.col("max").cast("double").alias("max_value"),
                       "mean")


@query("profile_lineitem", profile_sql("lineitem", LINEITEM))
def profile_lineitem(spark, sf):
    return _flat(A.profile(table(spark, sf, "lineitem")))


@query("profile_orders", profile_sql("orders", ORDERS))
def profile_orders(spark, sf):
    return _flat(A.profile(table(spark, sf, "orders")))


@query("profile_events", profile_sql("events", EVENTS))
def profile_events(spark, sf):
    return _flat(A.profile(table(spark, sf, "events")))


@query("profile_documents", profile_sql("documents", DOCUMENTS))
def profile_documents(spark, sf):
    return _flat(A.profile(table(spark, sf, "documents")))


NULLS = ("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,"
         " CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderstatus END AS status"
         " FROM orders")


@query("profile_with_nulls", profile_sql(f"({NULLS})", {"o_orderkey": "BIGINT", "price": "DOUBLE", "status": "STRING"}))
def profile_with_nulls(spark, sf):
    holes = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderstatus END AS status")
    return _flat(A.profile(holes))


def _top_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", rank, value, n FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n,"
        f" row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {source} GROUP BY {c}) WHERE rank <= 5"
        for c in columns)


@query("top5_values", _top_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
       + " UNION ALL " + _top_sql("part", ["p_name", "p_brand", "p_type", "p_size"]))
def top5_values(spark, sf):
    return A.top_values(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).unionByName(
        A.top_values(table(spark, sf, "part"), ["p_name", "p_brand", "p_type", "p_size"]))


def _least_sql(source: str, columns: list[str], prefix: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{prefix}{c}' AS \"column\", rank, value, n FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n,"
        f" row_number() OVER (ORDER BY {c}) AS rank FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5" for c in columns)


@query("sample_values", _least_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"], "d_")
       + " UNION ALL " + _least_sql("conversations", ["conv_id", "turn", "role", "text"], "c_"))
def sample_values(spark, sf):
    found = [A.sample_values(table(spark, sf, t)).withColumn("column", F.concat(F.lit(p), "column"))
             for t, p in (("documents", "d_"), ("conversations", "c_"))]
    return found[0].unionByName(found[1])


@query("top_texts", _top_sql("documents", ["text", "source"]) + " UNION ALL " + _top_sql("benchmark", ["text"]).replace("'text' AS", "'benchmark' AS")
       + " UNION ALL " + _top_sql("conversations", ["role", "text"]).replace("'text' AS", "'turn_text' AS"))
def top_texts(spark, sf):
    return A.top_values(table(spark, sf, "documents"), ["text", "source"]).unionByName(
        A.top_values(table(spark, sf, "benchmark").select(F.col("text").alias("benchmark")))).unionByName(
        A.top_values(table(spark, sf, "conversations").select("role", F.col("text").alias("turn_text"))))


@query("approx_top_values", "SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2"
       " UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2")
def approx_top_values(spark, sf):
    # With no more distinct values than the sketch holds, its counts are exact.
    return A.approx_top_values(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"]).drop("rank")


@query("distinct_counts", "SELECT 'user_id' AS \"column\", count(DISTINCT user_id) AS unique_count FROM events"
       " UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events"
       " UNION ALL SELECT 'value', count(DISTINCT value) FROM events"
       " UNION ALL SELECT 'props', count(DISTINCT props) FROM events")
def distinct_counts(spark, sf):
    return A.distinct_counts(table(spark, sf, "events"), ["user_id", "event_type", "value", "props"])


_SKETCHED = {"l_returnflag": "STRING", "l_linestatus": "STRING", "l_quantity": "DOUBLE", "l_discount": "DOUBLE", "l_tax": "DOUBLE", "l_linenumber": "INT"}


@query("sketch_profile", profile_sql("lineitem", _SKETCHED))
def sketch_profile(spark, sf):
    # Three loads of the table, each profiled by itself; only their states are merged.
    lines = table(spark, sf, "lineitem")
    states = A.union_all(K.sketch(lines.where(F.col("l_orderkey") % 3 == r), list(_SKETCHED)) for r in range(3))
    return _flat(K.sketch_profile(K.merge_sketches(states)))


@query("quoted_columns", "SELECT o_orderkey AS \"order key\", o_totalprice AS \"price (gbp)\", o_orderstatus AS \"a.b`c\", 'é' || o_orderpriority AS \"Ünïcode, name\" FROM orders")
def quoted_columns(spark, sf):
    names = {"o_orderkey": "order key", "o_totalprice": "price (gbp)", "o_orderstatus": "a.b`c", "o_orderpriority": "Ünïcode, name"}
    odd = table(spark, sf, "orders").select(*[col(c).alias(n) for c, n in names.items()])
    # Names of any kind go through a projection by name and a column transform.
    return ColumnTransform("marked", lambda df: ["Ünïcode, name"], lambda f: f"concat('é', {quote(f.name)})").apply(odd.select(*map(col, names.values())))


@query("duplicate_rows", "WITH d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM lineitem)) SELECT count(*) AS total_rows,"
       " any_value(n) AS distinct_rows, count(*) - any_value(n) AS duplicate_row_count FROM lineitem, d")
def duplicate_rows(spark, sf):
    return A.duplicate_row_count(table(spark, sf, "lineitem"))


@query("null_counts", f"SELECT count(*) FILTER (WHERE price IS NULL) AS price_nulls,"
       f" count(*) FILTER (WHERE status IS NOT NULL) AS status_filled FROM ({NULLS})")
def null_counts(spark, sf):
    holes = table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status")
    return holes.agg(F.count_if(F.col("price").isNull()).alias("price_nulls"),
                     F.count_if(F.col("status").isNotNull()).alias("status_filled"))


@query("column_means", "SELECT 'l_quantity' AS \"column\", round(avg(l_quantity), 4) AS mean FROM lineitem"
       " UNION ALL SELECT 'l_extendedprice', round(avg(l_extendedprice), 4) FROM lineitem"
       " UNION ALL SELECT 'l_discount', round(avg(l_discount), 4) FROM lineitem"
       " UNION ALL SELECT 'l_tax', round(avg(l_tax), 4) FROM lineitem")
def column_means(spark, sf):
    stats = A.column_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return stats.select("column", F.round("mean", 4).alias("mean"))


@query("std_estimates", "SELECT 'l_quantity' AS \"column\", (max(l_quantity) - min(l_quantity)) / 4 AS std_estimate FROM lineitem"
       " UNION ALL SELECT 'l_extendedprice', (max(l_extendedprice) - min(l_extendedprice)) / 4 FROM lineitem"
       " UNION ALL SELECT 'l_orderkey', (max(l_orderkey) - min(l_orderkey)) / 4.0::DOUBLE FROM lineitem")
def std_estimates(spark, sf):
    return A.std_estimate(A.column_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_orderkey"]))


@query("risk_columns", f"SELECT \"column\", null_rate > 0.10 AS high_null,"
       f" coalesce(max_value - min_value, 0) > 1000 AND mean IS NOT NULL AS wide_range FROM ("
       + profile_sql(f"({NULLS})", {"o_orderkey": "BIGINT", "price": "DOUBLE", "status": "STRING"})
       + ") WHERE null_rate > 0.10 OR (mean IS NOT NULL AND coalesce(max_value - min_value, 0) > 1000)")
def risk_columns(spark, sf):
    holes = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderstatus END AS status")
    return A.risk_columns(A.profile(holes))


@query("first_rows", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def first_rows(spark, sf):
    return S.first_rows(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 5)


@query("tail_rows", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 700")
def tail_rows(spark, sf):
    return S.last_rows(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 700)


@query("sample_hash", "SELECT * FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 2000")
def sample_hash(spark, sf):
    return S.hash_sample(table(spark, sf, "orders"), ["o_orderkey"], 2000, 42)


_ORDER_TEXT = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|42'"


@query("sample_three_bucket",
       "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) SELECT DISTINCT * FROM ("
       " (SELECT * FROM t ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 666) UNION ALL"
       " (SELECT * FROM t ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 666) UNION ALL"
       f" (SELECT * FROM t ORDER BY md5({_ORDER_TEXT}), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 668))")
def sample_three_bucket(spark, sf):
    keys = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return S.three_bucket_sample(keys, keys.columns, 2000, 42)


_PRICE = ("CASE WHEN o_orderkey % 10 = 0 THEN concat('£', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {s}))"
          " ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {s}) END")
_FLAG = "CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' WHEN o_orderkey % 3 = 1 THEN 'no' ELSE '0' END"
_BLANK = "CASE WHEN o_orderkey % 2 = 0 THEN ' ' END"
_DATED = "CASE WHEN o_orderkey % 2 = 0 THEN {iso} WHEN o_orderkey % 8 = 1 THEN 'soon' ELSE {dmy} END"


def _dirty_orders(spark, sf):
    date = _DATED.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", dmy="date_format(o_orderdate, 'dd/MM/yyyy')")
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", f"{_PRICE.format(s='STRING')} AS unit_price", f"{date} AS order_date", f"{_FLAG} AS is_paid",
        f"{_BLANK} AS note", "o_orderpriority", "o_orderdate")


_DIRTY_SQL = (
    f"SELECT o_orderkey, {_PRICE.format(s='VARCHAR')} AS unit_price, "
    + _DATED.format(iso="strftime(o_orderdate, '%Y-%m-%d')", dmy="strftime(o_orderdate, '%d/%m/%Y')")
    + f" AS order_date, {_FLAG} AS is_paid, {_BLANK} AS note, o_orderpriority, o_orderdate FROM orders")


def _infer_sql(source: str, text_columns: list[str], native: dict[str, str]) -> str:
    parts = []
    for c in text_columns:
        v = f"trim({c})"
        number = rf"regexp_matches(lower(replace(ltrim({v}, '£$€¥ '), ',', '')), '^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$')"
        formats = {"YYYY-MM-DD": r"^\d{4}-\d{2}-\d{2}$", "DD/MM/YYYY": r"^\d{2}/\d{2}/\d{4}$",
                   "DD-MM-YYYY": r"^\d{2}-\d{2}-\d{4}$", "DDMMYYYY": r"^\d{8}$", "unix_epoch": r"^\d{10}$"}
        label = "CASE " + " ".join(f"WHEN regexp_matches({v}, '{p}') THEN '{f}'" for f, p in formats.items()) + " END"
        parts.append(
            f"SELECT '{c}' AS \"column\", 'STRING' AS original_type, count(*) FILTER (WHERE {c} IS NULL) > 0 AS nullable,"
            f" count(*) FILTER (WHERE {v} <> '') AS n, count(*) FILTER (WHERE {v} <> '' AND {number}) AS num,"
            f" count({label}) AS dat, coalesce(bool_and(CASE WHEN {v} <> '' THEN lower({v}) IN"
            " ('0','1','true','false','yes','no','t','f') END), false) AS boo,"
            f" array_to_string(list_sort(list(DISTINCT {label})), ',') AS formats FROM {source}")
    text = (
        "SELECT \"column\", CASE WHEN n = 0 THEN 'STRING' WHEN num / n >= 0.9 THEN 'DOUBLE' WHEN dat / n >= 0.7 THEN 'DATE'"
        " WHEN boo THEN 'BOOLEAN' ELSE original_type END AS inferred_type, original_type,"
        " n > 0 AND (num / n >= 0.9 OR dat / n >= 0.7 OR boo) AS needs_cast,"
        " CASE WHEN n = 0 THEN NULL WHEN num / n >= 0.9 THEN 'strip_currency_prefix_and_cast_float'"
        " WHEN dat / n >= 0.7 THEN 'parse_mixed_dates' WHEN boo THEN 'normalise_boolean' END AS suggested_cast, nullable,"
        " CASE WHEN n > 0 AND num / n < 0.9 AND dat / n >= 0.7 THEN formats END AS detected_formats FROM ("
        + " UNION ALL ".join(parts) + ")")
    same = [f"SELECT '{c}', '{k}', '{k}', false, NULL, count(*) FILTER (WHERE {c} IS NULL) > 0, NULL FROM {source}"
            for c, k in native.items()]
    return " UNION ALL ".join([text, *same])


def _flat_schema(schema):
    return schema.withColumn("detected_formats", F.array_join(F.array_sort("detected_formats"), ","))


@query("infer_schema_orders", _infer_sql(f"({_DIRTY_SQL})", ["unit_price", "order_date", "is_paid", "note", "o_orderpriority"],
                                         {"o_orderkey": "BIGINT", "o_orderdate": "TIMESTAMP_NTZ"}))
def infer_schema_orders(spark, sf):
    return _flat_schema(infer.infer_schema(_dirty_orders(spark, sf)))


_LINE_TEXT = ("concat('£', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {s})) AS price,"
              " CAST(l_linenumber AS {s}) AS line, l_returnflag, l_linestatus, {d} AS ship_date")


@query("infer_schema_lineitem", _infer_sql(
    "(SELECT " + _LINE_TEXT.format(s="VARCHAR", d="strftime(l_shipdate, '%d-%m-%Y')") + " FROM lineitem)",
    ["price", "line", "l_returnflag", "l_linestatus", "ship_date"], {}))
def infer_schema_lineitem(spark, sf):
    text = _LINE_TEXT.format(s="STRING", d="date_format(l_shipdate, 'dd-MM-yyyy')")
    return _flat_schema(infer.infer_schema(table(spark, sf, "lineitem").selectExpr(*_split(text))))


def _split(items: str) -> list[str]:
    """Top-level commas of a select list."""
    parts, depth, current = [], 0, ""
    for ch in items:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [*parts, current]


def _orders_schema(spark, sf):
    return infer.infer_schema(_dirty_orders(spark, sf)).select("column", F.col("inferred_type").alias("type"))


def _changed_schema(spark, sf):
    later = _dirty_orders(spark, sf).drop("note").withColumn("is_paid", F.col("is_paid") == "Yes").withColumn(
        "unit_price", F.concat(F.lit("about "), "unit_price")).withColumn("channel", F.lit("web"))
    return infer.infer_schema(later).select("column", F.col("inferred_type").alias("type"))


@query("schema_drift",
       "WITH n AS (SELECT count(*) AS rows FROM orders)"
       " SELECT 'unit_price' AS \"column\", 'type_change' AS change, 'DOUBLE' AS prior_type, 'STRING' AS current_type FROM n WHERE rows > 0"
       " UNION ALL SELECT 'note', 'dropped', 'STRING', NULL FROM n WHERE rows > 0"
       " UNION ALL SELECT 'channel', 'added', NULL, 'STRING' FROM n WHERE rows > 0")
def schema_drift(spark, sf):
    return D.compare_schemas(_orders_schema(spark, sf), _changed_schema(spark, sf))


@query("drift_severity", "SELECT 1::BIGINT AS added, 1::BIGINT AS dropped, 1::BIGINT AS type_changes,"
       " 'critical' AS drift_severity, true AS has_drift, false AS no_prior_run FROM orders LIMIT 1")
def drift_severity(spark, sf):
    return D.drift_summary(D.compare_schemas(_orders_schema(spark, sf), _changed_schema(spark, sf)))


@query("column_sets", "WITH a AS (SELECT DISTINCT c_mktsegment AS \"column\" FROM customer WHERE c_nationkey < 12),"
       " b AS (SELECT DISTINCT c_name AS \"column\" FROM customer WHERE c_acctbal > 0 UNION SELECT DISTINCT c_mktsegment FROM customer)"
       " SELECT \"column\", 'both' AS side FROM a WHERE \"column\" IN (SELECT \"column\" FROM b)"
       " UNION ALL SELECT \"column\", 'left' FROM a WHERE \"column\" NOT IN (SELECT \"column\" FROM b)"
       " UNION ALL SELECT \"column\", 'right' FROM b WHERE \"column\" NOT IN (SELECT \"column\" FROM a)")
def column_sets(spark, sf):
    customer = table(spark, sf, "customer")
    left = customer.where("c_nationkey < 12").select(F.col("c_mktsegment").alias("column"))
    right = customer.where("c_acctbal > 0").select(F.col("c_name").alias("column")).union(customer.select("c_mktsegment"))
    return rows.column_sets(left, right)


@query("latest_schema",
       "SELECT CAST(o_custkey AS VARCHAR) AS source_path, arg_max(o_orderstatus || o_orderpriority, (o_orderdate, o_orderkey)) AS schema"
       " FROM orders GROUP BY o_custkey")
def latest_schema(spark, sf):
    entries = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("source_path"),
        F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("schema"),
        F.struct("o_orderdate", "o_orderkey").alias("created_at"))
    return D.latest_schema(entries).select(
        "source_path", F.concat(F.col("schema")["status"], F.col("schema")["priority"]).alias("schema"))


def _shape(c: str) -> str:
    return f"regexp_replace({c}, '[a-zA-Z]', 'A', 'g')"


def _patterns_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", rank, pattern, n FROM (SELECT {_shape(c)} AS pattern, count(*) AS n,"
        f" row_number() OVER (ORDER BY count(*) DESC, {_shape(c)}) AS rank FROM {source}"
        f" WHERE {c} IS NOT NULL GROUP BY 1) WHERE rank <= 3" for c in columns)


@query("string_patterns", _patterns_sql("part", ["p_name", "p_brand", "p_type"])
       + " UNION ALL " + _patterns_sql("supplier", ["s_name"]))
def string_patterns(spark, sf):
    return N.common_patterns(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"]).unionByName(
        N.common_patterns(table(spark, sf, "supplier"), ["s_name"]))


@query("text_patterns", _patterns_sql("conversations", ["role", "text"]) + " UNION ALL " + _patterns_sql("documents", ["text", "lang", "source"]).replace("'text' AS", "'document' AS"))
def text_patterns(spark, sf):
    turns, documents = table(spark, sf, "conversations"), table(spark, sf, "documents").withColumnRenamed("text", "document")
    return N.common_patterns(turns, string_columns(turns)).unionByName(N.common_patterns(documents, string_columns(documents)))
