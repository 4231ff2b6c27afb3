"""Queries: cleaning transforms, their SQL form, lineage, casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import infer, lineage as L, rows, transforms as TR
from tablewright.operators.incremental import observe_rows
from tablewright.plans.queries_quality import FIRST_LINES, KEY, LINE_ORDER
from tablewright.plans.registry import query, table
from tablewright.rules import COUNTRY_VARIANTS, FUEL_VARIANTS
from tablewright.session import scratch_path

_MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {s})"
_PRICE = ("CASE WHEN o_orderkey % 10 = 0 THEN concat('£', " + _MONEY + ") WHEN o_orderkey % 10 = 1 THEN concat('$ 1,', " + _MONEY + ")"
          " WHEN o_orderkey % 10 = 2 THEN 'n/a' WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 10 = 4 THEN concat('-', " + _MONEY + ")"
          " WHEN o_orderkey % 10 = 5 THEN '1e3' WHEN o_orderkey % 10 = 6 THEN concat(" + _MONEY + ", 'd') ELSE " + _MONEY + " END")
_NUMBER_SQL = ("CASE WHEN regexp_matches(lower(replace(ltrim(unit_price, '£$€¥ '), ',', '')), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?$')"
               " THEN CAST(replace(ltrim(unit_price, '£$€¥ '), ',', '') AS DOUBLE) END")
_PRICES_SQL = f"SELECT o_orderkey, {_PRICE.format(s='VARCHAR')} AS unit_price FROM orders"


def _prices(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{_PRICE.format(s='STRING')} AS unit_price")


@query("strip_currency", f"SELECT o_orderkey, {_NUMBER_SQL} AS unit_price FROM ({_PRICES_SQL})")
def strip_currency(spark, sf):
    return TR.apply_transform(_prices(spark, sf), "strip_currency_symbols")


@query("convert_currency", f"SELECT o_orderkey, round({_NUMBER_SQL} * 1.27::DOUBLE, 6) AS unit_price_usd FROM ({_PRICES_SQL})")
def convert_currency(spark, sf):
    usd = TR.apply_transform(_prices(spark, sf), "convert_currency", rename={"unit_price": "unit_price_usd"})
    return usd.withColumn("unit_price_usd", F.round("unit_price_usd", 6))


@query("convert_by_rates", "SELECT o_orderkey, round(o_totalprice * rate, 6) AS o_totalprice FROM orders LEFT JOIN"
       " (SELECT o_orderstatus AS s, count(*) / 1000.0::DOUBLE AS rate FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON s = o_orderstatus")
def convert_by_rates(spark, sf):
    orders = table(spark, sf, "orders")
    rates = orders.where("o_orderstatus <> 'P'").groupBy(F.lower("o_orderstatus").alias("currency")).agg(
        (F.count(F.lit(1)) / 1000.0).alias("rate"))
    done = TR.convert_by_rates(orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), rates, ["o_totalprice"], "o_orderstatus")
    return done.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query("parse_failures", f"SELECT 'unit_price' AS \"column\", count(*) FILTER (WHERE unit_price IS NOT NULL AND ({_NUMBER_SQL}) IS NULL)"
       f" AS parse_failures FROM ({_PRICES_SQL})")
def parse_failures(spark, sf):
    return TR.parse_failures(_prices(spark, sf), "strip_currency_symbols")


def _dates(iso: str, dmy: str, dashed: str, packed: str, epoch: str, short: str, text: str) -> str:
    return (f"CASE o_orderkey % 8 WHEN 0 THEN {iso} WHEN 1 THEN {dmy} WHEN 2 THEN {dashed} WHEN 3 THEN {packed}"
            f" WHEN 4 THEN {epoch} WHEN 5 THEN {short} WHEN 6 THEN '31/02/1999' ELSE NULL END AS order_date")


@query("standardise_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 >= 6 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date FROM orders")
def standardise_dates(spark, sf):
    text = _dates("date_format(o_orderdate, 'yyyy-MM-dd')", "date_format(o_orderdate, 'dd/MM/yyyy')",
                  "date_format(o_orderdate, 'dd-MM-yyyy')", "date_format(o_orderdate, 'ddMMyyyy')",
                  # Ten digits only since September 2001; earlier dates keep a spelling of their own.
                  "date_format(o_orderdate, 'd-M-yyyy')", "date_format(o_orderdate, 'd/M/yyyy')", "")
    return TR.apply_transform(table(spark, sf, "orders").selectExpr("o_orderkey", text), "standardise_dates")


@query("standardise_epochs", "SELECT event_id, CAST(ts AS DATE) AS event_time, CAST(ts AS DATE) AS native_time FROM events")
def standardise_epochs(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string").alias("event_time"), F.col("ts").alias("native_time"))
    return TR.apply_transform(events, "standardise_dates")


@query("dedup_keep_first", FIRST_LINES)
def dedup_keep_first(spark, sf):
    return TR.apply_transform(table(spark, sf, "lineitem"), "dedup_by_id", KEY, order=LINE_ORDER)


@query("dedup_rows", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def dedup_rows(spark, sf):
    return TR.apply_transform(table(spark, sf, "lineitem").select(*KEY, "l_returnflag"), "dedup_rows")


@query("latest_per_key", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, sf):
    return rows.latest_per_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])


@query("flag_negative", "SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN NULL ELSE c_acctbal END AS quantity,"
       " coalesce(CASE WHEN c_nationkey = 7 THEN NULL ELSE c_acctbal END < 0, false) AS is_return FROM customer")
def flag_negative(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_nationkey = 7 THEN NULL ELSE c_acctbal END AS quantity")
    return TR.apply_transform(df, "flag_negative_quantity")


@query("fill_unknown", "SELECT turn, coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE role END, 'unknown') AS role, text FROM conversations")
def fill_unknown(spark, sf):
    df = table(spark, sf, "conversations").selectExpr("turn", "CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS role", "text")
    return TR.apply_transform(df, "fill_null_strings")


_PHONE = ("CASE c_custkey % 6 WHEN 0 THEN concat('(0', 1000000000 + c_custkey, ')') WHEN 1 THEN concat('+44 ', 2000000000 + c_custkey)"
          " WHEN 2 THEN concat('555-', c_custkey) WHEN 3 THEN 'none' WHEN 4 THEN NULL ELSE concat('0', 30000000 + c_custkey) END AS phone")


@query("normalise_phone",
       f"WITH p AS (SELECT c_custkey, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM (SELECT c_custkey, {_PHONE} FROM customer))"
       " SELECT c_custkey, CASE WHEN d LIKE '0%' AND length(d) = 11 THEN '+44' || substr(d, 2) WHEN d LIKE '44%' AND length(d) = 12"
       " THEN '+' || d WHEN d = '' THEN NULL ELSE d END AS phone FROM p")
def normalise_phone(spark, sf):
    return TR.apply_transform(table(spark, sf, "customer").selectExpr("c_custkey", _PHONE), "normalise_phone")


def _title_sql(c: str) -> str:
    return (f"list_reduce(list_transform(regexp_extract_all({c}, '\\p{{L}}+|\\P{{L}}+'), lambda w:"
            " CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), lambda a, b: a || b)")


_NAMES = {"part": "p_name", "nation": "n_name", "supplier": "s_name"}
_SPELT = "concat({c}, '-o''NEIL 3rd')"


@query("title_case", " UNION ALL ".join(
    f"SELECT {_title_sql(_SPELT.format(c=c))} AS full_name, {_title_sql(c)} AS short_name FROM {t}" for t, c in _NAMES.items()))
def title_case(spark, sf):
    frames = [TR.apply_transform(
        table(spark, sf, t).select(F.concat(F.col(c), F.lit("-o'NEIL 3rd")).alias("full_name"), F.col(c).alias("short_name")),
        "title_case") for t, c in _NAMES.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("title_case_texts", f"SELECT conv_id, turn, {_title_sql('text')} AS title FROM conversations")
def title_case_texts(spark, sf):
    return TR.apply_transform(table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("title")), "title_case")


_COUNTRY = ("CASE p_size % 8 WHEN 0 THEN 'uk' WHEN 1 THEN ' United Kingdom ' WHEN 2 THEN 'GERMANY' WHEN 3 THEN 'deutschland' WHEN 4 THEN"
            " 'The Netherlands' WHEN 5 THEN 'Spain' WHEN 6 THEN NULL ELSE 'SWEDEN' END AS country")


def _canonical_sql(c: str, variants: dict, default: str) -> str:
    whens = " ".join(
        "WHEN lower(trim({c})) IN ({v}) THEN '{k}'".format(c=c, k=k, v=", ".join(f"'{x}'" for x in sorted({s.lower() for s in vs})))
        for k, vs in variants.items())
    return f"CASE {whens} ELSE {default} END"


@query("normalise_country", f"SELECT p_partkey, {_canonical_sql('country', COUNTRY_VARIANTS, 'country')} AS country FROM (SELECT p_partkey, {_COUNTRY} FROM part)")
def normalise_country(spark, sf):
    return TR.apply_transform(table(spark, sf, "part").selectExpr("p_partkey", _COUNTRY), "normalise_country")


_FUEL = "CASE p_size % 5 WHEN 0 THEN ' Gasoline' WHEN 1 THEN 'DIESEL' WHEN 2 THEN 'EV' WHEN 3 THEN 'Hydrogen ' ELSE NULL END AS fuel"


@query("normalise_fuel_type", f"SELECT p_partkey, {_canonical_sql('fuel', FUEL_VARIANTS, 'lower(trim(fuel))')} AS fuel FROM (SELECT p_partkey, {_FUEL} FROM part)")
def normalise_fuel_type(spark, sf):
    return TR.apply_transform(table(spark, sf, "part").selectExpr("p_partkey", _FUEL), "normalise_fuel_type")


_FLAGS = ("CASE o_orderkey % 9 WHEN 0 THEN 'TRUE' WHEN 1 THEN '0' WHEN 2 THEN ' yes ' WHEN 3 THEN 'No' WHEN 4 THEN 't' WHEN 5 THEN 'F'"
          " WHEN 6 THEN 'maybe' WHEN 7 THEN NULL ELSE '1' END AS is_paid")


@query("normalise_boolean", f"SELECT o_orderkey, CASE WHEN lower(trim(is_paid)) IN ('1','true','yes','t') THEN true"
       f" WHEN lower(trim(is_paid)) IN ('0','false','no','f') THEN false END AS is_paid FROM (SELECT o_orderkey, {_FLAGS} FROM orders)")
def normalise_boolean(spark, sf):
    return TR.apply_transform(table(spark, sf, "orders").selectExpr("o_orderkey", _FLAGS), "normalise_boolean")


_CODES = ["p_partkey", "concat(' wvw', lower(p_brand)) AS vin", "concat(lower(p_type), ' ') AS registration_plate",
          "concat('a', p_size, '.1 ') AS icd"]


@query("uppercase_codes", "SELECT p_partkey, upper(trim(vin)) AS vin, upper(trim(registration_plate)) AS registration_plate,"
       f" upper(trim(icd)) AS icd FROM (SELECT {', '.join(_CODES)} FROM part)")
def uppercase_codes(spark, sf):
    df = table(spark, sf, "part").selectExpr(*_CODES)
    for name in ("uppercase_vin", "uppercase_registration", "uppercase_icd"):
        df = TR.apply_transform(df, name)
    return df


@query("normalise_department", "SELECT c_custkey, list_reduce(list_transform(string_split(regexp_replace(trim(department), '\\s+', ' ', 'g'), ' '),"
       " lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b) AS department FROM"
       " (SELECT c_custkey, concat('  ', lower(c_mktsegment), '   TEAM ') AS department FROM customer)")
def normalise_department(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", "concat('  ', lower(c_mktsegment), '   TEAM ') AS department")
    return TR.apply_transform(df, "normalise_department")


_DIRTY = ["o_orderkey", _PRICE.format(s="STRING").replace("'n/a'", "'£5'").replace(", 'd')", ", '0')") + " AS unit_price",
          "date_format(o_orderdate, 'dd/MM/yyyy') AS order_date",
          "CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS is_paid", "o_orderpriority AS priority"]


@query("apply_casts",
       "SELECT o_orderkey, CAST(CASE o_orderkey % 10 WHEN 1 THEN '1' || m WHEN 2 THEN '5' WHEN 3 THEN NULL WHEN 4 THEN '-' || m WHEN 5 THEN '1e3'"
       " WHEN 6 THEN m || '0' ELSE m END AS DOUBLE) AS unit_price, CAST(o_orderdate AS DATE) AS order_date, o_orderkey % 2 = 0 AS is_paid,"
       " o_orderpriority AS priority FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS m FROM orders)")
def apply_casts(spark, sf):
    df = table(spark, sf, "orders").selectExpr(*_DIRTY)
    return TR.apply_casts(df, infer.infer_schema(df))


def _line_plan() -> TR.TransformPlan:
    return TR.TransformPlan([
        TR.Step("strip_currency_symbols_from_price_columns"),
        TR.Step("standardise_dates_to_iso8601"),
        TR.Step("flag_negative_quantities_as_returns"),
        TR.Step("normalise_country_names"),
        TR.Step("dedup_by_id", ("order_id", "line"), {"order": ("ship_date", "part", "supplier", "unit_price", "quantity", "country")}),
    ])


_LINES = ["l_orderkey AS order_id", "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supplier",
          "l_quantity - 3 AS quantity", "concat('£', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) AS unit_price",
          "date_format(l_shipdate, 'dd/MM/yyyy') AS ship_date",
          "CASE l_returnflag WHEN 'A' THEN 'uk' WHEN 'N' THEN 'Deutschland' ELSE l_returnflag END AS country"]
_PREPARED_SQL = (
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line ORDER BY ship_date, part, supplier, unit_price,"
    " quantity, country) AS rn FROM (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,"
    " l_quantity - 3 AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS unit_price, CAST(l_shipdate AS DATE) AS ship_date,"
    " CASE l_returnflag WHEN 'A' THEN 'UK' WHEN 'N' THEN 'Germany' ELSE l_returnflag END AS country, l_quantity - 3 < 0 AS is_return"
    " FROM lineitem)) WHERE rn = 1")


@query("prepared_lines", _PREPARED_SQL)
def prepared_lines(spark, sf):
    plan = _line_plan()
    plan.check("retail")
    return plan.apply(table(spark, sf, "lineitem").selectExpr(*_LINES))


@query("sql_form", _PREPARED_SQL)
def sql_form(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(*_LINES)
    lines.createOrReplaceTempView("prepared_source")
    return spark.sql(_line_plan().to_sql(lines, "prepared_source"))


@query("lineage_edges",
       f"WITH p AS (SELECT count(*) AS kept, (SELECT count(*) FROM lineitem) AS total FROM ({_PREPARED_SQL}))"
       " SELECT source_column, target_column, transformation, total AS rows_in, kept AS rows_out FROM p, (VALUES"
       " ('order_id', 'order_id', 'dedup_by_id'), ('line', 'line', 'dedup_by_id'), ('part', 'part', 'passthrough'),"
       " ('supplier', 'supplier', 'passthrough'), ('quantity', 'quantity', 'passthrough'), ('quantity', 'is_return', 'flag_negative_quantity'),"
       " ('unit_price', 'unit_price', 'strip_currency_symbols'), ('ship_date', 'ship_date', 'standardise_dates'),"
       " ('country', 'country', 'normalise_country')) AS e(source_column, target_column, transformation)")
def lineage_edges(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(*_LINES)
    plan = _line_plan()
    before, after = lines.count(), plan.apply(lines).count()
    return L.lineage_edges(plan, lines, "run").select(
        "source_column", "target_column", "transformation", F.lit(before).cast("long").alias("rows_in"),
        F.lit(after).cast("long").alias("rows_out"))


_PARENTS_SQL = ("SELECT 'region.' || n_regionkey AS source, 'nation.' || n_nationkey AS target FROM nation UNION ALL"
                " SELECT 'nation.' || c_nationkey, 'customer.' || c_custkey FROM customer UNION ALL"
                " SELECT 'customer.' || o_custkey, 'order.' || o_orderkey FROM orders")


def _parents(spark, sf):
    def edge(t, kind, parent, child_kind, child):
        return table(spark, sf, t).select(L.node(F.lit(kind), F.col(parent).cast("string")).alias("source"),
                                          L.node(F.lit(child_kind), F.col(child).cast("string")).alias("target"))
    return edge("nation", "region", "n_regionkey", "nation", "n_nationkey").unionByName(
        edge("customer", "nation", "c_nationkey", "customer", "c_custkey")).unionByName(
        edge("orders", "customer", "o_custkey", "order", "o_orderkey"))


@query("lineage_downstream", f"WITH RECURSIVE e AS ({_PARENTS_SQL}), t AS (SELECT 'region.0' AS node, 0 AS depth UNION"
       " SELECT e.target, t.depth + 1 FROM t JOIN e ON e.source = t.node) SELECT node, depth FROM t")
def lineage_downstream(spark, sf):
    start = table(spark, sf, "region").where("r_regionkey = 0").select(L.node(F.lit("region"), F.col("r_regionkey").cast("string")).alias("node"))
    return L.trace(_parents(spark, sf), start)


@query("lineage_upstream", f"WITH RECURSIVE e AS ({_PARENTS_SQL}), t AS (SELECT 'order.' || o_orderkey AS node, 0 AS depth FROM orders"
       " WHERE o_totalprice > 300000 UNION SELECT e.source, t.depth + 1 FROM t JOIN e ON e.target = t.node) SELECT node, depth FROM t")
def lineage_upstream(spark, sf):
    start = table(spark, sf, "orders").where("o_totalprice > 300000").select(
        L.node(F.lit("order"), F.col("o_orderkey").cast("string")).alias("node"))
    return L.trace(_parents(spark, sf), start, "up")


@query("transform_counters", f"SELECT (SELECT count(*) FROM lineitem) AS rows_input, (SELECT count(*) FROM ({FIRST_LINES})) AS rows_output")
def transform_counters(spark, sf):
    source, rows_in = observe_rows(table(spark, sf, "lineitem"), "rows_in")
    target, rows_out = observe_rows(TR.apply_transform(source, "dedup_by_id", KEY, order=LINE_ORDER), "rows_out")
    target.write.parquet(scratch_path(spark, "counted"))
    return spark.createDataFrame([(rows_in.get["rows"], rows_out.get["rows"])], "rows_input long, rows_output long")


@query("safe_casts", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT) AS code,"
       " coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status FROM orders")
def safe_casts(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string")).try_cast("bigint").alias("code"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("pending")).alias("status"))


@query("columns_by_keyword", "SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus, o_orderpriority FROM orders")
def columns_by_keyword(spark, sf):
    from tablewright.functions.columns import name_contains, string_columns
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", *name_contains(orders, "price", "date"), *[
        c for c in string_columns(orders) if c not in name_contains(orders, "price", "date")])


def _check_digit(keys, modulus=97):
    """Two check digits of each whole number, as ISO 7064 has them for a modulus of 97."""
    import numpy as np
    import pyarrow as pa

    values = keys.to_numpy(zero_copy_only=False).astype(np.int64)
    digits = modulus + 1 - (values % modulus) * 100 % modulus
    return [pa.array(digits), pa.array([f"{v}-{d:02d}" for v, d in zip(values.tolist(), digits.tolist())])]


@query("registered_transform", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, 98 - (l_partkey % 97) * 100 % 97 AS check_digits,"
       " l_partkey || '-' || lpad(CAST(98 - (l_partkey % 97) * 100 % 97 AS VARCHAR), 2, '0') AS checked_key FROM lineitem")
def registered_transform(spark, sf):
    TR.register_arrow_transform("check_digits", _check_digit, ["l_partkey"], "check_digits BIGINT, checked_key STRING")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return TR.apply_transform(lines, "check_digits")
