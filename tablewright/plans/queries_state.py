"""Queries: sources, publishing, run log, increments, streams, domains, catalogue, library."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tablewright.functions.vectors import mean_vectors, nearest
from tablewright.operators import (
    anomalies as N, catalogue as K, checks as Q, column_tests as CT, constraints as V, domain as M, drift as D, incremental as I,
    infer, profile as A, report as RP, runlog as RL)
from tablewright.operators.transforms import Step
from tablewright.plans.preparation import Preparation, State, prepare
from tablewright.plans.registry import query, table
from tablewright.rules import DOMAIN_KEYWORDS, DOMAIN_RULES
from tablewright.session import scratch_path
from tablewright.sources import files, publish, records
from tablewright.streaming import gate as G, ingest as ST

# --- sources and sinks --------------------------------------------------------


@query("csv_scan", "SELECT o_orderkey::INT AS o_orderkey, o_custkey::INT AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "orders").write.option("header", "true").option("sep", ";").option("compression", "gzip").csv(path)
    read = files.read_csv(spark, path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSS")
    return read.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("parquet_scan", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def parquet_scan(spark, sf):
    lines = files.read_file_source(spark, f"{sf}/lineitem.parquet")
    return lines.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "l_orderkey", "l_linenumber", "l_extendedprice")


@query("delimiters", "SELECT DISTINCT CASE event_type WHEN 'click' THEN ';' WHEN 'view' THEN '|' WHEN 'error' THEN chr(9) ELSE ',' END AS delimiter FROM events")
def delimiters(spark, sf):
    root = scratch_path(spark, "delimited")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    for kind, sep in (("click", ";"), ("view", "|"), ("error", "\t"), ("signup", ","), ("purchase", ",")):
        events.where(F.col("event_type") == kind).drop("event_type").write.option("header", "true").option(
            "sep", sep).csv(f"{root}/{kind}")
    return files.detect_delimiters(spark, root, "*.csv").select("delimiter").distinct()


@query("envelope_unwrap",
       "SELECT event_id, k, twice FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, unnest([1, 2])::BIGINT AS twice FROM events)")
def envelope_unwrap(spark, sf):
    # One landed document per event, its two records below one of the envelope keys.
    key = F.get(F.array(*[F.lit(k) for k in ("data", "results", "items", "records", "rows")]),
                (F.col("event_id") % 5).cast("int"))
    document = F.format_string(
        '{"%s": [{"event_id": %d, "k": %d, "twice": 1}, {"event_id": %d, "k": %d, "twice": 2}], "page": %d}',
        key, "event_id", "k", "event_id", "k", "event_id")
    path = scratch_path(spark, "landed")
    table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).select(
        document.alias("value")).write.text(path)
    return records.unwrap(records.read_documents(spark, path, multi_line=False)).select("event_id", "k", "twice")


@query("envelope_pagination", "SELECT event_id AS page FROM events")
def envelope_pagination(spark, sf):
    item = F.to_json(F.struct(F.array(F.struct("event_id", "value")).alias("items"), F.col("event_id").alias("page")))
    path = scratch_path(spark, "paged")
    table(spark, sf, "events").select(item.alias("value")).write.text(path)
    return records.pagination(records.read_documents(spark, path, multi_line=False)).select("info.page")


@query("envelope_text", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def envelope_text(spark, sf):
    wrapped = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"rows": ['), "props", F.lit("]}")).alias("body"))
    return records.unwrap_text(wrapped, "body", "k BIGINT", ["event_id"])


@query("events_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def events_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("dataset_metadata", "SELECT column_name AS \"column\", (SELECT count(*) FROM orders) AS row_count FROM (VALUES"
       " ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) AS c(column_name)")
def dataset_metadata(spark, sf):
    meta = files.metadata(table(spark, sf, "orders"), f"{sf}/orders.parquet")
    return spark.createDataFrame([(c, meta["row_count"]) for c in meta["column_names"]], "column string, row_count long")


@query("write_readback", "SELECT count(*) AS row_count, 11::BIGINT AS column_count FROM lineitem")
def write_readback(spark, sf):
    written = publish.write_dataset(table(spark, sf, "lineitem"), scratch_path(spark, "written"))
    return spark.createDataFrame([(written["row_count"], len(written["columns"]))], "row_count long, column_count long")


@query("staged_publish", "SELECT * FROM customer")
def staged_publish(spark, sf):
    root = scratch_path(spark, "publish")
    customer = table(spark, sf, "customer")
    total = customer.count()
    publish.staged_publish(customer, f"{root}/staging", f"{root}/final", lambda written: written.count() == total)
    return spark.read.parquet(f"{root}/final")


_PRINT = "concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)"


@query("fingerprint", f"WITH h AS (SELECT ('0x' || substr(md5({_PRINT}), 1, 15))::BIGINT AS code FROM orders)"
       " SELECT count(*) AS row_count, bit_xor(code) AS hash_xor, CAST(sum(code % 1000003) AS BIGINT) AS hash_sum FROM h")
def fingerprint(spark, sf):
    return publish.fingerprint(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], portable=True)


# --- run log: orders read as runs of their customers' sources -------------------

_RUNS = ("SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_custkey AS VARCHAR) AS run_key, 'src-' || (o_custkey % 100) AS source_path,"
         " CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'retrying' ELSE 'failed' END AS status,"
         " CAST(o_orderkey % 5 AS INT) AS retry_count, o_custkey AS rows_output, o_orderstatus = 'F' AS quality_passed,"
         " CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS watermark_value, o_orderdate AS completed_at FROM orders")


def _runs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_custkey").cast("string").alias("run_key"),
        F.concat(F.lit("src-"), F.col("o_custkey") % 100).alias("source_path"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "retrying").otherwise("failed").alias("status"),
        (F.col("o_orderkey") % 5).cast("int").alias("retry_count"), F.col("o_custkey").alias("rows_output"),
        (F.col("o_orderstatus") == "F").alias("quality_passed"), F.lit("o_orderdate").alias("watermark_column"),
        F.when(F.col("o_orderkey") % 4 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("watermark_value"),
        F.col("o_orderdate").alias("completed_at"), F.col("o_orderdate").alias("started_at"))


@query("latest_success", f"SELECT run_key, run_id, rows_output FROM (SELECT *, row_number() OVER (PARTITION BY run_key"
       f" ORDER BY completed_at DESC, run_id DESC) AS rn FROM ({_RUNS}) WHERE status = 'success') WHERE rn = 1")
def latest_success(spark, sf):
    return RL.latest_success(_runs(spark, sf)).select("run_key", "run_id", "rows_output")


@query("run_history", f"SELECT run_id, status, completed_at FROM ({_RUNS}) ORDER BY completed_at DESC, run_id DESC LIMIT 30")
def run_history(spark, sf):
    return RL.run_history(_runs(spark, sf)).select("run_id", "status", "completed_at")


@query("run_states", "SELECT CAST(l_orderkey AS VARCHAR) AS run_id, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS status,"
       " arg_max(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) FILTER (WHERE l_returnflag <> 'N') AS rows_output"
       " FROM lineitem GROUP BY l_orderkey")
def run_states(spark, sf):
    events = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linestatus").alias("status"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("rows_output"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("event_time"))
    return RL.current_runs(events).drop("event_time")


@query("last_watermarks", f"SELECT source_path, arg_max(watermark_value, (completed_at, run_id)) AS watermark_value FROM ({_RUNS})"
       " WHERE status = 'success' AND watermark_value IS NOT NULL GROUP BY source_path")
def last_watermarks(spark, sf):
    return RL.last_watermarks(_runs(spark, sf)).drop("watermark_column")


@query("run_outcomes", f"SELECT run_id, CASE WHEN status = 'success' THEN 'publish' WHEN status = 'retrying' AND retry_count < 3 THEN 'retry'"
       f" ELSE 'failed' END AS outcome FROM ({_RUNS})")
def run_outcomes(spark, sf):
    return RL.run_outcomes(_runs(spark, sf)).select("run_id", "outcome")


_CHECK_ROWS = ("SELECT CAST(l_orderkey AS VARCHAR) AS run_id, 'c' || l_linenumber AS check_name, l_returnflag <> 'R' AS passed,"
               " CASE WHEN l_linenumber = 1 THEN 'critical' ELSE 'error' END AS severity, l_linestatus AS column_name FROM lineitem")


def _check_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.concat(F.lit("c"), "l_linenumber").alias("check_name"),
        F.lit("line").alias("check_type"), (F.col("l_returnflag") != "R").alias("passed"),
        F.when(F.col("l_linenumber") == 1, "critical").otherwise("error").alias("severity"),
        F.col("l_linestatus").alias("column_name"), F.lit("").alias("detail"), "l_shipdate", "l_quantity")


@query("run_metrics", f"SELECT r.run_id, CASE WHEN quality_passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quality_passed,"
       " CAST(retry_count AS DOUBLE) AS retry_count, rows_output AS rows_processed, coalesce(check_count, 0) AS check_count,"
       f" coalesce(failed_checks, 0) AS failed_checks, coalesce(anomaly_count, 0) AS anomaly_count FROM ({_RUNS}) r LEFT JOIN"
       f" (SELECT run_id, count(*) AS check_count, count(*) FILTER (WHERE NOT passed) AS failed_checks FROM ({_CHECK_ROWS}) GROUP BY 1) c USING (run_id)"
       " LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, count(*) AS anomaly_count FROM lineitem WHERE l_quantity > 45 GROUP BY 1) a USING (run_id)")
def run_metrics(spark, sf):
    checks = _check_rows(spark, sf)
    return RL.run_metrics(_runs(spark, sf), checks, checks.where("l_quantity > 45").select("run_id"))


@query("quality_report", f"WITH c AS ({_CHECK_ROWS}) SELECT run_id, NOT bool_or(NOT passed AND severity = 'critical') AS overall_passed,"
       " count(*) AS check_count, count(*) FILTER (WHERE NOT passed) AS failed_count, count(DISTINCT check_name || column_name) AS listed, (SELECT count(*) FROM lineitem"
       " WHERE CAST(l_orderkey AS VARCHAR) = c.run_id AND l_quantity > 45) AS anomaly_count FROM c GROUP BY run_id")
def quality_report(spark, sf):
    checks = _check_rows(spark, sf)
    found = checks.where("l_quantity > 45").groupBy("run_id", F.col("column_name").alias("column")).agg(
        F.count(F.lit(1)).alias("anomaly_count"), F.array(F.max("l_quantity")).alias("examples"))
    path = scratch_path(spark, "report")
    RP.write_report(RP.quality_report(checks, found), path)
    return spark.read.schema("run_id string, overall_passed boolean, check_count long, failed_count long,"
                             " checks array<struct<check_name: string>>, anomaly_count long").json(path).select(
        "run_id", "overall_passed", "check_count", "failed_count", F.size("checks").cast("long").alias("listed"), "anomaly_count")


@query("check_results", "SELECT 'row_count' AS check_name, NULL AS column_name, true AS passed, 'r1' AS run_id FROM customer GROUP BY 1 UNION ALL"
       " SELECT 'null_rate', c, true, 'r1' FROM (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS c) UNION ALL"
       " SELECT 'value_range', c, true, 'r1' FROM (SELECT unnest(['c_custkey', 'c_nationkey', 'c_acctbal']) AS c)")
def check_results(spark, sf):
    customer = table(spark, sf, "customer")
    path = scratch_path(spark, "results")
    RP.append_check_results(Q.quality_checks(customer, A.column_stats(customer)), "r1", path)
    return spark.read.parquet(path).select("check_name", "column_name", "passed", "run_id")


# --- increments and streams -----------------------------------------------------


@query("incremental_rows", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def incremental_rows(spark, sf):
    return I.new_rows(table(spark, sf, "events"), "ts", "2024-01-20 00:00:00")


@query("incremental_lookback", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-18 00:00:00' AND NOT (ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type <> 'error')")
def incremental_lookback(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    seen = events.where("ts <= TIMESTAMP_NTZ'2024-01-20 00:00:00' AND event_type <> 'error'")
    return I.new_rows(events, "ts", "2024-01-20 00:00:00", "INTERVAL 2 DAYS", seen, ["event_id"]).select("event_id", "ts")


@query("new_watermark", "SELECT count(*) AS new_row_count, coalesce(max(o_orderkey), 9000)::VARCHAR AS watermark_value, 0::BIGINT AS null_watermarks"
       " FROM orders WHERE o_orderkey > 9000")
def new_watermark(spark, sf):
    increment = I.new_rows(table(spark, sf, "orders"), "o_orderkey", 9000)
    return I.new_watermark(increment, "o_orderkey", 9000)


@query("stream_incremental", "SELECT event_id, event_type, value FROM events")
def stream_incremental(spark, sf):
    root = scratch_path(spark, "stream")
    events = table(spark, sf, "events")
    # Two deliveries of all events: the second repeats the first.
    for part in ("a", "b"):
        events.write.mode("append").parquet(f"{root}/in")
    rows = ST.new_file_rows(spark, f"{root}/in", events.schema)
    ST.ingest(ST.drop_repeats(rows, "ts", ["event_id"], "60 days"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type", "value")


@query("stream_late_rows", "WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS line FROM events)"
       " SELECT event_id, event_type, value, false AS late FROM events UNION ALL"
       " SELECT event_id, event_type, value, true FROM events, m WHERE ts < line UNION ALL"
       " SELECT event_id + 1000000000, event_type, value, ts < line FROM events, m")
def stream_late_rows(spark, sf):
    root = scratch_path(spark, "late")
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    again = events.withColumn("event_id", F.col("event_id") + 1_000_000_000)
    run = ST.split_late(f"{root}/out", f"{root}/late", f"{root}/state", "ts", ["event_id"])
    # Three deliveries: all events, all of them again (repeats, or late by now), and as many others, of which the last day is in time.
    for part in (events, events, again):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        ST.ingest_split(ST.new_file_rows(spark, f"{root}/in", events.schema), run, f"{root}/checkpoint").awaitTermination()
    found = [spark.read.schema(events.schema).parquet(f"{root}/{p}").withColumn("late", F.lit(p == "late")) for p in ("out", "late")]
    return found[0].unionByName(found[1]).select("event_id", "event_type", "value", "late")


@query("stream_gate", "SELECT 'target' AS place, count(*) AS n FROM orders UNION ALL SELECT 'checks', 1 + 6 + 3 FROM orders GROUP BY 1")
def stream_gate(spark, sf):
    root = scratch_path(spark, "gate")
    orders = table(spark, sf, "orders")
    orders.write.parquet(f"{root}/in")
    run = G.gate_increment(A.profile(orders), f"{root}/target", f"{root}/rejected", f"{root}/checks")
    G.gated_ingest(ST.new_file_rows(spark, f"{root}/in", orders.schema), run, f"{root}/checkpoint").awaitTermination()
    return A.union_all([
        spark.read.parquet(f"{root}/{p}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("place"), "n")
        for p in ("target", "checks")])


# --- whole runs -------------------------------------------------------------------


def _prepared(spark, root, source, job, name="orders"):
    return prepare(source, name, "parquet", name, job, f"{root}/state", f"{root}/out")


def _outcomes(spark, rows):
    return spark.createDataFrame(rows, "step string, status string, cached boolean, rows_input long, rows_output long")


@query("cache_hits", "WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS b FROM orders)"
       " SELECT 'first' AS step, 'success' AS status, false AS cached, a AS rows_input, a AS rows_output FROM n UNION ALL"
       " SELECT 'same', 'success', true, a, a FROM n UNION ALL SELECT 'other rows', 'success', false, b, b FROM n")
def cache_hits(spark, sf):
    root, orders = scratch_path(spark, "hits"), table(spark, sf, "orders")
    job = Preparation([], domain="unknown", keys=["o_orderkey"], drift_policy="accept", gate=())
    rows = []
    # The order of the rows makes no other data.
    for step, source in (("first", orders), ("same", orders.repartition(3)), ("other rows", orders.where("o_orderkey % 2 = 0"))):
        r = _prepared(spark, root, source, job)
        rows.append((step, r.status, r.cached, r.rows_input, r.rows_output))
    return _outcomes(spark, rows)


@query("watermark_after_publish", "WITH d AS (SELECT *, o_orderkey % 3 AS load FROM orders) SELECT 'refused' AS step, 'failed' AS status, CAST(NULL AS VARCHAR) AS watermark,"
       " count(*) FILTER (WHERE load = 0) AS rows_input FROM d UNION ALL"
       " SELECT 'taken', 'success', CAST(max(o_orderkey) FILTER (WHERE load = 0) AS VARCHAR), count(*) FILTER (WHERE load = 0) FROM d UNION ALL"
       " SELECT 'next', 'success', CAST(max(o_orderkey) AS VARCHAR), count(*) FILTER (WHERE o_orderkey > (SELECT max(o_orderkey) FROM d WHERE load = 0)) FROM d"
       " HAVING count(*) FILTER (WHERE o_orderkey > (SELECT max(o_orderkey) FROM d WHERE load = 0)) > 0")
def watermark_after_publish(spark, sf):
    root, orders = scratch_path(spark, "marks"), table(spark, sf, "orders")
    first, rows = orders.where("o_orderkey % 3 = 0"), []

    def load(step, source, steps, gate):
        job = Preparation(steps, domain="unknown", keys=["o_orderkey"], watermark_column="o_orderkey", drift_policy="accept", gate=gate)
        result = _prepared(spark, root, source, job)
        if result.status != "nothing_new":
            mark = RL.last_watermarks(State(spark, f"{root}/state").runs()).first()
            rows.append((step, result.status, mark["watermark_value"] if mark else None, result.rows_input))

    # A load that its gate refuses leaves the watermark where it was, so the next one takes the same rows.
    load("refused", first, [Step("dedup_by_id", ("o_orderstatus",), {"order": ("o_orderkey",)})], ("critical",))
    load("taken", first, [], ("critical",))
    load("next", orders, [], ())
    return spark.createDataFrame(rows, "step string, status string, watermark string, rows_input long")


@query("drift_gate", "SELECT policy, CASE WHEN change <> 'same' AND change <> 'added' AND policy = 'fail' THEN 'refused' WHEN change = 'same' THEN 'none'"
       " WHEN change = 'added' THEN 'warning' ELSE 'critical' END AS outcome, change, (SELECT count(*) FROM customer) AS rows FROM"
       " (SELECT unnest(['fail', 'warn', 'accept']) AS policy), (SELECT unnest(['same', 'added', 'dropped', 'retyped']) AS change)")
def drift_gate(spark, sf):
    customer = table(spark, sf, "customer")
    kinds = {"same": customer, "added": customer.withColumn("extra", F.lit(1)), "dropped": customer.drop("c_acctbal"),
             "retyped": customer.withColumn("c_acctbal", F.col("c_acctbal").cast("string"))}

    def schema(df):
        return A.column_stats(df).select("column", F.col("dtype").alias("type"))
    rows, n = [], customer.count()
    for change, df in kinds.items():
        summary = A.settle(D.drift_summary(D.compare_schemas(schema(customer), schema(df))))
        for policy in ("fail", "warn", "accept"):
            try:
                outcome = D.drift_gate(summary, policy)
            except D.DriftError:
                outcome = "refused"
            rows.append((policy, outcome, change, n))
    return spark.createDataFrame(rows, "policy string, outcome string, change string, rows long")


# --- domains: orders read as datasets whose columns depend on their priority -------

_SETS = {
    "1-URGENT": "customer_id product_sku category quantity unit_price order_id",
    "2-HIGH": "patient_id diagnosis_code medication dosage_mg",
    "3-MEDIUM": "Vehicle_Make Model_Year engine fuel mileage vin",
    "4-NOT SPECIFIED": "employee_id salary grade band hire_date manager_name",
    "5-LOW": "amount currency account_balance fee tax invoice_no payment_ref",
}
_GOALS = ("CASE o_orderstatus WHEN 'F' THEN 'Clean   sales data' WHEN 'O' THEN 'prepare discount and refund report'"
          " ELSE concat('check stock level ', o_custkey) END")
_TOKENS_SQL = (
    "WITH d AS (SELECT o_orderkey AS dataset_id, CASE o_orderpriority "
    + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in _SETS.items()) + f" END AS names, {_GOALS} AS goal FROM orders),"
    " n AS (SELECT dataset_id, unnest(string_split(lower(names), ' ')) AS name FROM d),"
    " t AS (SELECT dataset_id, name AS token FROM n UNION SELECT dataset_id, unnest(string_split(name, '_')) FROM n"
    " UNION SELECT dataset_id, unnest(regexp_split_to_array(lower(goal), '\\s+')) FROM d),"
    " k AS (SELECT * FROM (VALUES " + ", ".join(
        f"('{d}', {i}, '{w}', {len(ws)})" for i, (d, ws) in enumerate(DOMAIN_KEYWORDS.items()) for w in ws)
    + ") AS k(domain, priority, token, total)),"
    " s AS (SELECT dataset_id, domain, priority, count(*) AS hits, count(*) / any_value(total) AS score FROM t JOIN k USING (token)"
    " GROUP BY dataset_id, domain, priority)")
_DECIDED_SQL = (
    _TOKENS_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, priority) AS rn,"
    " coalesce(lead(score) OVER (PARTITION BY dataset_id ORDER BY score DESC, priority), 0) AS second FROM s),"
    " b AS (SELECT *, (score >= 0.3 OR hits >= 5) AND score - second >= 0.15 AS sure, round(least(0.95, score * 2 + score - second), 3) AS conf"
    " FROM r WHERE rn = 1), x AS (SELECT d.dataset_id, CASE WHEN sure THEN b.domain ELSE 'unknown' END AS domain,"
    " CASE WHEN sure THEN conf ELSE 0 END AS confidence, CASE WHEN sure THEN 'keyword_heuristic' ELSE 'ambiguous' END AS method,"
    " NOT coalesce(sure AND conf >= 0.6, false) AS low_confidence FROM d LEFT JOIN b USING (dataset_id))")


def _tokens(spark, sf):
    names = None
    for p, c in _SETS.items():
        test = F.when(F.col("o_orderpriority") == p, c) if names is None else names.when(F.col("o_orderpriority") == p, c)
        names = test
    datasets = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("dataset_id"), names.alias("names"), F.expr(_GOALS).alias("goal"))
    columns = datasets.select("dataset_id", F.explode(F.split("names", " ")).alias("column"))
    return datasets, M.name_tokens(columns).unionByName(M.goal_tokens(datasets))


@query("domain_scores", _TOKENS_SQL + " SELECT dataset_id, domain, hits, score FROM s")
def domain_scores(spark, sf):
    _, tokens = _tokens(spark, sf)
    return M.domain_scores(tokens).select("dataset_id", "domain", "hits", "score")


@query("domain_decisions", _DECIDED_SQL + " SELECT * FROM x")
def domain_decisions(spark, sf):
    datasets, tokens = _tokens(spark, sf)
    return M.detect_domains(tokens, datasets)


@query("domain_rules", _DECIDED_SQL + ", ru AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{d}', '{k}', '{n}')" for d, r in DOMAIN_RULES.items() for k in
    ("sensitive_columns", "required_transforms", "forbidden_transforms", "validation_rules") for n in r[k])
    + ") AS ru(domain, kind, name)) SELECT dataset_id, domain, kind, name FROM x JOIN ru USING (domain)")
def domain_rules(spark, sf):
    datasets, tokens = _tokens(spark, sf)
    return M.load_domain_rules(M.detect_domains(tokens, datasets))


@query("document_domains", "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM documents), k AS"
       " (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{w}', {len(ws)})" for d, ws in DOMAIN_KEYWORDS.items() for w in ws)
       + ") AS k(domain, token, total)) SELECT doc_id, domain, count(*) AS hits, count(*) / any_value(total) AS score FROM t JOIN k USING (token) GROUP BY doc_id, domain")
def document_domains(spark, sf):
    documents = table(spark, sf, "documents")
    return M.domain_scores(M.goal_tokens(documents, "doc_id", "text"), "doc_id").select("doc_id", "domain", "hits", "score")


# --- catalogue, library, search, tests ------------------------------------------


def _docs_sql(t: str, columns: dict[str, str]) -> str:
    parts = []
    for c, k in columns.items():
        base = f"printf('%s column, %.2f%% null, %d distinct values', '{k}', 0.0::DOUBLE, count(DISTINCT {c}))"
        span = f" || printf(', from %s to %s', min({c})::VARCHAR, max({c})::VARCHAR)" if k in ("BIGINT", "INT", "DOUBLE") else ""
        parts.append(f"SELECT '{c}' AS \"column\", '{k}' AS type, {base}{span} || '.' AS description FROM {t}")
    return " UNION ALL ".join(parts)


_PART = {"p_partkey": "BIGINT", "p_name": "STRING", "p_brand": "STRING", "p_type": "STRING", "p_size": "INT", "p_retailprice": "DOUBLE"}


@query("column_docs", _docs_sql("part", _PART))
def column_docs(spark, sf):
    part = table(spark, sf, "part")
    return K.column_docs(A.profile(part), infer.infer_schema(part))


@query("catalogue_register", f"SELECT 'part' AS dataset_name, \"column\", type, description, (SELECT count(*) FROM part) AS row_count FROM ({_docs_sql('part', _PART)})")
def catalogue_register(spark, sf):
    part = table(spark, sf, "part")
    path = scratch_path(spark, "catalogue")
    K.append_entry(K.catalogue_entry(column_docs(spark, sf), "part", "part", "parquet", part.count(), "r1", [1.0, 0.0]), path)
    entry = spark.read.parquet(path)
    return entry.select("dataset_name", F.explode("schema").alias("column", "type"), "column_descriptions", "row_count").select(
        "dataset_name", "column", "type", F.col("column_descriptions")[F.col("column")].alias("description"), "row_count")


_CENTRES = "SELECT label AS query, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"


@query("nearest_vectors", f"WITH c AS ({_CENTRES}), s AS (SELECT query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 10) AS sim"
       " FROM embeddings CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s)"
       " SELECT query, vec_id, round(sim, 4) AS similarity, rank FROM r WHERE rank <= 5")
def nearest_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    centres = mean_vectors(vectors, "label", "embedding").select(F.col("label").alias("query"), "embedding")
    return nearest(vectors, "vec_id", "embedding", centres, 5)


_MEAN = "SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(v::DOUBLE) AS m FROM (SELECT unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY i)"
_TAGS = "CASE label % 5 WHEN 0 THEN ['currency', 'cleaning'] WHEN 1 THEN ['date'] WHEN 2 THEN ['dedup', 'cleaning'] WHEN 3 THEN ['pii'] ELSE [] END"


def _library(spark, sf):
    def tags(*names):
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")
    slot = F.col("label") % 5
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("library_id"), "embedding",
        F.when(slot == 0, tags("currency", "cleaning")).when(slot == 1, tags("date")).when(slot == 2, tags("dedup", "cleaning"))
        .when(slot == 3, tags("pii")).otherwise(tags()).alias("tags"))


def _mean_vector(spark, sf):
    whole = table(spark, sf, "embeddings").withColumn("label", F.lit(0))
    return mean_vectors(whole, "label", "embedding").first()["embedding"]


@query("nearest_many", "WITH q AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id,"
       " round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 10) AS sim FROM embeddings CROSS JOIN q),"
       " r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s)"
       " SELECT query, vec_id, round(sim, 4) AS similarity, rank FROM r WHERE rank <= 4")
def nearest_many(spark, sf):
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return nearest(vectors, "vec_id", "embedding", asked, 4)


@query("catalogue_search", f"SELECT vec_id AS catalogue_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT q FROM ({_MEAN}))), 4) AS similarity"
       " FROM embeddings ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], "
       f"(SELECT q FROM ({_MEAN}))), 10) DESC, vec_id LIMIT 5")
def catalogue_search(spark, sf):
    entries = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "catalogue_id")
    return K.search_catalogue(entries, _mean_vector(spark, sf)).select("catalogue_id", "similarity")


@query("library_search_tags", f"SELECT vec_id AS library_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT q FROM ({_MEAN}))), 4) AS similarity"
       f" FROM embeddings WHERE list_has_any({_TAGS}, ['cleaning', 'pii']) ORDER BY round(list_cosine_similarity(embedding::DOUBLE[],"
       f" (SELECT q FROM ({_MEAN}))), 10) DESC, vec_id LIMIT 5")
def library_search_tags(spark, sf):
    return K.search_library(_library(spark, sf), _mean_vector(spark, sf), ["cleaning", "pii"]).select("library_id", "similarity")


@query("library_usage", "SELECT p_partkey AS library_id, coalesce(n, 0) AS use_count FROM part LEFT JOIN"
       " (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def library_usage(spark, sf):
    usage = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("library_id"), F.col("l_shipdate").alias("used_at"))
    return K.with_use_count(table(spark, sf, "part").select(F.col("p_partkey").alias("library_id")), usage)


@query("library_save_new", "SELECT p_name || ' ' || p_brand AS name, min(p_partkey) AS library_id FROM part WHERE p_size > 10 AND p_name || ' ' || p_brand NOT IN"
       " (SELECT p_name || ' ' || p_brand FROM part WHERE p_type = 'ECONOMY') GROUP BY 1")
def library_save_new(spark, sf):
    part = table(spark, sf, "part").select(
        F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_partkey").alias("library_id"),
        (F.col("p_size") > 10).alias("quality_passed"), "p_type")
    return K.new_entries(part.drop("p_type"), part.where("p_type = 'ECONOMY'")).select("name", "library_id")


_SUGGEST_SQL = (
    "SELECT \"column\", test FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'unique' AS test, count(DISTINCT {c}) = count(*) AS ok FROM {t} UNION ALL SELECT '{c}', 'not_null', count(*) = count({c}) FROM {t}"
        for t, c in [("customer", "c_custkey"), ("customer", "c_name"), ("customer", "c_nationkey"), ("customer", "c_acctbal"), ("customer", "c_mktsegment")])
    + " UNION ALL SELECT 'is_overdrawn', 'not_null', true UNION ALL SELECT 'is_overdrawn', 'accepted_values', count(*) > 0 FROM customer) WHERE ok")


def _tested_customer(spark, sf):
    return table(spark, sf, "customer").withColumn("is_overdrawn", F.col("c_acctbal") < 0)


@query("suggest_tests", _SUGGEST_SQL)
def suggest_tests(spark, sf):
    return CT.suggest_tests(A.profile(_tested_customer(spark, sf))).select("column", "test")


@query("run_tests", "SELECT 'unique' AS check_name, 'o_orderkey' AS column_name, count(DISTINCT o_orderkey) = count(*) AS passed FROM orders UNION ALL"
       " SELECT 'unique', 'o_custkey', count(DISTINCT o_custkey) = count(*) FROM orders UNION ALL"
       " SELECT 'not_null', 'o_custkey', count(*) = count(o_custkey) FROM orders UNION ALL"
       " SELECT 'accepted_values', 'o_orderstatus', bool_and(o_orderstatus IN ('F', 'O')) FROM orders UNION ALL"
       " SELECT 'accepted_values', 'o_orderpriority', bool_and(o_orderpriority LIKE '_-%') FROM orders")
def run_tests(spark, sf):
    tests = [("o_orderkey", "unique", None), ("o_custkey", "unique", None), ("o_custkey", "not_null", None),
             ("o_orderstatus", "accepted_values", ["f", "o"]),
             ("o_orderpriority", "accepted_values", ["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"])]
    return CT.run_tests(table(spark, sf, "orders"), tests).select("check_name", "column_name", "passed")
