import datetime
import json

import pytest
from pyspark.sql import functions as F

from fixtures import sales
from tablewright.functions.vectors import mean_vectors, most_similar, nearest
from tablewright.operators import catalogue as K, domain as M, incremental as I, runlog as RL
from tablewright.operators.drift import DriftError
from tablewright.operators.transforms import Step
from tablewright.plans.preparation import Preparation, State, prepare
from tablewright.session import checkpoint_root, scratch_path
from tablewright.sources import files, jdbc, publish, records
from tablewright.streaming import gate as G, ingest as ST

STEPS = [Step("strip_currency_symbols"), Step("standardise_dates"), Step("normalise_country"),
         Step("flag_negative_quantity"),
         Step("dedup_by_id", None, {"order": ("transaction_date", "customer_id", "product_name")})]


def test_detected_domains(spark):
    retail = spark.createDataFrame([("a",) * 6], "customer_id string, product_sku string, category string, quantity string, unit_price string, order_id string")
    got = M.detect_domain(retail, "clean sales data")
    assert (got["domain"], got["confidence"], got["method"]) == ("retail", 0.909, "keyword_heuristic")
    medical = spark.createDataFrame([("a",) * 4], "patient_id string, diagnosis_code string, medication string, dosage_mg string")
    assert (M.detect_domain(medical)["domain"], M.detect_domain(medical)["confidence"]) == ("medical", 0.636)
    vague = M.detect_domain(spark.range(1))
    assert (vague["domain"], vague["method"], vague["low_confidence"]) == ("unknown", "ambiguous", True)


def test_preparation_end_to_end(spark, tmp_path):
    source = sales(spark)
    state_dir, output = str(tmp_path / "state"), str(tmp_path / "out")
    job = Preparation(STEPS, goal="clean sales orders customer purchase stock delivery", domain="retail",
                      keys=["transaction_id"], enforce_required=True)
    first = prepare(source, "sales.csv", "csv", "sales", job, state_dir, output)
    assert first.status == "success" and not first.cached and first.rows_input == 500 and 400 <= first.rows_output <= 500
    assert spark.read.parquet(first.output_path).count() == first.rows_output
    assert ("transaction_id", "unique", None) in first.tests
    state = State(spark, state_dir)
    run = state.runs().where(F.col("run_id") == first.run_id).first()
    assert run["status"] == "success" and run["quality_passed"] and run["rows_input"] == 500
    entry = state.catalogue().first()
    assert entry["schema"]["transaction_date"] == "DATE" and entry["row_count"] == first.rows_output
    assert state.lineage().count() == 11
    report = spark.read.json(f"{output}/{first.run_id}/final/quality_report").first()
    assert report["overall_passed"] and report["run_id"] == first.run_id
    shown = {a["column"]: a["examples"] for a in report["anomalies"] or []}
    assert all(v == "***" for v in shown.get("customer_id", []))

    again = prepare(source, "sales.csv", "csv", "sales", job, state_dir, output)
    assert again.cached and again.run_id == first.run_id

    # A dropped column is critical: nothing is written unless the policy accepts it.
    smaller = source.drop("discount_pct")
    with pytest.raises(DriftError):
        prepare(smaller, "sales.csv", "csv", "sales", job, state_dir, output)
    assert state.runs().where("status = 'failed'").count() == 1
    job.drift_policy = "accept"
    accepted = prepare(smaller, "sales.csv", "csv", "sales", job, state_dir, output)
    assert accepted.status == "success" and accepted.drift == "critical"


def test_failed_gate_publishes_nothing(spark, tmp_path):
    source = spark.createDataFrame([(1, "a")] * 100, "id int, v string")
    job = Preparation([Step("dedup_by_id", ("id",), {"order": ("v",)})], domain="unknown", keys=["id"])
    result = prepare(source, "t", "parquet", "t", job, str(tmp_path / "s"), str(tmp_path / "o"))
    assert result.status == "failed"
    assert not (tmp_path / "o" / result.run_id / "final").exists()
    assert State(spark, str(tmp_path / "s")).catalogue().isEmpty()


def test_incremental_preparation(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS day")
    job = Preparation([], domain="unknown", keys=["id"], watermark_column="day", drift_policy="accept")
    args = ("t", "parquet", "t", job, str(tmp_path / "s"), str(tmp_path / "o"))
    assert prepare(rows.where("id < 60"), *args).rows_output == 60
    second = prepare(rows, *args)
    assert second.rows_output == 40
    mark = RL.last_watermarks(State(spark, str(tmp_path / "s")).runs()).first()["watermark_value"]
    assert mark == "2024-04-09"


def test_incremental_preparation_with_a_lookback(spark, tmp_path):
    def load(rows, lookback):
        source = spark.createDataFrame([(at, i) for i, at in rows], "at int, id int")
        job = Preparation([], domain="unknown", keys=["id"], watermark_column="at", drift_policy="accept", gate=(), lookback=lookback)
        result = prepare(source, "t", "parquet", "t", job, str(tmp_path / "s"), str(tmp_path / "o"))
        out = spark.read.parquet(result.output_path) if result.output_path else None
        assert out is None or out.columns == ["at", "id"]
        return result, sorted(r["id"] for r in out.collect()) if out else []

    rows = [(1, 10), (2, None), (3, 20)]
    result, ids = load(rows, "5")
    assert ids == [1, 2, 3] and result.null_watermarks == 1
    rows += [(4, 20), (5, 16), (6, None), (7, 3), (8, 21)]
    result, ids = load(rows, "5")
    assert ids == [4, 5, 6, 8] and result.null_watermarks == 2 and result.late_rows == 1
    result, ids = load(rows + [(9, 21)], False)
    assert result.status == "nothing_new" and result.null_watermarks == 2 and result.late_rows == 2
    # Without a lookback rows that tie with the watermark, and rows without one, come by their key.
    result, ids = load(rows + [(9, 21), (12, None)], None)
    assert ids == [9, 12] and result.late_rows == 1
    rows += [(9, 21), (12, None), (10, 21)]
    assert load(rows, "5")[1] == [10]
    assert load(rows, "5")[0].status == "nothing_new"
    with pytest.raises(ValueError):
        prepare(spark.range(1), "u", "parquet", "u", Preparation([], lookback="1"), str(tmp_path / "s"), str(tmp_path / "o"))


def test_nulls_in_watermark_and_key_come_once(spark):
    rows = spark.createDataFrame([(1, 10), (None, 10), (2, None), (None, None), (3, 11)], "id int, at int")
    seen = rows.where("id IS NULL OR id = 2")
    assert sorted(r["id"] for r in I.new_rows(rows, "at", 10, None, seen, ["id"]).collect()) == [1, 3]
    assert I.new_rows(rows, "at", 10, "1", seen, ["id", "at"]).count() == 2


def test_rules_and_cells_of_a_run_are_stored(spark, tmp_path):
    rows = [(i, -5.0 if i < 3 else 10.0 + i % 4, "UK" if i % 2 else "Atlantis", f"2024-01-{1 + i % 28:02d}", 1 + i % 5, f"C-{i}") for i in range(60)]
    rows += [(60, 9999.0, "UK", "someday", 2, "odd!")]
    source = spark.createDataFrame(rows, "order_id int, unit_price double, country string, order_date string, quantity int, customer_id string")
    job = Preparation([], domain="retail", keys=["order_id"], enforce_required=False)
    result = prepare(source, "t", "csv", "t", job, str(tmp_path / "s"), str(tmp_path / "o"))
    state = State(spark, str(tmp_path / "s"))
    found = {(r["name"], r["column"]): r["violation_count"] for r in spark.read.parquet(state.path("rule_results")).collect()}
    assert found == {("unit_price_non_negative", "unit_price"): 3, ("date_iso8601", "order_date"): 1, ("country_canonical", "country"): 30,
                     ("drop_null_rows", None): 0, ("drop_negative_quantity_rows", "quantity"): 0}
    assert ("country_canonical", "country", 30) in result.violations and result.status == "success"
    cells = spark.read.parquet(f"{tmp_path}/o/{result.run_id}/final/anomalies")
    assert cells.where("column = 'unit_price' AND order_id = 60").count() == 1
    assert cells.where("column = 'customer_id' AND value <> '***'").count() == 0
    report = spark.read.json(f"{tmp_path}/o/{result.run_id}/final/quality_report").first()
    assert any(c["check_name"] == "country_canonical" and not c["passed"] for c in report["checks"])
    entry = state.catalogue().first()["column_descriptions"]
    assert "from" in entry["unit_price"] and "from" not in entry["customer_id"]
    with pytest.raises(ValueError):
        prepare(source, "t", "csv", "t", Preparation([], domain="retail", keys=["order_id"]), str(tmp_path / "s"), str(tmp_path / "o"))


def test_a_failure_after_publishing_is_on_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "append_entry", lambda *a: (_ for _ in ()).throw(OSError("no catalogue")))
    args = (spark.range(5), "t", "parquet", "t", Preparation([], domain="unknown", keys=["id"]), str(tmp_path / "s"), str(tmp_path / "o"))
    with pytest.raises(OSError):
        prepare(*args)
    run = State(spark, str(tmp_path / "s")).runs().first()
    assert run["status"] == "catalogue_pending" and spark.read.parquet(run["output_path"]).count() == 5
    assert RL.run_outcomes(State(spark, str(tmp_path / "s")).runs()).first()["outcome"] == "publish"


def test_watermark_is_typed(spark):
    df = spark.createDataFrame([(9,), (10,), (None,)], "n int")
    assert [r["n"] for r in I.new_rows(df, "n", 9).collect()] == [10]
    assert I.new_rows(df, "n").count() == 3
    row = I.new_watermark(I.new_rows(df, "n", 50), "n", 50).first()
    assert (row["new_row_count"], row["watermark_value"]) == (0, "50")


def test_run_log(spark, tmp_path):
    t = [datetime.datetime(2024, 1, d, tzinfo=datetime.timezone.utc) for d in (1, 2, 3)]
    path = str(tmp_path / "runs")
    for event in (dict(run_id="a", run_key="k", status="running", started_at=t[0], event_time=t[0]),
                  dict(run_id="a", status="success", completed_at=t[1], rows_output=5, event_time=t[1]),
                  dict(run_id="b", run_key="k", status="retrying", retry_count=3, event_time=t[2])):
        RL.append_events(RL.run_event(spark, **event), path)
    runs = RL.current_runs(spark.read.parquet(path))
    assert RL.latest_success(runs, "k").first()["rows_output"] == 5
    assert {r["run_id"]: r["outcome"] for r in RL.run_outcomes(runs).collect()} == {"a": "publish", "b": "failed"}
    with pytest.raises(ValueError):
        RL.run_event(spark, colour="red")


def test_csv_delimiters_and_mixed_folder(spark, tmp_path):
    for name, text in (("a.csv", "x;y\n1;a\n"), ("b.csv", "x|y\n2|b\n"), ("c.csv", "x\ty\n3\tc\n"), ("d.csv", "x\n4\n")):
        (tmp_path / name).write_text(text)
    got = {r["path"].rsplit("/", 1)[1]: r["delimiter"] for r in files.detect_delimiters(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ";", "b.csv": "|", "c.csv": "\t", "d.csv": ","}
    (tmp_path / "d.csv").unlink()
    assert sorted((r["x"], r["y"]) for r in files.read_csv(spark, str(tmp_path)).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_metadata(spark, tmp_path):
    written = publish.write_dataset(sales(spark), str(tmp_path / "t"))
    assert written["row_count"] == 500 and written["file_size_mb"] > 0
    meta = files.metadata(files.read_file_source(spark, str(tmp_path / "t"), "parquet"), str(tmp_path / "t"), ["transaction_id"])
    assert meta["row_count"] == 500 and len(meta["first_5_rows"]) == 5 and meta["size_mb"] == written["file_size_mb"]


def test_envelopes(spark, tmp_path):
    docs = [{"results": [{"a": 1}, {"a": 2}], "next": "p2"}, {"items": [{"a": 3, "b": "x"}]}, {"a": 4}]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "list.json").write_text(json.dumps([{"a": 5}, {"a": 6}], indent=1))
    df = records.read_documents(spark, str(tmp_path))
    assert sorted(r["a"] for r in records.unwrap(df).collect()) == [1, 2, 3, 4, 5, 6]
    assert records.unwrap(df.where("a IS NULL")).columns == ["a", "b"]
    assert {r["info"]["next"] for r in records.pagination(df).collect()} == {"p2", None}
    assert records.unwrap(spark.read.json(str(tmp_path / "list.json"), multiLine=True)).count() == 2


def test_jdbc_options():
    assert jdbc.split_address("postgresql://u@h/db::orders") == ("postgresql://u@h/db", "orders")
    with pytest.raises(ValueError):
        jdbc.split_address("orders")
    options = jdbc.jdbc_options("postgres://h/db", "t", "id", 0, 100, 4)
    assert options["url"] == "jdbc:postgresql://h/db" and options["numPartitions"] == "4"
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", "t", "id")


def test_staged_publish(spark, tmp_path):
    staging, final = str(tmp_path / "r" / "staging"), str(tmp_path / "r" / "final")
    assert not publish.staged_publish(spark.range(3), staging, final, lambda df: False)
    assert not (tmp_path / "r" / "final").exists()
    assert publish.staged_publish(spark.range(3), staging, final, lambda df: df.count() == 3)
    with pytest.raises(publish.PublishError):
        publish.staged_publish(spark.range(4), staging, final, lambda df: True)
    assert publish.staged_publish(spark.range(4), staging, final, lambda df: True, overwrite=True)
    assert spark.read.parquet(final).count() == 4


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert publish.run_key(a, "g") == publish.run_key(a.orderBy(F.desc("a")), "g")
    assert publish.run_key(a, "g") != publish.run_key(a.union(a).union(a), "g")
    b = spark.createDataFrame([(1, None)], "a int, b int")
    c = spark.createDataFrame([(None, 1)], "a int, b int")
    assert publish.run_key(b, "g") != publish.run_key(c, "g")


def test_stream_drops_repeats_across_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 1, 1))], "id int, ts timestamp")
    folder = str(tmp_path / "in")

    def load():
        stream = ST.new_file_rows(spark, folder, rows.schema)
        ST.ingest(ST.drop_repeats(stream, "ts", ["id"], "1 day"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    rows.write.parquet(folder)
    assert load() == [1, 2]
    rows.union(spark.createDataFrame([(3, datetime.datetime(2024, 1, 1, 2))], rows.schema)).write.mode("append").parquet(folder)
    assert load() == [1, 2, 3]
    assert load() == [1, 2, 3]


def test_stream_gate_rejects(spark, tmp_path):
    from tablewright.operators import profile as A
    rows = spark.range(50).selectExpr("id", "CAST(id AS DOUBLE) AS v")
    rows.write.parquet(str(tmp_path / "in"))
    run = G.gate_increment(A.profile(rows), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "checks"),
                           prepare=lambda df: df.where("id < 5"))
    G.gated_ingest(ST.new_file_rows(spark, str(tmp_path / "in"), rows.schema), run, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 5 and not (tmp_path / "ok").exists()


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<float>")
    assert [(r["id"], r["similarity"]) for r in most_similar(df, "v", [1.0, 0.0], 3, "id").collect()] == [(1, 1.0), (3, 0.7071), (2, 0.0)]
    got = nearest(df, "id", "v", [("x", [1.0, 0.0]), ("y", [0.0, 2.0])], 2).orderBy("query", "rank").collect()
    assert [(r["query"], r["id"], r["similarity"]) for r in got] == [("x", 1, 1.0), ("x", 3, 0.7071), ("y", 2, 1.0), ("y", 3, 0.7071)]


def test_library(spark):
    seed = K.library_entry(spark, "trim_codes", "Codes without outer blanks", "steps", ["code"]).unionByName(
        K.library_entry(spark, "round_amounts", "Amounts to two places", "steps", ["money"]))
    seed = seed.withColumn("library_id", F.md5("name"))
    entry = K.library_entry(spark, "new_one", "text", "steps", ["date"], [1.0]).withColumn("quality_passed", F.lit(True))
    known = K.library_entry(spark, "trim_codes", "text", "steps", ["id"]).withColumn("quality_passed", F.lit(True))
    failing = K.library_entry(spark, "other", "text", "steps", ["id"]).withColumn("quality_passed", F.lit(False))
    assert [r["name"] for r in K.new_entries(entry.unionByName(known).unionByName(failing), seed).collect()] == ["new_one"]
    usage = K.usage_events(seed.where("name = 'trim_codes'"))
    counts = {r["name"]: r["use_count"] for r in K.with_use_count(seed, usage.union(usage)).collect()}
    assert counts["trim_codes"] == 2 and counts["round_amounts"] == 0


def test_scratch_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(checkpoint_root(spark))


def test_command_line(spark, tmp_path, capsys):
    from tablewright.__main__ import main
    source = str(tmp_path / "sales")
    sales(spark, 200).coalesce(1).write.option("header", "true").csv(source)
    steps = tmp_path / "steps.json"
    steps.write_text(json.dumps([{"name": "standardise_dates"}, {"name": "normalise_boolean", "columns": ["is_returned"]}]))
    code = main([source, "--dataset", "sales", "--steps", str(steps), "--state", str(tmp_path / "s"),
                 "--output", str(tmp_path / "o"), "--key", "transaction_id"])
    result = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert code == 0 and result["rows_output"] == 200 and result["transformations"] == ["standardise_dates", "normalise_boolean"]


def test_run_key_holds_settings(spark, tmp_path):
    rows = spark.createDataFrame([(1, "USA"), (2, "UK")], "id int, country string")
    where = (str(tmp_path / "s"), str(tmp_path / "o"))
    plain = Preparation([], domain="unknown", keys=["id"], drift_policy="accept")
    first = prepare(rows, "a", "parquet", "a", plain, *where)
    assert prepare(rows, "a", "parquet", "a", plain, *where).cached
    other = Preparation([Step("normalise_country")], domain="unknown", keys=["id"], drift_policy="accept")
    assert not prepare(rows, "a", "parquet", "a", other, *where).cached
    moved = prepare(rows.withColumnRenamed("country", "land"), "b", "parquet", "b", plain, *where)
    assert not moved.cached and moved.run_id != first.run_id
    marked = Preparation([], domain="unknown", keys=["id"], watermark_column="id", drift_policy="accept")
    assert prepare(rows, "c", "parquet", "c", marked, *where).rows_output == 2
    assert prepare(rows, "c", "parquet", "c", marked, *where).status == "nothing_new"


def test_rows_without_watermark_come_with_a_lookback(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 12), (4, None), (5, 9)], "id int, at int")
    seen = spark.createDataFrame([(1,), (2,)], "id int")
    new = I.new_rows(df, "at", 10, "1", seen, ["id"])
    assert sorted(r["id"] for r in new.collect()) == [3, 4, 5]
    assert I.new_watermark(new, "at", 10).first()["null_watermarks"] == 1


def test_mean_vectors_are_whole(spark):
    df = spark.createDataFrame([(1, [1.0] * 96), (1, [3.0] * 96), (2, None)], "g int, v array<double>")
    found = {r["g"]: r["v"] for r in mean_vectors(df, "g", "v").collect()}
    assert found[1] == [2.0] * 96
    with pytest.raises(ValueError):
        mean_vectors(df.unionByName(spark.createDataFrame([(3, [1.0])], "g int, v array<double>")), "g", "v")
