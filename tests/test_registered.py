"""Registered transforms, envelopes in one pass, database addresses."""

import pytest

from tablewright.operators import lineage as L, transforms as TR
from tablewright.sources import jdbc, open as O, records


def test_an_arrow_transform_has_declared_columns_and_lineage(spark):
    import pyarrow as pa
    import pyarrow.compute as pc
    TR.register_arrow_transform("scaled", lambda x, y, by=1: [pc.multiply(x, by), pc.utf8_upper(y)], ["x", "y"], "x BIGINT, loud STRING")
    df = spark.createDataFrame([(1, "a", "k"), (None, "b", None), (3, None, "m")], "x long, y string, `odd name` string").repartition(2)
    plan = TR.TransformPlan([TR.Step("scaled", None, {"by": 10})])
    out = plan.apply(df)
    assert out.columns == ["y", "odd name", "x", "loud"]
    assert sorted((str(r["x"]), str(r["loud"]), str(r["odd name"])) for r in out.collect()) == [("10", "A", "k"), ("30", "None", "m"), ("None", "B", "None")]
    edges = {(r["source_column"], r["target_column"], r["transformation"]) for r in L.lineage_edges(plan, df, "r", "s", "t").collect()}
    assert {("x", "x", "scaled"), ("y", "loud", "scaled"), ("y", "y", "passthrough")} <= edges
    with pytest.raises(ValueError):
        plan.to_sql(df, "t")
    with pytest.raises(ValueError):
        TR.register_arrow_transform("title_case", lambda x: [x], ["x"], "x BIGINT")
    other = TR.apply_transform(df.withColumnRenamed("x", "n"), "scaled", ["n", "y"], by=2)
    assert sorted(str(r["x"]) for r in other.collect()) == ["2", "6", "None"]
    assert TR.apply_transform(df.limit(0), "scaled").count() == 0


def test_envelopes_of_several_kinds_in_one_scan(spark, tmp_path):
    lines = ['{"data": [{"a": 1, "b": "x"}, {"a": 2}], "page": 1}', '{"items": [{"a": 2.5, "c": true}], "data": null}', '{"a": 7, "d": "bare"}', '{"rows": []}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.json").write_text("\n".join(lines))
    documents = records.read_documents(spark, str(tmp_path / "in"), multi_line=False)
    found = records.unwrap(documents)
    rows = sorted((r["a"], r["b"], r["c"], r["d"]) for r in found.collect() if r["a"] is not None)
    assert rows == [(1.0, "x", None, None), (2.0, None, None, None), (2.5, None, True, None), (7.0, None, None, "bare")]
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_credentials_leave_the_address(spark, monkeypatch):
    options = jdbc.jdbc_options("postgres://me:p%40ss@host:5432/db", "t")
    assert options["url"] == "jdbc:postgresql://host:5432/db" and options["user"] == "me" and options["password"] == "p@ss"
    assert jdbc.split_credentials("jdbc:postgresql://host/db") == ("jdbc:postgresql://host/db", None, None)
    asked = []
    monkeypatch.setattr(jdbc, "read_table", lambda spark_, connection, table, **options: asked.append((table, options)) or spark.createDataFrame(
        [(1, 9)], "low int, high int"))
    O.open_source(spark, "postgresql://h/db::orders", "postgres", partition_column="id", partitions=4)
    assert "min(id)" in asked[0][0] and asked[1] == ("orders", {"partition_column": "id", "lower": 1, "upper": 9, "partitions": 4})


def test_ids_without_a_value_are_not_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "order_id int, v string")
    plan = TR.TransformPlan([TR.Step("dedup_by_id", None, {"order": ("v",)})])
    assert sorted(r["v"] for r in plan.apply(df).collect()) == ["a", "c", "d"]
    df.createOrReplaceTempView("ids_without")
    assert sorted(r["v"] for r in spark.sql(plan.to_sql(df, "ids_without")).collect()) == ["a", "c", "d"]
    assert plan.apply(df.where("order_id IS NULL")).count() == 2
    times = spark.sql("SELECT TIMESTAMP'2024-01-02 03:04:05' AS event_time")
    assert TR.apply_transform(times, "standardise_dates", keep_time=True).first()["event_time"].hour == 3
    assert TR.apply_transform(times, "standardise_dates").schema[0].dataType.simpleString() == "date"


def test_headers_of_compressed_and_nested_files(spark, tmp_path):
    from tablewright.sources import files
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    for folder, sep, compression in (("one", ";", "gzip"), ("two/deep", "|", "none"), ("three", "\t", "bzip2")):
        df.coalesce(1).write.option("header", "true").option("sep", sep).option("compression", compression).csv(str(tmp_path / "t" / folder))
    expected = {"one": ";", "two": "|", "three": "\t"}
    for found in (files.detect_delimiters(spark, str(tmp_path / "t"), "part-*"),):
        got = {r["path"].split("/t/")[1].split("/")[0]: r["delimiter"] for r in found.collect()}
        assert got == expected
    lines = {r["path"].split("/t/")[1].split("/")[0]: r["header"] for r in files._spark_first_lines(spark, str(tmp_path / "t"), "part-*").collect()}
    assert lines == {"one": "a;b", "two": "a|b", "three": "a\tb"}
