"""The whole preparation of one table: profile, gate, transform, check, publish, record."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tablewright import rules as R
from tablewright.functions import columns as C
from tablewright.operators import (
    anomalies as N, catalogue as K, checks as Q, column_tests, constraints as V, domain as M, drift as D, incremental as I,
    infer, lineage as L, profile as A, report, runlog)
from tablewright.operators.transforms import Step, TransformPlan
from tablewright.schemas import CATALOGUE_SCHEMA, DOMAIN_SCHEMA, LINEAGE_SCHEMA, RUN_SCHEMA
from tablewright.session import scratch_path
from tablewright.sources.publish import RunPaths, promote, run_key


@dataclass
class Preparation:
    """What to do with a source; every stage's limits can be overridden."""

    steps: Sequence[Step]
    goal: str = ""
    domain: str | None = None
    keys: Sequence[str] = ()
    watermark_column: str | None = None
    drift_policy: str = "fail"
    gate: tuple[str, ...] = ("critical",)
    enforce_required: bool = True
    pattern_mode: str = "letters"
    force: bool = False
    #: How far before the last watermark rows are read again (an interval or a number). None: rows that tie with the
    #: watermark and rows without a value, if a row key is known. False: only rows after the watermark.
    lookback: str | None | bool = None
    #: Source columns that tell which rows were loaded before; ``keys`` if empty.
    row_key: Sequence[str] = ()
    #: The day that date rules compare with; today if not given.
    as_of: datetime.date | None = None


@dataclass
class Result:
    run_id: str
    status: str
    cached: bool = False
    output_path: str | None = None
    domain: str = "unknown"
    drift: str = "none"
    rows_input: int | None = None
    rows_output: int | None = None
    transformations: list[str] = field(default_factory=list)
    sql: str | None = None
    tests: list = field(default_factory=list)
    #: Rows of the whole source that have no watermark value.
    null_watermarks: int | None = None
    #: Rows of the source at or before the last watermark that no load has taken (of a source that only grows).
    late_rows: int | None = None
    #: Domain rules and forbidden changes that some rows violate: (name, column, rows).
    violations: list = field(default_factory=list)


class State:
    """The engine's own tables, each a Parquet folder that is only ever appended to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as error:
            # Only a table that was never written counts as empty.
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return runlog.current_runs(self.read("runs", RUN_SCHEMA))

    def catalogue(self) -> DataFrame:
        return self.read("catalogue", CATALOGUE_SCHEMA)

    def lineage(self) -> DataFrame:
        return self.read("lineage", LINEAGE_SCHEMA)

    def seen(self, run_ids: Sequence[str], schema) -> DataFrame | None:
        """The row keys that the runs took from their source; None if one of them kept none."""
        try:
            return self.spark.read.schema(schema).parquet(*[self.path(f"seen/{i}") for i in run_ids])
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def record(self, **event) -> None:
        runlog.append_events(runlog.run_event(self.spark, **event), self.path("runs"))


def _increment(state: State, source: DataFrame, source_path: str, source_type: str, job: Preparation, result: Result) -> tuple[DataFrame, Any, list[str]]:
    """The rows to take, the last watermark and the row key; fills in what is counted of the whole source."""
    column, row_key, seen, last = job.watermark_column, list(job.row_key or job.keys), None, None
    if isinstance(job.lookback, str) and (column is None or not row_key):
        raise ValueError("a lookback needs a watermark column and a row key")
    if column is None:
        return source, None, row_key
    known = state.runs().where(F.col("source_path") == source_path)
    loads = known.where("status IN ('success', 'catalogue_pending')").where(F.col("watermark_column") == column).select(
        "run_id", "rows_input").collect()
    mark = runlog.last_watermarks(known).where(F.col("watermark_column") == column).first()
    last = mark["watermark_value"] if mark else None
    counts = [F.count_if(C.col(column).isNull()).alias("nulls"),
              (I.old_rows(column, source, last) if last is not None else F.sum(F.lit(0))).alias("old")]
    if last is not None and row_key and job.lookback is not False and set(row_key) <= set(source.columns):
        seen = state.seen([r["run_id"] for r in loads], source.select(*map(C.col, row_key)).schema)
        if seen is None and job.lookback is not None:
            raise ValueError("a lookback needs the row keys of all loads before; one of them kept none")
    names, watch = source.columns, None
    if source_type == "parquet":
        # Columnar files: a scan of one column.
        whole = source.agg(*counts).first().asDict()
    else:
        # Text and database sources are read once: they are counted while they land.
        watch = Observation(f"source-{result.run_id}")
        source = source.observe(watch, *counts)
    taken = I.new_rows(source, column, last, job.lookback or None, seen, row_key).select(*map(C.col, names))
    if source_type != "parquet" or seen is not None:
        taken = _landed(taken)
        whole = whole if watch is None else watch.get
    result.null_watermarks = whole["nulls"]
    if last is not None:
        again = taken.agg(I.old_rows(column, taken, last)).first()[0]
        result.late_rows = max(0, whole["old"] - sum(r["rows_input"] or 0 for r in loads) - again)
    return taken, last, row_key


def _landed(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "landed")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare(source: DataFrame, source_path: str, source_type: str, dataset: str, job: Preparation,
            state_dir: str, output_dir: str) -> Result:
    """Run a preparation; nothing appears under ``final`` unless its gate passes.

    An equal run is looked up before anything is landed. The source is then scanned for the profile and
    inference and for the write, which counts the violations of the domain's rules on its way; checks and anomalies read the
    written table. Every anomalous cell is published beside the data, those of sensitive columns hidden.

    With a watermark column a later load takes the rows after the last watermark, and if a row key is known
    also rows that tie with it and rows without a value; those whose row key an earlier load took are
    left out. The keys of each load are kept under ``seen`` in the state. What stays behind is counted in ``late_rows``.
    """
    spark = source.sparkSession
    state = State(spark, state_dir)
    run_id = uuid.uuid4().hex
    paths = RunPaths(output_dir, run_id)
    plan = TransformPlan(job.steps)
    result = Result(run_id, "failed", transformations=plan.applied)
    if job.domain:
        plan.check(job.domain, job.enforce_required)
    column = job.watermark_column
    source, last, row_key = _increment(state, source, source_path, source_type, job, result)
    if last is not None and source.isEmpty():
        result.status, result.rows_input, result.rows_output = "nothing_new", 0, 0
        return result
    key = run_key(source, job.goal, source_path, dataset, [(s.name, s.columns, sorted(s.params.items())) for s in job.steps], job.domain,
                  list(job.keys), column, last, job.drift_policy, job.gate, job.enforce_required, job.pattern_mode, job.lookback, row_key)
    if not job.force:
        prior = runlog.latest_success(state.runs(), key).first()
        if prior is not None:
            found = state.read("domains", DOMAIN_SCHEMA).where(F.col("run_id") == prior["run_id"]).first()
            return Result(prior["run_id"], "success", True, prior["output_path"], found["domain"] if found else job.domain or "unknown",
                          rows_input=prior["rows_input"], rows_output=prior["rows_output"], null_watermarks=result.null_watermarks,
                          late_rows=result.late_rows)
    if source_type != "parquet" and column is None:
        source = _landed(source)
    now = datetime.datetime.now(datetime.timezone.utc)
    state.record(run_id=run_id, run_key=key, source_path=source_path, source_type=source_type, status="running",
                 retry_count=0, started_at=now)
    published = False
    try:
        original = A.profile(source)
        values = original.select(F.explode("sample_values").alias("value"))
        detected = M.detect_domain(source, job.goal, values) if not job.domain else {
            "domain": job.domain, "confidence": 1.0, "method": "given", "low_confidence": False}
        domain = result.domain = detected["domain"]
        spark.createDataFrame([(run_id, domain, float(detected["confidence"]), detected["method"])], DOMAIN_SCHEMA).write.mode("append").parquet(
            state.path("domains"))
        plan.check(domain, job.enforce_required)
        rules = R.rules_for(domain)
        inferred = A.settle(infer.infer_schema(source))
        prior = state.catalogue().where(F.col("source_path") == source_path)
        stored = D.schema_rows(D.latest_schema(prior))
        current = inferred.select("column", F.col("inferred_type").alias("type"))
        changes = D.compare_schemas(stored.select("column", "type"), current)
        result.drift = D.drift_gate(D.drift_summary(changes, prior_exists=not stored.isEmpty()), job.drift_policy)

        output = plan.apply(source)
        try:
            result.sql = plan.to_sql(source, "source")
        except ValueError:
            result.sql = None
        pairs = M.table_rules(output, domain)
        of_rows = V.row_pairs(pairs)
        counted, observed = I.observe_rows(output, f"rows-{run_id}", *V.violation_counts(output, of_rows, job.as_of))
        counted.write.mode("overwrite").parquet(paths.data())
        written = spark.read.parquet(paths.data())
        result.rows_output = observed.get["rows"]
        first = original.first()
        result.rows_input = first["total_rows"] if first else 0
        violations = _violations(source, written, pairs, [observed.get[f"v_{i}"] for i in range(len(of_rows))], rules, list(job.keys), plan)
        violations.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(state.path("rule_results"))
        result.violations = [(r["name"], r["column"], r["violation_count"]) for r in violations.where("NOT passed").orderBy("name", "column").collect()]

        targets = current.withColumn("inferred_type", F.col("type"))
        checks = A.settle(Q.quality_checks(written, original, targets, plan.applied, rules["validation_rules"])
                          .unionByName(Q.rule_checks(violations)))
        watched = {r["column"] for r in Q.target_columns(checks, A.risk_columns(original)).collect()}
        rows, keys = _named_rows(written, job.keys)
        numbers = [c for c in C.numeric_columns(written) if not watched or c in watched]
        fences = N.quartile_bounds(written, numbers) if numbers else {}
        cells = N.detect_anomalies(rows, keys, watched or written.columns, job.pattern_mode, bounds=fences)
        # Written once; counts, examples and explanations read the stored cells.
        V.redact(cells, rules["sensitive_columns"]).write.mode("overwrite").parquet(paths.anomalies())
        found = spark.read.parquet(paths.anomalies())
        summary = A.settle(N.anomaly_summary(found, keys))
        after = A.profile(written)
        hidden = F.lower("column").isin(*[c.lower() for c in rules["sensitive_columns"]])
        texts = N.explain_anomalies(summary, after, N.bounds_frame(written, fences))
        texts = texts.withColumn("explanation", F.when(hidden, F.lit("***")).otherwise(F.col("explanation")))
        tag = F.lit(run_id)
        report.write_report(report.quality_report(
            checks.withColumn("run_id", tag), summary.withColumn("run_id", tag),
            texts.withColumn("run_id", tag), gate=job.gate), paths.report())
        report.append_check_results(checks, run_id, state.path("check_results"))
        passed = Q.verdict(checks, job.gate).first()["overall_passed"]
        if not passed:
            _finish(state, result, run_id, False)
            return result

        result.tests = column_tests.read_tests(column_tests.suggest_tests(after))
        newest = None
        if column is not None:
            row = I.new_watermark(source, column, last).first()
            newest = row["watermark_value"]
            if row_key and set(row_key) <= set(source.columns):
                source.select(*map(C.col, row_key)).distinct().write.parquet(state.path(f"seen/{run_id}"))
        promote(spark, paths.staging, paths.final)
        # From here the data is published; a failure leaves that on record.
        published, result.output_path = True, paths.data(final=True)
        result.status = "catalogue_pending"
        _finish(state, result, run_id, True)
        docs = K.column_docs(original, inferred, rules["sensitive_columns"])
        K.append_entry(K.catalogue_entry(docs, dataset, source_path, source_type, result.rows_output, run_id),
                       state.path("catalogue"))
        L.lineage_edges(plan, source, run_id, source_path, dataset).write.mode("append").parquet(state.path("lineage"))
        # The watermark moves only now, after everything it stands for is in place.
        result.status = "success"
        _finish(state, result, run_id, True, column, newest)
        return result
    except Exception:
        if not published:
            result.status = "failed"
            _finish(state, result, run_id, None)
        raise


def _violations(source: DataFrame, written: DataFrame, pairs: list[tuple[str, str]], counts: list[int], rules: dict, keys: list[str],
                plan: TransformPlan) -> DataFrame:
    """``(name, column, violation_count, passed)`` of the domain's rules and of its forbidden changes, settled."""
    spark = written.sparkSession
    rows = [(n, c, v, v == 0) for (n, c), v in zip(V.row_pairs(pairs), counts)]
    parts = [spark.createDataFrame(rows, V.RESULT)]
    for name, column in pairs:
        if name in V.UNIQUE_RULES:
            parts.append(V.unique_violations(written, name, column).withColumn("passed", F.col("violation_count") == 0))
    parts.append(V.forbidden_checks(source, written, rules["forbidden_transforms"], keys, rules["sensitive_columns"],
                                    "dedup_by_id" in plan.applied))
    return A.settle(A.union_all(parts))


def _named_rows(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The table and the columns that name its rows: the keys, else an id column, else a digest of the whole row."""
    known = list(keys) or C.id_columns(df)[:1]
    if known:
        return df, known
    name = "row_digest"
    while name in df.columns:
        name += "_"
    low, high = A.row_digest(df)
    return df.select("*", F.concat(F.hex(low), F.hex(high)).alias(name)), [name]


def _finish(state: State, result: Result, run_id: str, passed: bool | None, column: str | None = None,
            watermark: str | None = None) -> None:
    state.record(
        run_id=run_id, status=result.status, quality_passed=passed, rows_input=result.rows_input,
        rows_output=result.rows_output, output_path=result.output_path, watermark_column=column,
        watermark_value=watermark, completed_at=datetime.datetime.now(datetime.timezone.utc))
