"""The quality gate run on every increment of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.checks import quality_checks, verdict
from tablewright.operators.profile import column_stats


def gate_increment(original: DataFrame, target: str, rejected: str, results: str,
                   prepare: Callable[[DataFrame], DataFrame] = lambda df: df, schema: DataFrame | None = None,
                   rules: Iterable[str] = (), gate: Sequence[str] = ("critical",)) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: prepare, check, then write to target or rejected.

    Each batch overwrites its own ``batch_id`` folder, so a batch replayed
    after a failure leaves one copy. The row-count check compares a batch with
    itself before preparation; the other checks use the original profile.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            after = prepare(batch)
            rows_in = column_stats(batch, batch.columns[:1]).select("total_rows").first()[0]
            baseline = original.withColumn("total_rows", F.lit(rows_in).cast("long")).withColumn(
                "null_count", F.round(F.col("null_rate") * rows_in).cast("long"))
            checks = quality_checks(after, baseline, schema, rules=rules)
            checks.write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")
            stored = spark.read.parquet(f"{results}/batch_id={batch_id}")
            passed = verdict(stored, tuple(gate)).first()["overall_passed"]
            after.write.mode("overwrite").parquet(f"{target if passed else rejected}/batch_id={batch_id}")
        finally:
            batch.unpersist()
    return run


def gated_ingest(rows: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
