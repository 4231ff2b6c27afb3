"""Incremental ingest as a stream of new files, each row taken once and none lost without a trace."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.functions.columns import col


def new_file_rows(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A stream over the files of a folder; the checkpoint remembers which were read."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def drop_repeats(rows: DataFrame, time: str, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    """Rows repeated within ``delay`` of each other dropped; state is bounded by the watermark.

    Rows later than ``delay`` are dropped by the engine, uncounted; :func:`split_late` keeps them.
    """
    return (
        rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
        .dropDuplicatesWithinWatermark(list(keys)))


def ingest(rows: DataFrame, target: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append everything available now to a table, exactly once per file and key."""
    return (
        rows.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target))


def _stored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        # Only a table that was never written counts as empty.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


_MARKS = "batch_id long, newest timestamp, accepted long, repeated long, late long"


def split_late(target: str, late: str, state: str, time: str, keys: Sequence[str], delay: str = "1 day") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: first rows of their key go to ``target``, rows behind the watermark to ``late``, repeats are counted.

    The watermark is the newest time of all batches before, less ``delay``. A row before it, or without a
    time, is late, whatever its key. Keys of the rows taken since the watermark are kept, so what
    a batch reads of the past is bounded by ``delay``. Every batch overwrites its own ``batch_id`` folders
    and its row of ``marks`` last, so a batch replayed after a failure leaves one copy.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = _stored(spark, f"{state}/marks", _MARKS).where(F.col("batch_id") < batch_id)
        newest = marks.agg(F.max("newest")).first()[0]
        when = col(time).cast("timestamp")
        bound = F.lit(None).cast("timestamp") if newest is None else F.lit(newest) - F.expr(f"INTERVAL {delay}")
        behind = when.isNull() | F.coalesce(when < bound, F.lit(False))
        batch.persist()
        try:
            batch.where(behind).write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
            names = [f"_k{i}" for i in range(len(keys))]
            kept = batch.where(~behind).withColumns({n: col(k) for n, k in zip(names, keys)})
            schema = T.StructType([T.StructField(n, batch.schema[k].dataType) for n, k in zip(names, keys)]
                                  + [T.StructField("_at", T.TimestampType()), T.StructField("batch_id", T.LongType())])
            seen = _stored(spark, f"{state}/seen", schema).where(F.col("batch_id") < batch_id)
            seen = seen if newest is None else seen.where(F.col("_at") >= bound)
            same = F.lit(True)
            for n in names:
                same &= F.col(n).eqNullSafe(F.col(f"s{n}"))
            known = seen.select(*[F.col(n).alias(f"s{n}") for n in names]).distinct()
            fresh = kept.dropDuplicates(names).join(known, same, "left_anti")
            fresh.drop(*names).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
            # From what was written: the rows chosen among repeats are settled by now.
            taken = spark.read.schema(batch.schema).parquet(f"{target}/batch_id={batch_id}")
            taken.select(*[col(k).alias(n) for n, k in zip(names, keys)], when.alias("_at")).write.mode("overwrite").parquet(f"{state}/seen/batch_id={batch_id}")
            sizes = batch.agg(F.count_if(behind).alias("late"), F.count_if(~behind).alias("on_time"), F.max(when).alias("newest")).first()
            accepted = taken.count()
            spark.createDataFrame([(sizes["newest"], accepted, sizes["on_time"] - accepted, sizes["late"])],
                                  "newest timestamp, accepted long, repeated long, late long").write.mode("overwrite").parquet(
                f"{state}/marks/batch_id={batch_id}")
        finally:
            batch.unpersist()
    return run


def batch_marks(spark: SparkSession, state: str) -> DataFrame:
    """``(batch_id, newest, accepted, repeated, late)`` of every batch."""
    return _stored(spark, f"{state}/marks", _MARKS)


def ingest_split(rows: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands everything available now to ``run``, batch by batch."""
    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
