"""Writing tables: staging, promotion, read-back and fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions.columns import col, fields, groupable, type_name
from tablewright.sources.files import list_files


@dataclass(frozen=True)
class RunPaths:
    """Where a run writes: everything in staging first, all of it renamed to final at once."""

    output: str
    run_id: str

    @property
    def staging(self) -> str:
        return f"{self.output.rstrip('/')}/{self.run_id}/staging"

    @property
    def final(self) -> str:
        return f"{self.output.rstrip('/')}/{self.run_id}/final"

    def data(self, final: bool = False) -> str:
        return f"{self.final if final else self.staging}/data"

    def anomalies(self, final: bool = False) -> str:
        return f"{self.final if final else self.staging}/anomalies"

    def report(self, final: bool = False) -> str:
        return f"{self.final if final else self.staging}/quality_report"


class PublishError(RuntimeError):
    pass


def write_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> dict:
    """Write Parquet and describe what was written, from the written files."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark = df.sparkSession
    back = spark.read.parquet(path)
    size = list_files(spark, path, "*.parquet").agg(F.sum("length")).first()[0] or 0
    return {
        "output_path": path, "row_count": back.count(), "columns": back.columns,
        "schema": {f.name: type_name(f.dataType) for f in back.schema.fields},
        "file_size_mb": round(size / (1024 * 1024), 4),
    }


def promote(spark: SparkSession, staging: str, final: str, overwrite: bool = False) -> str | None:
    """Rename staging to final; an older final is set aside, not deleted, and its new path returned."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    source, target = path(staging), path(final)
    system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = None
    if system.exists(target):
        if not overwrite:
            raise PublishError(f"{final} exists")
        aside = f"{final}-{uuid.uuid4().hex}"
        if not system.rename(target, path(aside)):
            raise PublishError(f"could not move {final} aside")
    if not system.rename(source, target):
        raise PublishError(f"could not rename {staging} to {final}")
    return aside


def staged_publish(df: DataFrame, staging: str, final: str, gate: Callable[[DataFrame], bool],
                   overwrite: bool = False) -> bool:
    """Write to staging, check the written table, promote it only if the gate passes."""
    df.write.mode("overwrite").parquet(staging)
    if not gate(df.sparkSession.read.parquet(staging)):
        return False
    promote(df.sparkSession, staging, final, overwrite)
    return True


FINGERPRINT_MODULUS = 1_000_003


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """``(row_count, hash_xor, hash_sum)`` of all rows in any order, from one aggregate.

    Equal rows cancel in the xor; the sum tells them apart. ``portable`` hashes
    with MD5 of the cells' text instead of Spark's own hash.
    """
    names = list(columns or df.columns)
    if portable:
        text = F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in names])
        code = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    else:
        # Null flags, because hashing skips nulls.
        code = F.xxhash64(*[x for f in fields(df, names) for x in (col(f.name).isNull(), groupable(f))])
    return df.select(code.alias("_code")).agg(
        F.count(F.lit(1)).alias("row_count"), F.bit_xor("_code").alias("hash_xor"),
        F.sum(F.pmod("_code", F.lit(FINGERPRINT_MODULUS))).alias("hash_sum"))


def run_key(df: DataFrame, goal: str, *settings: object) -> str:
    """Key of (data, schema, goal, settings) under which an equal earlier run is found.

    ``settings`` are values whose ``repr`` tells them apart: source, steps, domain, limits.
    """
    goal = repr((goal, df.schema.simpleString(), df.columns, *settings))
    row = fingerprint(df).select(F.sha2(F.concat_ws("|", *["row_count", "hash_xor", "hash_sum"]), 256).alias("d"),
                                 F.sha2(F.lit(goal), 256).alias("g")).first()
    return f"{row['d'][:16]}-{row['g'][:8]}"
