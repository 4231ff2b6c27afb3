"""CSV and Parquet sources, delimiter detection, dataset metadata."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.functions.columns import type_name
from tablewright.rules import DELIMITERS


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, length)`` of the files below a path; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs
    for batch in batches:
        lines = []
        for path in batch["path"]:
            # Hadoop writes local paths with one slash.
            uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "///" not in path else path
            try:
                system, name = fs.FileSystem.from_uri(uri)
            except Exception:  # noqa: BLE001 - a store that only Spark opens; its header comes from there
                lines.append(None)
                continue
            text = b""
            with system.open_input_stream(name) as stream:
                while b"\n" not in text:
                    block = stream.read(65536)
                    if not block:
                        break
                    text += block
            lines.append(text.split(b"\n", 1)[0].decode("utf-8", "replace"))
        yield pd.DataFrame({"path": batch["path"], "header": lines})


def _spark_first_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, header)`` by Spark's own text reader: the first line of a file's first split."""
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path).select(
        "value", "_metadata.file_path", "_metadata.file_block_start").where("file_block_start = 0")
    # Numbers grow along a split, so the smallest of a file is its first line.
    return lines.withColumn("_at", F.monotonically_increasing_id()).groupBy(F.col("file_path").alias("path")).agg(F.min_by("value", "_at").alias("header"))


def detect_delimiters(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, delimiter)`` per file: the first known delimiter in its first line, else a comma.

    Only the first line of each file is fetched, in the tasks, compressed files included. Files in a store that Arrow
    does not know are read by Spark, of whose splits only a file's first counts.
    """
    headers = list_files(spark, path, glob).select("path").mapInPandas(_first_lines, "path string, header string")
    if not headers.where("header IS NULL").isEmpty():
        headers = _spark_first_lines(spark, path, glob)
    found = F.coalesce(*[F.when(F.contains("header", F.lit(d)), d) for d in DELIMITERS], F.lit(DELIMITERS[0]))
    return headers.select("path", found.alias("delimiter"))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, schema: T.StructType | str | None = None,
             **options: str) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given.

    Without ``sep`` the files' own delimiter is used; files of one table that
    disagree on it are read delimiter by delimiter.
    """
    reader = spark.read.option("header", "true").options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    if sep is not None:
        return reader.option("sep", sep).csv(path)
    kinds = detect_delimiters(spark, path).groupBy("delimiter").agg(F.count(F.lit(1)).alias("files"))
    delimiters = sorted(r["delimiter"] for r in kinds.collect())
    if len(delimiters) <= 1:
        return reader.option("sep", delimiters[0] if delimiters else DELIMITERS[0]).csv(path)
    files = detect_delimiters(spark, path)
    frames = None
    for d in delimiters:
        # The reader takes a list of paths, so the names of this delimiter's files are needed here.
        names = [r["path"] for r in files.where(F.col("delimiter") == d).select("path").toLocalIterator()]
        part = reader.option("sep", d).csv(names)
        frames = part if frames is None else frames.unionByName(part)
    return frames


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_file_source(spark: SparkSession, path: str, source_type: str | None = None, **options) -> DataFrame:
    """Parquet by type or suffix, anything else as CSV."""
    if source_type == "parquet" or path.rstrip("/").lower().endswith((".parquet", ".pq")):
        return read_parquet(spark, path)
    return read_csv(spark, path, **options)


def describe_columns(df: DataFrame) -> DataFrame:
    """``(position, column, type)``."""
    rows = [(i, f.name, type_name(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def metadata(df: DataFrame, path: str | None = None, key: list[str] | None = None) -> dict:
    """Row count, columns, types, size in MB (of files) and the first five rows."""
    first = df.orderBy(*key) if key else df
    size = None
    if path is not None:
        total = list_files(df.sparkSession, path).agg(F.sum("length")).first()[0] or 0
        size = round(total / (1024 * 1024), 4)
    return {
        "row_count": df.count(),
        "column_names": df.columns,
        "column_types": {f.name: type_name(f.dataType) for f in df.schema.fields},
        "size_mb": size,
        "first_5_rows": [r.asDict() for r in first.limit(5).collect()],
    }
