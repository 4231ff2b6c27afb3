"""One door to every source type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.sources import files, jdbc, records

SOURCE_TYPES = ("csv", "parquet", "postgres", "api")


def open_source(spark: SparkSession, address: str, source_type: str, **options) -> DataFrame:
    """A DataFrame over files, a table (``connection::table``) or landed JSON documents (``api``).

    A table is read by one task unless ``partition_column`` is given: then by ``partitions`` ranges of it, between
    ``lower`` and ``upper`` or the bounds that the table has.
    """
    if source_type in ("csv", "parquet"):
        return files.read_file_source(spark, address, source_type, **options)
    if source_type == "postgres":
        connection, table = jdbc.split_address(address)
        if options.get("partition_column") and options.get("lower") is None:
            column, partitions = options.pop("partition_column"), options.pop("partitions", spark.sparkContext.defaultParallelism)
            return jdbc.read_table_split(spark, connection, table, column, partitions, **options)
        return jdbc.read_table(spark, connection, table, **options)
    if source_type == "api":
        return records.read_records(spark, address, **options)
    raise ValueError(f"source type must be one of {SOURCE_TYPES}: {source_type}")
