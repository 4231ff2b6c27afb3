"""Catalogue, transform library and column documentation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.vectors import most_similar
from tablewright.schemas import CATALOGUE_SCHEMA, LIBRARY_SCHEMA


def column_docs(prof: DataFrame, schema: DataFrame | None = None, sensitive: Iterable[str] = ()) -> DataFrame:
    """``(column, type, description)``: one sentence per column from its profile; of sensitive columns without their values."""
    rows = prof.withColumn("type", F.col("dtype"))
    if schema is not None:
        rows = rows.join(F.broadcast(schema.select("column", "inferred_type")), "column", "left").withColumn(
            "type", F.coalesce("inferred_type", "dtype"))
    base = F.format_string("%s column, %.2f%% null, %d distinct values", "type", F.col("null_rate") * 100, "unique_count")
    hidden = F.lower("column").isin(*[c.lower() for c in sensitive])
    span = F.when(F.col("min").isNotNull() & ~hidden, F.format_string(", from %s to %s", "min", "max")).otherwise("")
    return rows.select("column", "type", F.concat(base, span, F.lit(".")).alias("description"))


def catalogue_entry(docs: DataFrame, dataset_name: str, source_path: str, source_type: str, row_count: int,
                    run_id: str, embedding: Sequence[float] | None = None) -> DataFrame:
    """One catalogue row; the maps hold one entry per column of the dataset."""
    vector = F.lit(None) if embedding is None else F.array(*[F.lit(float(x)) for x in embedding])
    return docs.agg(
        F.map_from_entries(F.collect_list(F.struct("column", "type"))).alias("schema"),
        F.map_from_entries(F.collect_list(F.struct("column", "description"))).alias("column_descriptions"),
    ).select(
        F.uuid().alias("catalogue_id"), F.lit(dataset_name).alias("dataset_name"),
        F.lit(source_path).alias("source_path"), F.lit(source_type).alias("source_type"),
        "schema", "column_descriptions", F.lit(row_count).cast("long").alias("row_count"),
        vector.cast("array<float>").alias("embedding"), F.lit(run_id).alias("run_id"),
        F.current_timestamp().alias("created_at"),
    ).to(CATALOGUE_SCHEMA)


def append_entry(entry: DataFrame, path: str) -> None:
    entry.write.mode("append").parquet(path)


def search_catalogue(catalogue: DataFrame, query: Sequence[float], k: int = 5,
                     ties: str = "catalogue_id") -> DataFrame:
    """The k catalogued datasets most similar to a query vector."""
    return most_similar(catalogue, "embedding", query, k, ties)


def search_library(library: DataFrame, query: Sequence[float], tags: Sequence[str] | None = None, k: int = 5,
                   ties: str = "library_id") -> DataFrame:
    """The k library entries most similar to a query vector, among those sharing a tag if any are given."""
    if tags:
        library = library.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return most_similar(library, "embedding", query, k, ties)


def usage_events(found: DataFrame) -> DataFrame:
    """Events to append for returned entries."""
    return found.select("library_id", F.current_timestamp().alias("used_at"))


def with_use_count(library: DataFrame, usage: DataFrame) -> DataFrame:
    """The library with ``use_count``, counted from the usage events."""
    counts = usage.groupBy("library_id").agg(F.count(F.lit(1)).alias("use_count"))
    return library.join(counts, "library_id", "left").na.fill(0, ["use_count"])


def new_entries(candidates: DataFrame, library: DataFrame, quality_passed: str | None = "quality_passed") -> DataFrame:
    """Candidates from passing runs whose name the library does not hold yet.

    Of several candidates with one name the smallest id is kept. The check and
    the append are not atomic: one writer at a time.
    """
    if quality_passed is not None:
        candidates = candidates.where(F.col(quality_passed)).drop(quality_passed)
    others = [c for c in candidates.columns if c != "name"]
    fresh = candidates.groupBy("name").agg(F.min_by(F.struct(*others), "library_id").alias("_entry"))
    return fresh.join(library.select("name").distinct(), "name", "left_anti").select("name", "_entry.*")


def library_entry(spark, name: str, description: str, steps: str, tags: Sequence[str],
                  embedding: Sequence[float] | None = None) -> DataFrame:
    row = (None, name, description, steps, list(tags), None if embedding is None else [float(x) for x in embedding])
    return spark.createDataFrame([row], LIBRARY_SCHEMA).withColumn("library_id", F.uuid())
