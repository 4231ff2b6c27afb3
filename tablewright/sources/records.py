"""Landed JSON records: files of documents that may wrap their rows in an envelope."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.rules import ENVELOPE_KEYS


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   multi_line: bool = True) -> DataFrame:
    """One row per JSON document; documents spread over lines make each file one unit of work."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    return (reader.schema(schema) if schema is not None else reader).json(path)


def _list_keys(documents: DataFrame) -> list[str]:
    return [k for k in ENVELOPE_KEYS if k in documents.columns
            and isinstance(documents.schema[k].dataType, T.ArrayType)
            and isinstance(documents.schema[k].dataType.elementType, T.StructType)]


def unwrap(documents: DataFrame, keep: Sequence[str] = (), bare: bool | None = None) -> DataFrame:
    """The records inside the documents.

    A document's records are the first envelope list it holds, in the fixed
    key order; a document without one is itself a record. ``bare`` says whether
    such documents occur; by default one is looked for, because their columns
    become part of the result.
    """
    keys = _list_keys(documents)
    names = [c for c in documents.columns if c not in keys]
    held = {k: documents.select(*keep, F.inline(k)) for k in keys}
    enveloped = F.lit(False)
    for k in keys:
        enveloped = enveloped | F.col(k).isNotNull()
    lone = bool(names) and (not keys or (not documents.where(~enveloped).isEmpty() if bare is None else bare))
    parts = [*held.values(), *([documents.select(*names)] if lone else [])]
    # What the records of all envelopes have in common is known without reading any.
    schema = parts[0]
    for p in parts[1:]:
        schema = schema.unionByName(p, allowMissingColumns=True)
    fields_ = [f for f in schema.schema.fields if f.name not in keep]

    def record(cell: Callable[[str], Column], known: set[str]) -> Column:
        return F.struct(*[(cell(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields_])

    lists = [_as_records(k, held[k], record, keep) for k in keys]
    if lone:
        lists.append(F.array(record(lambda n: F.col(n), set(names))))
    # One pass: each document gives the first list it holds.
    return documents.select(*keep, F.inline(F.coalesce(*lists)))


def _as_records(key: str, part: DataFrame, record: Callable[[Callable[[str], Column], set[str]], Column], keep: Sequence[str]) -> Column:
    known = {c for c in part.columns if c not in keep}
    return F.transform(key, lambda r: record(lambda n: r[n], known))


def pagination(documents: DataFrame) -> DataFrame:
    """What an envelope says besides its records: one ``info`` struct row per document."""
    keys = _list_keys(documents)
    rest = [c for c in documents.columns if c not in keys]
    if not keys or not rest:
        return documents.sparkSession.createDataFrame([], "info struct<>")
    enveloped = F.lit(False)
    for k in keys:
        enveloped = enveloped | F.col(k).isNotNull()
    return documents.where(enveloped).select(F.struct(*rest).alias("info"))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return unwrap(read_documents(spark, path, schema))


def unwrap_text(df: DataFrame, column: str, record: str, keep: Sequence[str] = ()) -> DataFrame:
    """Records of envelopes held as JSON text, with a given record schema (DDL)."""
    lists = ", ".join(f"{k} array<struct<{record}>>" for k in ENVELOPE_KEYS)
    document = F.from_json(F.col(column), lists)
    first = F.coalesce(*[F.col(f"_doc.{k}") for k in ENVELOPE_KEYS])
    return df.withColumn("_doc", document).select(*keep, F.inline(first))
