"""Choosing columns by name or type."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.sql import quote

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col(quote(name))


def groupable(f: T.StructField) -> Column:
    """The column in a form that can be grouped and hashed: maps and variants as JSON text."""
    kind = f.dataType.simpleString()
    return F.to_json(col(f.name)).alias(f.name) if "map<" in kind or "variant" in kind else col(f.name)


def fields(df: DataFrame, columns: Iterable[str] | None = None) -> list[T.StructField]:
    if columns is None:
        return list(df.schema.fields)
    wanted = list(columns)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return [df.schema[c] for c in wanted]


def name_contains(df: DataFrame, *keywords: str) -> list[str]:
    return [c for c in df.columns if any(k in c.lower() for k in keywords)]


def name_tokens(df: DataFrame, *keywords: str) -> list[str]:
    """Columns with one of the keywords as a whole ``_``-separated word."""
    return [c for c in df.columns if set(re.split(r"[^a-z0-9]+", c.lower())) & set(keywords)]


def name_words(df: DataFrame, exact: Iterable[str] = (), endings: tuple[str, ...] = ()) -> list[str]:
    """Columns with a ``_``-separated word that is one of ``exact`` or ends in one of ``endings``."""
    words = set(exact)
    return [c for c in df.columns if any(w in words or (endings and w.endswith(endings)) for w in re.split(r"[^a-z0-9]+", c.lower()))]


def id_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower().endswith("_id") or c.lower() == "id"]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, INTEGRAL) or (
        isinstance(data_type, T.DecimalType) and data_type.scale == 0)


def type_name(data_type: T.DataType) -> str:
    return data_type.simpleString().upper()


def by_type(df: DataFrame, columns: Iterable[str]) -> dict[str, list[str]]:
    """Columns grouped by their exact data type, for one unpivot per type."""
    groups: dict[str, list[str]] = {}
    for f in fields(df, columns):
        groups.setdefault(f.dataType.simpleString(), []).append(f.name)
    return groups
