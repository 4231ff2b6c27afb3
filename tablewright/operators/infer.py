"""Semantic type inference over whole columns, in one scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.functions import sql as S
from tablewright.functions.columns import TEMPORAL, col, fields, is_integral, type_name
from tablewright.schemas import SEMANTIC_SCHEMA

# Shares of the non-blank values that must fit.
NUMERIC_SHARE = 0.90
DATE_SHARE = 0.70

def infer_schema(df: DataFrame, columns: Iterable[str] | None = None,
                 numeric_share: float = NUMERIC_SHARE, date_share: float = DATE_SHARE) -> DataFrame:
    """One row per column (``SEMANTIC_SCHEMA``): numeric, then date, then boolean, then as it is.

    Native integers count as dates only if the column name speaks of a date or
    time; native numbers and temporal columns need no cast.
    """
    chosen = fields(df, columns)
    tests = _tests(df, chosen)
    filled = "values > 0"
    as_text = "kind = 'text'"
    numeric = f"{filled} AND {as_text} AND try_divide(numeric_hits, values) >= {numeric_share}"
    dated = f"{filled} AND size(date_hits) > 0 AND try_divide(date_total, values) >= {date_share}"
    boolean = f"{filled} AND all_boolean"
    chosen_type = (
        f"CASE WHEN {as_text} AND NOT ({filled}) THEN 'STRING' WHEN {numeric} THEN 'DOUBLE'"
        f" WHEN {dated} THEN 'DATE' WHEN {boolean} THEN 'BOOLEAN' ELSE original_type END"
    )
    cast = (
        f"CASE WHEN {numeric} THEN 'strip_currency_prefix_and_cast_float'"
        f" WHEN {dated} THEN 'parse_mixed_dates'"
        f" WHEN {boolean} AND original_type <> 'BOOLEAN' THEN 'normalise_boolean' END"
    )
    return (
        tests.withColumn("date_total", F.expr("aggregate(date_hits, 0L, (s, e) -> s + e.hits)"))
        .select(
            "column", F.expr(chosen_type).alias("inferred_type"), "original_type",
            F.expr(f"{cast} IS NOT NULL").alias("needs_cast"), F.expr(cast).alias("suggested_cast"),
            (F.col("nulls") > 0).alias("nullable"),
            F.expr(f"CASE WHEN NOT ({numeric}) AND {dated} THEN date_hits.label END").alias("detected_formats"),
        )
        .to(SEMANTIC_SCHEMA)
    )


# What one cell is, as a number: nothing, blank, or the sum of what its text could be.
_NULL, _BLANK, _VALUE, _NUMERIC, _BOOLEAN, _FORMAT = 0, 1, 2, 4, 8, 16


def _tests(df: DataFrame, chosen: list[T.StructField]) -> DataFrame:
    """Per column the raw counts the decision needs, from one scan however many columns there are.

    Every cell becomes a row (position, kind, text) that never leaves its task: it is trimmed and classified
    once, by code that does not grow with the columns, and what is shuffled are the counts of the few dozen classes of each column.
    """
    cells = []
    for i, f in enumerate(chosen):
        c = col(f.name)
        if isinstance(f.dataType, T.StringType):
            kind, text = "text", c
        elif isinstance(f.dataType, T.BooleanType):
            kind, text = "flag", F.when(c.isNotNull(), "true")
        elif is_integral(f.dataType):
            # A whole number speaks of a date only if its name does.
            kind, text = "dated" if any(k in f.name.lower() for k in ("date", "time")) else "whole", c.cast("string")
        else:
            kind, text = "temporal" if isinstance(f.dataType, TEMPORAL) else "native", F.when(c.isNotNull(), "x")
        cells.append(F.struct(F.lit(i).alias("i"), F.lit(kind).alias("cell"), text.alias("text")))
    rows = df.select(F.inline(F.array(*cells))).select("i", "cell", F.expr(S.stripped("text")).alias("t"))
    format_ = f"CASE WHEN cell IN ('text', 'dated') AND (cell = 'dated' OR length(t) IN (8, 10)) THEN {_format_code('t')} END"
    numeric = f"cell = 'text' AND {S.currency_text('t')} RLIKE r'{S.FLOAT_OR_NAN}'"
    boolean = (f"CASE cell WHEN 'text' THEN length(t) <= 5 AND lower(t) IN ({S.tokens(S.BOOLEAN_FALSE + S.BOOLEAN_TRUE)})"
               " WHEN 'flag' THEN true WHEN 'whole' THEN t IN ('0', '1') WHEN 'dated' THEN t IN ('0', '1') ELSE false END")
    code = (f"CASE WHEN t IS NULL THEN {_NULL} WHEN t = '' THEN {_BLANK} ELSE {_VALUE} + if({numeric}, {_NUMERIC}, 0) + if({boolean}, {_BOOLEAN}, 0)"
            f" + {_FORMAT} * coalesce({format_} + 1, 0) END")
    counts = rows.select("i", F.expr(code).alias("code")).groupBy("i", "code").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame(
        [(i, f.name, type_name(f.dataType), "text" if isinstance(f.dataType, T.StringType) else "temporal" if isinstance(f.dataType, TEMPORAL) else "native",
          isinstance(f.dataType, T.BooleanType)) for i, f in enumerate(chosen)], "i int, column string, original_type string, kind string, flag boolean")
    hits = [f"named_struct('label', '{label}', 'hits', sum(if(code >= {_FORMAT} AND code div {_FORMAT} = {j + 1}, n, 0L)))"
            for j, (label, _) in enumerate(S.DATE_PATTERNS)]
    tested = counts.groupBy("i").agg(
        F.expr(f"sum(if(code = {_NULL}, n, 0L))").alias("nulls"), F.expr(f"sum(if(code >= {_VALUE}, n, 0L))").alias("values"),
        F.expr(f"sum(if(code & {_NUMERIC} > 0, n, 0L))").alias("numeric_hits"), F.expr(f"sum(if(code & {_BOOLEAN} > 0, n, 0L))").alias("boolean_hits"),
        F.expr(f"filter(array({', '.join(hits)}), e -> e.hits > 0)").alias("date_hits"))
    whole = F.broadcast(names).join(tested, "i", "left")
    none = "CAST(array() AS array<struct<label:string,hits:bigint>>)"
    return whole.select(
        "column", "original_type", "kind", F.coalesce("nulls", F.lit(0)).alias("nulls"), F.coalesce("values", F.lit(0)).alias("values"),
        F.coalesce("numeric_hits", F.lit(0)).alias("numeric_hits"),
        (F.col("flag") | F.coalesce((F.col("values") > 0) & (F.col("boolean_hits") == F.col("values")), F.lit(False))).alias("all_boolean"),
        F.expr(f"coalesce(date_hits, {none})").alias("date_hits"))


def _format_code(text: str) -> str:
    """Position of the first date pattern a text fits."""
    whens = " ".join(f"WHEN {text} RLIKE r'{p}' THEN {j}" for j, (_, p) in enumerate(S.DATE_PATTERNS))
    return f"CASE {whens} END"
