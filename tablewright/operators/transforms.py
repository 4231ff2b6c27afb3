"""Named cleaning transforms.

A column transform is SQL text per cell, so the DataFrame form, the emitted SQL
and the lineage all come from one definition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright import rules as R
from tablewright.functions import columns as C, sql as S
from tablewright.operators.rows import keep_first

# Fixed value: pounds to dollars.
DEFAULT_RATE = 1.27


def _as_text(f: T.StructField) -> str:
    c = S.quote(f.name)
    return c if isinstance(f.dataType, T.StringType) else f"CAST({c} AS STRING)"


def _currency(f: T.StructField, **_: Any) -> str:
    if isinstance(f.dataType, T.NumericType):
        return f"CAST({S.quote(f.name)} AS DOUBLE)"
    return S.currency_number(_as_text(f))


def _converted(f: T.StructField, rate: float = DEFAULT_RATE, **_: Any) -> str:
    return f"({_currency(f)}) * {float(rate)!r}D"


def _date(f: T.StructField, keep_time: bool = False, **_: Any) -> str:
    """The day; with ``keep_time`` a timestamp stays as it is."""
    if isinstance(f.dataType, C.TEMPORAL):
        return S.quote(f.name) if keep_time else f"to_date({S.quote(f.name)})"
    return S.mixed_date(_as_text(f))


def _boolean(f: T.StructField, **_: Any) -> str:
    if isinstance(f.dataType, T.BooleanType):
        return S.quote(f.name)
    return S.boolean(_as_text(f))


@dataclass(frozen=True)
class ColumnTransform:
    """``expression(field, **params)`` is the new cell; ``target`` names the column it goes to."""

    name: str
    columns: Callable[[DataFrame], list[str]]
    expression: Callable[..., str]
    target: Callable[..., str] = lambda name, **_: name
    # True if the input column goes away when the target has another name.
    replaces: bool = True

    def outputs(self, df: DataFrame, columns: Iterable[str] | None, **params: Any) -> list[tuple[str, str, str]]:
        """``(source column, target column, SQL)`` in column order."""
        chosen = C.fields(df, self.columns(df) if columns is None else columns)
        return [(f.name, self.target(f.name, **params), self.expression(f, **params)) for f in chosen]

    def select_list(self, df: DataFrame, columns: Iterable[str] | None, **params: Any) -> list[str]:
        outputs = self.outputs(df, columns, **params)
        replaced = {s: (t, e) for s, t, e in outputs if s == t or self.replaces}
        added = [(t, e) for s, t, e in outputs if s not in replaced]
        items = []
        for c in df.columns:
            if c in replaced:
                target, expression = replaced[c]
                items.append(f"{expression} AS {S.quote(target)}")
            elif c not in {t for t, _ in added}:
                items.append(S.quote(c))
        return items + [f"{e} AS {S.quote(t)}" for t, e in added]

    def apply(self, df: DataFrame, columns: Iterable[str] | None = None, **params: Any) -> DataFrame:
        return df.selectExpr(*self.select_list(df, columns, **params))

    def sql(self, df: DataFrame, source: str, columns: Iterable[str] | None = None, **params: Any) -> str:
        return f"SELECT {', '.join(self.select_list(df, columns, **params))} FROM {source}"

    def edges(self, df: DataFrame, columns: Iterable[str] | None = None, **params: Any) -> list[tuple[str, str]]:
        return [(s, t) for s, t, _ in self.outputs(df, columns, **params)]


@dataclass(frozen=True)
class DedupById:
    """Keep the first row per id; the order columns decide which is first. Rows without an id are not repeats of each other."""

    name: str = "dedup_by_id"

    def _keys(self, df: DataFrame, columns: Iterable[str] | None) -> list[str]:
        return list(columns) if columns is not None else C.id_columns(df)[:1]

    def apply(self, df: DataFrame, columns: Iterable[str] | None = None, order: Sequence[str] = (),
              keep_null_keys: bool = True) -> DataFrame:
        keys = self._keys(df, columns)
        return keep_first(df, keys, list(order) or df.columns, keep_null_keys) if keys else df

    def sql(self, df: DataFrame, source: str, columns: Iterable[str] | None = None, order: Sequence[str] = (),
            keep_null_keys: bool = True) -> str:
        keys = self._keys(df, columns)
        if not keys:
            return f"SELECT * FROM {source}"
        by = ", ".join(map(S.quote, keys))
        first = ", ".join(map(S.quote, list(order) or df.columns))
        kept = "_rank = 1"
        if keep_null_keys:
            kept += "".join(f" OR {S.quote(k)} IS NULL" for k in keys)
        return (f"SELECT {', '.join(map(S.quote, df.columns))} FROM (SELECT *, row_number() OVER"
                f" (PARTITION BY {by} ORDER BY {first}) AS _rank FROM {source}) WHERE {kept}")

    def edges(self, df: DataFrame, columns: Iterable[str] | None = None, **_: Any) -> list[tuple[str, str]]:
        return [(k, k) for k in self._keys(df, columns)]


@dataclass(frozen=True)
class DedupRows:
    name: str = "dedup_rows"

    def apply(self, df: DataFrame, columns: None = None) -> DataFrame:
        return df.distinct()

    def sql(self, df: DataFrame, source: str, columns: None = None) -> str:
        return f"SELECT DISTINCT * FROM {source}"

    def edges(self, df: DataFrame, columns: None = None) -> list[tuple[str, str]]:
        return []


@dataclass(frozen=True)
class RegisteredTransform:
    """A user function on DataFrames with declared input and output columns (no SQL form)."""

    name: str
    fn: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]

    def apply(self, df: DataFrame, columns: None = None, **params: Any) -> DataFrame:
        return self.fn(df, **params)

    def sql(self, df: DataFrame, source: str, columns: None = None, **params: Any) -> str:
        raise ValueError(f"{self.name} is a registered function without a SQL form")

    def edges(self, df: DataFrame, columns: None = None, **_: Any) -> list[tuple[str, str]]:
        return [(i, o) for o in self.outputs for i in self.inputs]


@dataclass(frozen=True)
class ArrowTransform:
    """A user function from Arrow arrays of the declared inputs to arrays of the declared outputs, a batch at a time.

    Only the inputs are handed over; other columns pass by. ``outputs`` are columns in DDL form, which
    replace columns of the same name. Lineage follows from the declaration.
    """

    name: str
    fn: Callable[..., Sequence[Any]]
    inputs: tuple[str, ...]
    outputs: T.StructType

    def apply(self, df: DataFrame, columns: Sequence[str] | None = None, **params: Any) -> DataFrame:
        given = list(columns) if columns is not None else list(self.inputs)
        if len(given) != len(self.inputs):
            raise ValueError(f"{self.name} takes {len(self.inputs)} columns")
        C.fields(df, given)
        made = [f.name for f in self.outputs]
        kept = [c for c in df.columns if c not in made]
        # Inputs come after the kept columns, under names of their own.
        rows = df.select(*[C.col(c) for c in kept], *[C.col(c).alias(f"_input_{i}_") for i, c in enumerate(given)])
        schema = T.StructType([*df.select(*[C.col(c) for c in kept]).schema.fields, *self.outputs.fields])
        fn, n, names = self.fn, len(kept), [*kept, *made]

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                arrays = fn(*batch.columns[n:], **params)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[a if isinstance(a, pa.Array) else pa.array(a) for a in arrays]], names=names)

        return rows.mapInArrow(run, schema)

    def sql(self, df: DataFrame, source: str, columns: None = None, **params: Any) -> str:
        raise ValueError(f"{self.name} is a registered function without a SQL form")

    def edges(self, df: DataFrame, columns: Sequence[str] | None = None, **_: Any) -> list[tuple[str, str]]:
        return [(i, f.name) for f in self.outputs for i in (columns or self.inputs)]


def _strings_named(*keywords: str) -> Callable[[DataFrame], list[str]]:
    return lambda df: [c for c in C.name_contains(df, *keywords) if c in C.string_columns(df)]


def _renamed(name: str, rename: dict[str, str] | None = None, **_: Any) -> str:
    return (rename or {}).get(name, name)


def _money_columns(df: DataFrame) -> list[str]:
    """Text and number columns named for an amount of money; ``coffee_type`` is not one."""
    named = C.name_words(df, ("fee", "fees"), ("price", "prices", "amount", "amounts", "cost", "costs", "total", "totals"))
    return [f.name for f in C.fields(df, named) if isinstance(f.dataType, (T.StringType, T.NumericType))]


def _date_columns(df: DataFrame) -> list[str]:
    """Text, date and timestamp columns named for a day or time; a number such as ``overtime`` is not one."""
    named = C.name_words(df, ("time", "times", "datetime", "timestamp"), ("date", "dates"))
    return [f.name for f in C.fields(df, named) if isinstance(f.dataType, (T.StringType, *C.TEMPORAL))]


_COLUMN_TRANSFORMS = [
    ColumnTransform("strip_currency_symbols",
                    _money_columns, _currency),
    ColumnTransform("convert_currency", lambda df: C.name_contains(df, "price", "amount"), _converted, _renamed),
    ColumnTransform("standardise_dates", _date_columns, _date),
    ColumnTransform(
        "flag_negative_quantity", lambda df: C.name_contains(df, "qty", "quantity")[:1],
        lambda f, **_: f"coalesce({S.quote(f.name)} < 0, false)",
        lambda name, **_: "is_return", replaces=False),
    ColumnTransform("fill_null_strings", C.string_columns,
                    lambda f, value="unknown", **_: f"coalesce({S.quote(f.name)}, {S.literal(value)})"),
    ColumnTransform("normalise_phone",
                    lambda df: C.name_tokens(df, "phone", "mobile", "tel", "telephone"),
                    lambda f, **_: S.phone(_as_text(f))),
    ColumnTransform("title_case", _strings_named("name", "title", "department", "role", "position"),
                    lambda f, **_: S.title_case(S.quote(f.name))),
    ColumnTransform("normalise_country", lambda df: C.name_tokens(df, "country"),
                    lambda f, **_: S.canonical(S.quote(f.name), R.COUNTRY_VARIANTS, S.quote(f.name))),
    ColumnTransform("normalise_boolean", lambda df: [
        f.name for f in df.schema.fields
        if f.name.lower().startswith(("is_", "has_")) and not isinstance(f.dataType, T.BooleanType)], _boolean),
    ColumnTransform("uppercase_vin", lambda df: C.name_tokens(df, "vin"),
                    lambda f, **_: f"upper({S.stripped(S.quote(f.name))})"),
    ColumnTransform("uppercase_registration", lambda df: C.name_tokens(df, "registration"),
                    lambda f, **_: f"upper({S.stripped(S.quote(f.name))})"),
    ColumnTransform("normalise_fuel_type", lambda df: C.name_tokens(df, "fuel"),
                    lambda f, **_: S.canonical(S.quote(f.name), R.FUEL_VARIANTS, f"lower({S.stripped(S.quote(f.name))})")),
    ColumnTransform("normalise_department", lambda df: C.name_tokens(df, "department"),
                    lambda f, **_: f"initcap(regexp_replace({S.stripped(S.quote(f.name))}, r'\\s+', ' '))"),
    ColumnTransform("uppercase_icd", lambda df: C.name_tokens(df, "icd") or C.name_contains(df, "diagnosis_code"),
                    lambda f, **_: f"upper({S.stripped(S.quote(f.name))})"),
]

TRANSFORMS: dict[str, Any] = {t.name: t for t in [*_COLUMN_TRANSFORMS, DedupById(), DedupRows()]}

# Other names under which the rule lists and the stored library know the transforms.
ALIASES = {
    "strip_currency_symbols_from_numeric_columns": "strip_currency_symbols",
    "strip_currency_symbols_from_price_columns": "strip_currency_symbols",
    "currency_symbol_stripping": "strip_currency_symbols",
    "gbp_to_usd_conversion": "convert_currency",
    "standardise_transaction_dates_to_iso8601": "standardise_dates",
    "standardise_dates_to_iso8601": "standardise_dates",
    "mixed_date_standardisation": "standardise_dates",
    "deduplicate_by_transaction_id": "dedup_by_id",
    "deduplicate_by_employee_id": "dedup_by_id",
    "deduplicate_by_order_id": "dedup_by_id",
    "dedup_by_id_column": "dedup_by_id",
    "fill_null_strings_with_unknown": "fill_null_strings",
    "null_fill_unknown_strings": "fill_null_strings",
    "normalise_icd_codes_to_uppercase": "uppercase_icd",
    "standardise_vin_to_uppercase": "uppercase_vin",
    "standardise_registration_to_uppercase": "uppercase_registration",
    "normalise_fuel_type_categories": "normalise_fuel_type",
    "title_case_name_columns": "title_case",
    "normalise_department_names": "normalise_department",
    "normalise_country_names": "normalise_country",
    "flag_negative_quantities_as_returns": "flag_negative_quantity",
    "negative_quantity_flag": "flag_negative_quantity",
    "phone_number_normalisation": "normalise_phone",
}

# Transform that carries out each cast suggested by inference.
CASTS = {
    "strip_currency_prefix_and_cast_float": "strip_currency_symbols",
    "parse_mixed_dates": "standardise_dates",
    "normalise_boolean": "normalise_boolean",
}


def convert_by_rates(df: DataFrame, rates: DataFrame, columns: Sequence[str], currency: str) -> DataFrame:
    """Amounts times the rate of their row's currency, null without a rate.

    ``rates`` holds ``(currency, rate)``, in any case; whether it is broadcast is
    left to the optimizer, which knows its size. A currency given twice counts
    once, and raises an error if its rates differ.
    """
    rate = F.col("rate").cast("double")
    known = rates.groupBy(F.upper("currency").alias("_currency")).agg(F.min(rate).alias("_rate"), F.max(rate).alias("_other")).select(
        "_currency", F.when(F.col("_rate") != F.col("_other"), F.raise_error(F.concat(F.lit("different rates for "), "_currency")))
        .otherwise(F.col("_rate")).cast("double").alias("_rate"))
    names = {c: _currency(df.schema[c]) for c in columns}
    joined = df.join(known, F.upper(C.col(currency)) == F.col("_currency"), "left")
    return joined.withColumns({c: F.expr(e) * F.col("_rate") for c, e in names.items()}).drop("_currency", "_rate")


def transform(name: str) -> Any:
    known = TRANSFORMS.get(ALIASES.get(name, name))
    if known is None:
        raise ValueError(f"unknown transform: {name}")
    return known


def register_transform(name: str, fn: Callable[..., DataFrame], inputs: Sequence[str],
                       outputs: Sequence[str]) -> None:
    """Make a DataFrame function available by name; a pandas UDF inside it is fine."""
    TRANSFORMS[name] = RegisteredTransform(name, fn, tuple(inputs), tuple(outputs))


def register_arrow_transform(name: str, fn: Callable[..., Sequence[Any]], inputs: Sequence[str], outputs: str) -> None:
    """Make a function on Arrow arrays available by name: ``fn(*inputs, **params)`` returns one array for each column of ``outputs`` (DDL)."""
    if name in TRANSFORMS and not isinstance(TRANSFORMS[name], ArrowTransform):
        raise ValueError(f"{name} is a transform already")
    TRANSFORMS[name] = ArrowTransform(name, fn, tuple(inputs), T._parse_datatype_string(outputs))


def apply_transform(df: DataFrame, name: str, columns: Iterable[str] | None = None, **params: Any) -> DataFrame:
    return transform(name).apply(df, columns, **params)


def cast_steps(schema: DataFrame) -> list["Step"]:
    """Steps for the casts an inferred schema suggests (one small row per column)."""
    wanted: dict[str, list[str]] = {}
    for row in schema.where("suggested_cast IS NOT NULL").select("column", "suggested_cast").collect():
        wanted.setdefault(CASTS[row["suggested_cast"]], []).append(row["column"])
    return [Step(name, tuple(columns)) for name, columns in wanted.items()]


def apply_casts(df: DataFrame, schema: DataFrame) -> DataFrame:
    return TransformPlan(cast_steps(schema)).apply(df)


def parse_failures(before: DataFrame, name: str, columns: Iterable[str] | None = None, **params: Any) -> DataFrame:
    """``(column, parse_failures)``: non-blank cells the transform turns into null."""
    outputs = transform(name).outputs(before, columns, **params)
    wide = before.agg(*[
        F.expr(f"count_if({S.stripped(f'CAST({S.quote(s)} AS STRING)')} <> '' AND ({e}) IS NULL)").alias(s)
        for s, _, e in outputs])
    return wide.unpivot([], [s for s, _, _ in outputs], "column", "parse_failures")


@dataclass(frozen=True)
class Step:
    name: str
    columns: tuple[str, ...] | None = None
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class TransformPlan:
    """An ordered list of steps."""

    steps: Sequence[Step]

    @property
    def applied(self) -> list[str]:
        return [transform(s.name).name for s in self.steps]

    def check(self, domain: str, enforce_required: bool = True) -> None:
        """Raise if a forbidden transform is listed or a required one is missing."""
        rules = R.rules_for(domain)
        banned = {"drop_duplicate_rows": "dedup_rows"}
        names = set(self.applied)
        used = [f for f in rules["forbidden_transforms"] if f in names or banned.get(f) in names]
        if used:
            raise ValueError(f"forbidden for {domain}: {used}")
        missing = [r for r in rules["required_transforms"] if r not in names]
        if missing and enforce_required:
            raise ValueError(f"required for {domain}: {missing}")

    def apply(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = transform(s.name).apply(df, s.columns, **s.params)
        return df

    def to_sql(self, df: DataFrame, source: str) -> str:
        """One SELECT over ``source`` equal to ``apply``."""
        text = S.quote(source)
        for s in self.steps:
            t = transform(s.name)
            text = "(" + t.sql(df, text, s.columns, **s.params) + ")"
            df = t.apply(df, s.columns, **s.params)
        return f"SELECT * FROM {text}"

    def edges(self, df: DataFrame) -> list[tuple[str, str, str]]:
        """``(source column, target column, transformation)``, untouched columns as passthrough."""
        origin: dict[str, list[tuple[str, list[str]]]] = {c: [(c, [])] for c in df.columns}
        for s in self.steps:
            t = transform(s.name)
            touched: dict[str, list[tuple[str, list[str]]]] = {}
            for source, target in t.edges(df, s.columns, **s.params):
                touched.setdefault(target, []).extend(
                    (root, labels + [t.name]) for root, labels in origin.get(source, [(source, [])]))
            df = t.apply(df, s.columns, **s.params)
            origin = {c: touched.get(c) or origin.get(c, [("", [t.name])]) for c in df.columns}
        return [(root, target, " > ".join(labels) or "passthrough")
                for target, roots in origin.items() for root, labels in roots]
