"""Domain constraints: row rules in one aggregate, uniqueness by grouped counts."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tablewright import rules as R
from tablewright.functions import columns as C, sql as S
from tablewright.operators.profile import union_all
from tablewright.operators.rows import change_summary, key_survival

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def _negative(c: str, _: T.DataType, __: datetime.date) -> str:
    return f"{c} < 0"


def _not_iso(c: str, kind: T.DataType, _: datetime.date) -> str:
    if isinstance(kind, C.TEMPORAL):
        return "false"
    return (f"{c} IS NOT NULL AND NOT (CAST({c} AS STRING) RLIKE r'{ISO_DATE}'"
            f" AND try_to_date(CAST({c} AS STRING), 'yyyy-MM-dd') IS NOT NULL)")


#: Which columns a rule is about, as rows (rule, how, keyword, family, choice): ``how`` the keyword meets the lower-case
#: name (part of it, a whole word of it, the whole name, or any name), the family of types, and the choice: a rule takes the
#: columns of its first choice that finds any.
RULE_COLUMNS = (
    ("amount_non_negative", "part", "amount", "number", 1), ("amount_non_negative", "part", "price", "number", 1),
    ("unit_price_non_negative", "part", "price", "number", 1),
    ("mileage_non_negative", "part", "mileage", "number", 1), ("mileage_non_negative", "part", "odometer", "number", 1),
    ("salary_non_negative", "part", "salary", "number", 1), ("salary_non_negative", "part", "wage", "number", 1),
    ("no_negative_ages", "word", "age", "number", 1), ("no_negative_ages", "word", "ages", "number", 1),
    ("currency_code_format", "part", "currency", "text", 1),
    ("date_iso8601", "part", "date", "", 1),
    ("icd_format", "word", "icd", "", 1), ("icd_format", "part", "diagnosis_code", "", 2),
    ("null_filled", "any", "", "text", 1),
    ("vin_length", "word", "vin", "", 1),
    ("year_range", "word", "year", "number", 1),
    ("hours_range", "word", "hours", "number", 1),
    ("no_future_hire_date", "part", "hire_date", "", 1),
    ("quantity_check", "part", "qty", "number", 1), ("quantity_check", "part", "quantity", "number", 1),
    ("discount_range", "part", "discount", "number", 1),
    ("country_canonical", "word", "country", "", 1),
    ("transaction_id_unique", "name", "transaction_id", "", 1),
)

#: Column that a table must also have for the rule to hold.
RULE_NEEDS = {"quantity_check": "is_return"}

#: SQL true for a bad cell, from the quoted column, its type and the day.
ROW_RULES: dict[str, Callable[[str, T.DataType, datetime.date], str]] = {
    "amount_non_negative": _negative, "unit_price_non_negative": _negative, "mileage_non_negative": _negative,
    "salary_non_negative": _negative, "no_negative_ages": _negative, "date_iso8601": _not_iso,
    "currency_code_format": lambda c, _, __: f"NOT ({c} RLIKE '^[A-Z]{{3}}$' AND {c} IN ({S.tokens(R.CURRENCY_CODES)}))",
    "icd_format": lambda c, _, __: f"NOT replace({c}, '.', '') RLIKE '^[A-Z][0-9]{{2,5}}$'",
    "null_filled": lambda c, _, __: f"{c} IS NULL",
    "vin_length": lambda c, _, __: f"length({c}) <> 17",
    "year_range": lambda c, _, day: f"{c} NOT BETWEEN 1886 AND {day.year + 1}",
    "hours_range": lambda c, _, __: f"{c} NOT BETWEEN 0 AND 168",
    "no_future_hire_date": lambda c, _, day: f"CAST({c} AS DATE) > DATE'{day.isoformat()}'",
    "quantity_check": lambda c, _, __: f"{c} < 0 AND NOT coalesce(is_return, false)",
    "discount_range": lambda c, _, __: f"{c} NOT BETWEEN 0 AND 100",
    "country_canonical": lambda c, _, __: f"{c} NOT IN ({S.tokens(R.COUNTRY_VARIANTS)})",
}

#: Rules that need the rows of a key together.
UNIQUE_RULES = ("transaction_id_unique",)


def table_columns(df: DataFrame, dataset: str = "table") -> DataFrame:
    """``(dataset, column, family, position)`` of a table: what rules are matched with."""
    family = {**{c: "number" for c in C.numeric_columns(df)}, **{c: "text" for c in C.string_columns(df)}}
    return df.sparkSession.createDataFrame([(dataset, c, family.get(c, "other"), i) for i, c in enumerate(df.columns)],
                                           "dataset string, column string, family string, position int")


def match_rules(columns: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(dataset, rule, column, position)``: rules times columns of all datasets, as joins.

    ``columns`` are :func:`table_columns` of any number of datasets, ``wanted`` is
    (dataset, rule). The rule table is a fixed list of some twenty rows.
    """
    spark = columns.sparkSession
    table = F.broadcast(spark.createDataFrame(list(RULE_COLUMNS), "rule string, how string, keyword string, _family string, choice int"))
    name = F.lower("column")
    words = F.split(name, r"[^a-z0-9]+")
    fits = (F.when(F.col("how") == "part", F.contains(name, F.col("keyword")))
            .when(F.col("how") == "word", F.array_contains(words, F.col("keyword")))
            .when(F.col("how") == "name", name == F.col("keyword")).otherwise(True))
    met = columns.join(wanted.join(table, "rule"), "dataset").where(fits & ((F.col("_family") == "") | (F.col("_family") == F.col("family"))))
    first = F.min("choice").over(W.partitionBy("dataset", "rule"))
    met = met.withColumn("_first", first).where("choice = _first").select("dataset", "rule", "column", "position").distinct()
    needs = F.broadcast(spark.createDataFrame(list(RULE_NEEDS.items()), "rule string, _needed string"))
    have = columns.select(F.col("dataset"), F.col("column").alias("_needed"), F.lit(True).alias("_there"))
    return met.join(needs, "rule", "left").join(have, ["dataset", "_needed"], "left").where(
        F.col("_needed").isNull() | F.col("_there")).select("dataset", "rule", "column", "position")


def applicable(df: DataFrame, names: Iterable[str]) -> list[tuple[str, str]]:
    """``(rule, column)`` pairs of one table, as :func:`match_rules` finds them, in the order of rules and columns."""
    family = {**{c: "number" for c in C.numeric_columns(df)}, **{c: "text" for c in C.string_columns(df)}}
    pairs = []
    for name in names:
        if RULE_NEEDS.get(name, df.columns[0] if df.columns else "") not in df.columns:
            continue
        found: dict[int, dict[str, None]] = {}
        for _, how, keyword, kind, choice in (r for r in RULE_COLUMNS if r[0] == name):
            named = {"part": C.name_contains, "word": C.name_tokens, "any": lambda d, _: d.columns,
                     "name": lambda d, k: [c for c in d.columns if c.lower() == k]}[how](df, keyword)
            found.setdefault(choice, {}).update(dict.fromkeys(c for c in named if kind in ("", family.get(c))))
        first = next((found[k] for k in sorted(found) if found[k]), {})
        pairs += [(name, c) for c in df.columns if c in first]
    return pairs


def violation_counts(df: DataFrame, pairs: Sequence[tuple[str, str]], as_of: datetime.date | None = None) -> list[Column]:
    """One aggregate for each (row rule, column): what an aggregate or an observation counts in the pass it is part of."""
    day = as_of or datetime.date.today()
    return [F.expr(f"count_if({ROW_RULES[name](S.quote(c), df.schema[c].dataType, day)})").alias(f"v_{i}")
            for i, (name, c) in enumerate(pairs)]


def row_pairs(pairs: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    return [p for p in pairs if p[0] in ROW_RULES]


RESULT = "name string, column string, violation_count long, passed boolean"


def evaluate(df: DataFrame, names: Iterable[str], as_of: datetime.date | None = None,
             columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``(name, column, violation_count, passed)`` per rule and column.

    ``columns`` names the columns of a rule explicitly. A null cell violates
    only ``null_filled``. Unique rules count the keys that occur more than once.
    """
    chosen, names = dict(columns or {}), list(names)
    found = applicable(df, [n for n in names if n not in chosen])
    pairs = [p for n in names for p in ([(n, c) for c in chosen[n]] if n in chosen else [f for f in found if f[0] == n])]
    if not pairs:
        return df.sparkSession.createDataFrame([], RESULT)
    of_rows, parts = row_pairs(pairs), []
    if of_rows:
        rows = [f"named_struct('name', '{n}', 'column', {S.literal(c)}, 'violation_count', v_{i})" for i, (n, c) in enumerate(of_rows)]
        parts.append(df.agg(*violation_counts(df, of_rows, as_of)).selectExpr(f"inline(array({', '.join(rows)}))"))
    parts += [unique_violations(df, n, c) for n, c in pairs if n in UNIQUE_RULES]
    return union_all(parts).withColumn("passed", F.col("violation_count") == 0)


def unique_violations(df: DataFrame, name: str, column: str) -> DataFrame:
    return repeated_keys(df, [column]).select(F.lit(name).alias("name"), F.lit(column).alias("column"), "violation_count")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``violation_count``: non-null keys found in more than one row."""
    present = " AND ".join(f"{S.quote(k)} IS NOT NULL" for k in keys)
    counts = df.where(present).groupBy(*map(C.col, keys)).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.count_if(F.col("_n") > 1).alias("violation_count"))


def lost_null_rows(before: DataFrame, after: DataFrame, key: Sequence[str], least: int | None = None) -> DataFrame:
    """``violation_count``: rows holding a null that are gone from the output, by the rows their key has on each side.

    A null key equals a null key. ``least`` is how many rows of a key must stay where repeats
    may go (1 after de-duplication); without it all must.
    """
    return _lost(key_survival(before, after, key), F.col("_holes"), least)


def lost_repeats(before: DataFrame, after: DataFrame, key: Sequence[str], least: int | None = None) -> DataFrame:
    """``violation_count``: rows of repeated keys that are missing from the output; ``least`` as in :func:`lost_null_rows`."""
    return _lost(key_survival(before, after, key).where("_before > 1"), F.col("_before"), least)


def _lost(survival: DataFrame, rows: Column, least: int | None) -> DataFrame:
    needed = rows if least is None else F.least(rows, F.lit(least))
    return survival.agg(F.coalesce(F.sum(F.greatest(needed - F.col("_after"), F.lit(0))), F.lit(0)).alias("violation_count"))


def lost_negative_rows(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """``violation_count``: how many fewer rows are negative in the output."""
    sides = before.select(C.col(column).alias("_c"), F.lit(1).alias("_w")).unionByName(
        after.select(C.col(column).alias("_c"), F.lit(-1).alias("_w")))
    lost = F.coalesce(F.sum(F.when(F.col("_c") < 0, F.col("_w"))), F.lit(0))
    return sides.agg(F.greatest(lost, F.lit(0)).alias("violation_count"))


def altered_sensitive_cells(before: DataFrame, after: DataFrame, key: Sequence[str],
                            sensitive: Iterable[str]) -> DataFrame:
    """``(column, violation_count)``: sensitive cells that differ for the same key."""
    names = [c for c in before.columns if c in set(sensitive) and c not in key]
    return change_summary(before, after, key, names).select("column", F.col("changed_cells").alias("violation_count"))


def forbidden_checks(before: DataFrame, after: DataFrame, forbidden: Iterable[str], key: Sequence[str], sensitive: Iterable[str] = (),
                     deduplicated: bool = False) -> DataFrame:
    """``(name, column, violation_count, passed)`` for the forbidden transforms that rows can show.

    Rows are matched by ``key``; without one nothing can be said of single rows. ``deduplicated``: rows that
    repeat a key may go as long as one stays.
    """
    wanted, least, parts = set(forbidden), 1 if deduplicated else None, []

    def named(name: str, counts: DataFrame, column: Column | None = None) -> None:
        parts.append(counts.select(F.lit(name).alias("name"), (F.lit(None).cast("string") if column is None else column).alias("column"),
                                   "violation_count"))

    keyed = bool(key) and set(key) <= set(before.columns) & set(after.columns)
    if "drop_null_rows" in wanted and keyed:
        named("drop_null_rows", lost_null_rows(before, after, key, least))
    if "drop_duplicate_rows" in wanted and keyed:
        named("drop_duplicate_rows", lost_repeats(before, after, key, least))
    if "mask_or_hash_pii" in wanted and keyed and set(sensitive) & {c.lower() for c in before.columns} - {k.lower() for k in key}:
        held = [c for c in before.columns if c.lower() in set(sensitive) and c in after.columns]
        named("mask_or_hash_pii", altered_sensitive_cells(before, after, key, held), F.col("column"))
    if "drop_negative_quantity_rows" in wanted and not deduplicated:
        for c in [c for c in C.name_contains(before, "qty", "quantity") if c in C.numeric_columns(before) and c in C.numeric_columns(after)]:
            named("drop_negative_quantity_rows", lost_negative_rows(before, after, c), F.lit(c))
    if not parts:
        return before.sparkSession.createDataFrame([], RESULT)
    return union_all(parts).withColumn("passed", F.col("violation_count") == 0)


def sensitive_columns(columns: DataFrame) -> DataFrame:
    """``(dataset, domain, column)`` for a frame of the datasets' columns and domain."""
    listed = [(d, c) for d, r in R.DOMAIN_RULES.items() for c in r["sensitive_columns"]]
    rules = columns.sparkSession.createDataFrame(listed, "domain string, _name string")
    return (
        columns.withColumn("_name", F.lower("column"))
        .join(F.broadcast(rules), ["domain", "_name"], "left_semi").drop("_name"))


def redact(evidence: DataFrame, sensitive: Iterable[str], value: str = "value",
           also: Sequence[str] = ("reason",)) -> DataFrame:
    """Values (and the texts quoting them) of sensitive columns replaced by ``***``."""
    hidden = F.lower("column").isin(*[c.lower() for c in sensitive])
    return evidence.withColumns({
        c: F.when(hidden, F.lit("***")).otherwise(F.col(c)) for c in (value, *also) if c in evidence.columns})
