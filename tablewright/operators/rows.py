"""Row-level set operations: row index, keep-first, differences, change summary."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tablewright.functions.columns import TEMPORAL, col, fields, groupable
from tablewright.functions.sql import literal, quote
from tablewright.session import checkpoint_root


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """0-based position of each row in the given order, numbered in parallel.

    The range-sorted rows are checkpointed once, so the numbering cannot move
    when a task is retried; each partition then adds the row count of those
    before it. Select the needed columns first: the checkpoint holds them all.
    Rows that tie are ordered by a digest, so one value of many rows is split.
    """
    checkpoint_root(df.sparkSession)
    placed = (
        df.orderBy(*order, F.xxhash64(*map(groupable, df.schema.fields))).checkpoint(eager=True)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33))
        .withColumn("_within", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the sorted table.
    starts = sizes.select(
        "_part",
        (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .select(*df.columns, (F.col("_start") + F.col("_within")).alias(name))
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep_null_keys: bool = False) -> DataFrame:
    """The first row of each key in the given order.

    Spark limits each task to one row per key before the shuffle, so a key
    with a third of all rows sends one row per task. Null keys count as one
    key unless ``keep_null_keys`` lets all those rows through.
    """
    def first(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*[col(k) for k in keys]).orderBy(*[col(o) for o in order]))
        return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

    if not keep_null_keys:
        return first(df)
    has_null = " OR ".join(f"{quote(k)} IS NULL" for k in keys)
    return first(df.where(f"NOT ({has_null})")).unionByName(df.where(has_null))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order columns, largest first column first."""
    rank = F.row_number().over(W.partitionBy(*[col(k) for k in keys]).orderBy(*[col(c).desc() for c in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def row_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows whose multiplicity differs, with how many more there are on each side.

    Counts stand in for repeated rows: a row repeated a billion times is one
    row of the result.
    """
    tagged = before.withColumn("_side", F.lit(1)).unionByName(after.withColumn("_side", F.lit(-1)))
    surplus = tagged.groupBy(*[col(c) for c in before.columns]).agg(F.sum("_side").alias("_surplus")).where("_surplus <> 0")
    return surplus.select(
        *[col(c) for c in before.columns],
        F.greatest(F.col("_surplus"), F.lit(0)).alias("only_before"),
        F.greatest(-F.col("_surplus"), F.lit(0)).alias("only_after"))


def cell_digest(f: T.StructField) -> Column:
    """A 64-bit digest of a cell that is not null; entries of a map in any order are the same map."""
    kind = f.dataType.simpleString()
    if isinstance(f.dataType, T.MapType) and "map<" not in kind[4:] and "variant" not in kind:
        return F.xxhash64(F.array_sort(F.map_entries(col(f.name))))
    return F.xxhash64(groupable(f))


def _comparable(f: T.StructField, other: T.StructField) -> Column:
    """The digest of a cell of ``f`` as it compares with cells of ``other``: by value where the types differ."""
    c, mine, theirs = col(f.name), f.dataType, other.dataType
    if mine == theirs:
        return cell_digest(f)
    number = (T.NumericType,)
    if isinstance(mine, number) and isinstance(theirs, (*number, T.StringType)):
        return F.xxhash64(c.cast("double"))
    if isinstance(mine, TEMPORAL) and isinstance(theirs, (*TEMPORAL, T.StringType)):
        return F.xxhash64(c.cast("timestamp"))
    if isinstance(mine, T.StringType):
        kind = "double" if isinstance(theirs, number) else "timestamp" if isinstance(theirs, TEMPORAL) else theirs.simpleString()
        if isinstance(theirs, (*number, *TEMPORAL, T.BooleanType)):
            value = F.expr(f"try_cast({quote(f.name)} AS {kind})")
            return F.when(value.isNotNull(), F.xxhash64(value)).otherwise(F.xxhash64(c))
        return F.xxhash64(c)
    return F.xxhash64(c) if isinstance(mine, T.BooleanType) and isinstance(theirs, T.StringType) else F.xxhash64(c.cast("string"))


#: Null flags in one long.
FLAGS = 62


def _marked(df: DataFrame, other: DataFrame, key: Sequence[str], names: Sequence[str], side: int) -> DataFrame:
    """Key, side, a digest of each cell (0 for null) and the cells' null flags: what a row weighs does not depend on its texts."""
    digests = [F.when(col(c).isNotNull(), _comparable(df.schema[c], other.schema[c])).otherwise(F.lit(0).cast("long")).alias(f"_d{i}")
               for i, c in enumerate(names)]
    flags = []
    for j in range(0, len(names), FLAGS):
        held = [F.when(col(c).isNotNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(names[j:j + FLAGS])]
        flags.append(reduce(lambda x, y: x.bitwiseOR(y), held).alias(f"_f{j // FLAGS}"))
    return df.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.lit(side).alias("_side"), *digests, *flags)


def _paired(before: DataFrame, after: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per key: row counts, the two rows' digests xored (0: equal cells), and the null flags of each side.

    A union and one grouped aggregate instead of a join: repeated keys are
    combined on the map side and cannot multiply, and no cell is shuffled.
    """
    sides = _marked(before, after, key, names, 0).unionByName(_marked(after, before, key, names, 1))
    flags = [c for c in sides.columns if c.startswith("_f")]
    return sides.groupBy(*[f"_k{i}" for i in range(len(key))]).agg(
        F.count_if(F.col("_side") == 0).alias("_before"), F.count_if(F.col("_side") == 1).alias("_after"),
        *[F.bit_xor(f"_d{i}").alias(f"_d{i}") for i in range(len(names))],
        *[F.bit_or(F.when(F.col("_side") == side, F.col(f)).otherwise(F.lit(0).cast("long"))).alias(f"{f}_{side}") for f in flags for side in (0, 1)])


def change_summary(before: DataFrame, after: DataFrame, key: Sequence[str],
                   columns: Iterable[str] | None = None) -> DataFrame:
    """Per column: cells changed between the two tables, matched by key.

    ``(column, changed_cells, set_to_null, compared_rows, ambiguous_keys,
    removed_keys, added_keys)``. Only keys with one row on each side have a
    before/after cell; the others are counted as ambiguous. Null keys equal null keys.

    Cells are compared by 64-bit digests and null flags, so neither texts nor maps are
    shuffled. Where a column's type differs the values are compared: the
    text ``5.50`` equals the number 5.5; a text that is no such value is a change.
    """
    names = [f.name for f in fields(before, columns) if f.name not in key and f.name in after.columns]
    pairs = _paired(before, after, key, names)
    single = "_before = 1 AND _after = 1"
    aggregates = [
        f"count_if({single}) AS compared",
        "count_if(_before > 0 AND _after > 0 AND (_before > 1 OR _after > 1)) AS ambiguous",
        "count_if(_after = 0) AS removed", "count_if(_before = 0) AS added",
    ]
    rows = []
    for i, c in enumerate(names):
        bit = 1 << (i % FLAGS)
        held, left = (f"(_f{i // FLAGS}_{side} & {bit}L) <> 0" for side in (0, 1))
        aggregates += [f"count_if({single} AND (_d{i} <> 0 OR ({held}) <> ({left}))) AS changed_{i}",
                       f"count_if({single} AND {held} AND NOT ({left})) AS nulled_{i}"]
        rows.append(f"named_struct('column', {literal(c)}, 'changed_cells', changed_{i},"
                    f" 'set_to_null', nulled_{i}, 'compared_rows', compared,"
                    " 'ambiguous_keys', ambiguous, 'removed_keys', removed, 'added_keys', added)")
    if not rows:
        raise ValueError("no column to compare besides the key")
    wide = pairs.agg(*[F.expr(e) for e in aggregates])
    return wide.selectExpr(f"inline(array({', '.join(rows)}))")


def key_survival(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per key (null keys are one): _before and _after, the rows on each side, and _holes, the rows before that hold a null."""
    holes = reduce(lambda x, y: x | y, [col(c).isNull() for c in before.columns]).cast("int")
    names = [f"_k{i}" for i in range(len(key))]

    def side(df: DataFrame, was: int, hole: Column) -> DataFrame:
        return df.select(*[col(k).alias(n) for k, n in zip(key, names)], F.lit(was).alias("_was"), hole.alias("_hole"))

    sides = side(before, 1, holes).unionByName(side(after, 0, F.lit(0)))
    return sides.groupBy(*names).agg(F.sum("_was").alias("_before"), F.sum(1 - F.col("_was")).alias("_after"), F.sum("_hole").alias("_holes"))


def orphan_counts(child: DataFrame, foreign_key: str, parent: DataFrame, primary_key: str) -> DataFrame:
    """``(orphan_keys, orphan_rows)``: foreign keys without a parent row.

    Keys are counted before the join, so it sees each key once on both sides.
    """
    keys = child.where(col(foreign_key).isNotNull()).groupBy(col(foreign_key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"))
    parents = parent.select(col(primary_key).alias("_key")).distinct()
    return keys.join(parents, "_key", "left_anti").agg(
        F.count(F.lit(1)).alias("orphan_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"))


def column_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(column, side)`` with side ``both``, ``left`` or ``right``, from two ``column`` frames."""
    a, b = left.select("column").distinct(), right.select("column").distinct()
    return (
        a.intersect(b).withColumn("side", F.lit("both"))
        .unionByName(a.subtract(b).withColumn("side", F.lit("left")))
        .unionByName(b.subtract(a).withColumn("side", F.lit("right")))
    )
