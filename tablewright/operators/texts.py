"""Counting and ranking whole texts of any length without moving them.

Texts are grouped by a 128-bit digest and their first characters. The characters put
nearly all texts in order; where texts agree in them, those texts alone are compared as a
whole, each task keeping its smallest. What is shuffled is a few bytes for each distinct text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

#: Characters that stand beside a digest.
HEAD = 32

KEY = ("_a", "_b")


def digest(value: str | Column) -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    return [F.xxhash64(value).alias(KEY[0]), F.xxhash64(F.lit(1), value).alias(KEY[1])]


def text_counts(values: DataFrame) -> DataFrame:
    """``(column, _a, _b, head, n)`` of the distinct texts in ``values`` (column, value); repeats are combined before the shuffle."""
    return values.select("column", *digest("value"), F.left("value", F.lit(HEAD)).alias("head")).groupBy(
        "column", *KEY, "head").agg(F.count(F.lit(1)).alias("n"))


def ranked(counts: DataFrame, k: int, frequent: bool) -> DataFrame:
    """The first k + 1 texts of each column, by their number if ``frequent``, then by their first characters; one more tells whether the k-th ties."""
    order = ([F.desc("n")] if frequent else []) + [F.asc("head"), *map(F.asc, KEY)]
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(*order))).where(F.col("rank") <= k + 1)


def settled(values: DataFrame, counts: DataFrame, rows: Sequence[Row], k: int, frequent: bool) -> dict[str, list[tuple[str, int]]]:
    """``{column: [(text, n), ...]}``: the first k texts of each column, whole and in the order of number and text, or of text alone.

    ``rows`` are the collected :func:`ranked` rows. Texts are looked up, and texts that agree in
    their first characters compared, only where there are such.
    """
    group = (lambda r: (r["n"], r["head"])) if frequent else (lambda r: r["head"])
    by_column: dict[str, list[Row]] = {}
    for r in sorted(rows, key=lambda r: (r["column"], r["rank"])):
        by_column.setdefault(r["column"], []).append(r)
    known, open_ = [], []
    for c, found in by_column.items():
        last = found[k - 1] if len(found) > k and group(found[k - 1]) == group(found[k]) else None
        sure = [r for r in found[:k] if last is None or group(r) != group(last)]
        known += [r for r in sure if len(r["head"]) == HEAD]
        if last is not None:
            open_.append((c, last["n"], last["head"], k - len(sure)))
        by_column[c] = sure
    texts = _texts(values, known)
    rest = _smallest(values, counts, open_, frequent)
    result = {}
    for c, found in by_column.items():
        sure = [(texts.get((c, r[KEY[0]], r[KEY[1]]), r["head"]), r["n"]) for r in found]
        # Texts that agree in their first characters are all known here, and are put in order as a whole.
        sure.sort(key=(lambda x: (-x[1], x[0].encode("utf-8", "surrogatepass"))) if frequent else (lambda x: x[0].encode("utf-8", "surrogatepass")))
        result[c] = sure + rest.get(c, [])
    return result


def _texts(values: DataFrame, rows: Sequence[Row]) -> dict[tuple[str, int, int], str]:
    """The texts of some k digests of each column."""
    if not rows:
        return {}
    wanted = values.sparkSession.createDataFrame([(r["column"], r[KEY[0]], r[KEY[1]]) for r in rows], "column string, _a long, _b long")
    found = values.select("column", "value", *digest("value")).join(F.broadcast(wanted), ["column", *KEY], "left_semi")
    return {(r["column"], r[KEY[0]], r[KEY[1]]): r["value"] for r in found.groupBy("column", *KEY).agg(F.any_value("value").alias("value")).collect()}


def _smallest(values: DataFrame, counts: DataFrame, groups: Sequence[tuple[str, int, str, int]], frequent: bool) -> dict[str, list[tuple[str, int]]]:
    """Of each group (column, n, head, how many) the smallest texts: one group a column."""
    if not groups:
        return {}
    wanted = F.broadcast(values.sparkSession.createDataFrame(groups, "column string, _n long, head string, _k int"))
    tied = counts.join(wanted, ["column", "head"])
    tied = tied.where("n = _n") if frequent else tied
    texts = values.select("column", "value", F.left("value", F.lit(HEAD)).alias("head"), *digest("value")).join(
        wanted.select("column", "head"), ["column", "head"], "left_semi")
    texts = texts.join(tied.select("column", *KEY, "n", "_k"), ["column", *KEY]).dropDuplicates(["column", *KEY])
    place = F.row_number().over(W.partitionBy("column").orderBy("value"))
    # The limit of a task is a literal; each column's own number is applied to what is left.
    most = max(g[3] for g in groups)
    best = texts.withColumn("rank", place).where(F.col("rank") <= most).where("rank <= _k")
    result: dict[str, list[tuple[str, int]]] = {}
    for r in best.select("column", "rank", "value", "n").orderBy("column", "rank").collect():
        result.setdefault(r["column"], []).append((r["value"], r["n"]))
    return result


def first_texts(values: DataFrame, k: int, frequent: bool = True) -> list[tuple[str, int, str, int]]:
    """``(column, rank, text, n)``: the k most frequent texts of each column, ties by text; or the k smallest texts. Runs at once."""
    counts = text_counts(values)
    found = settled(values, counts, ranked(counts, k, frequent).collect(), k, frequent)
    return [(c, i + 1, text, n) for c, texts in found.items() for i, (text, n) in enumerate(texts)]
