"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. The
first four return the columns of docs; the last returns the pieces of the sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import lines, minhash, packing, quality, rules
from tablewright.llm.queries import tokenizer_path
from tablewright.llm.tables import read_table, store, unused


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return quality.score(docs, read_table(spark, sf_dir, "labels"), keep_only=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject."""
    return rules.judge(docs, read_table(spark, sf_dir, "labels"), keep_only=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines, and documents of which no word is left; n_chars follows the new text."""
    text, dropped = unused(docs, "_clean", "_dropped")
    clean = lines.drop_repeated_lines(docs, clean=text, dropped=dropped)
    clean = clean.where((F.col(dropped) == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col(dropped) > 0
    own = {c: F.col(f"`{c.replace('`', '``')}`") for c in docs.columns}
    return clean.select(*[
        F.when(changed, F.col(text)).otherwise(own[c]).alias(c) if c == "text" else
        F.when(changed, F.char_length(text).cast("long")).otherwise(own[c]).alias(c) if c == "n_chars" else own[c]
        for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' tokens in sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the forest.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
