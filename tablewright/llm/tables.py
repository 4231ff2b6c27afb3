"""Intermediate tables, labelled samples and Arrow maps shared by the operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.llm.caches import forget, give_back
from tablewright.session import scratch_path, table_path


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` below the folder in spark.checkpoint.dir and reads it back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that :func:`store` wrote, once what was made of them is written itself."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever the case of its letters."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


#: Bits of a :func:`bit_map`: 8 MB, whatever the table.
BITS = 26


def bit_map(places: DataFrame, place: Column) -> np.ndarray:
    """A bit for each place (a long from 0 to 2^BITS - 1) that a row of ``places`` has, as 64-bit words.

    Tells most rows that a join would drop, before anything of them moves; the join itself still
    decides. Only the words, of which there are at most 2^(BITS - 6), come to the driver.
    """
    words = places.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_p & 63 as int)))").alias("bits")).toArrow()
    found = np.zeros(1 << (BITS - 6), np.uint64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return found


def has_bit(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(work: Work) -> Work:
    """``work`` in a worker that other work may have filled: what that kept goes first, and unused memory is given back then and at the end.

    Not for work that keeps something itself from task to task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        give_back()
        yield from work(batches)
        give_back()

    return run


def with_columns(df: DataFrame, column: str, fields: list[T.StructField],
                 work: Callable[[], Callable[..., dict[str, object]]], keep: str | None = None, also: Column | None = None) -> DataFrame:
    """Adds columns made from a text column, an Arrow batch at a time.

    ``work`` is called once in each task and returns the function from texts to
    columns. Columns of ``df`` named like an added one are left out. ``keep``
    names a boolean column that ``work`` makes: only its true rows stay, without added
    columns. ``also`` is a second column that the function gets.
    """
    names = [f.name for f in fields]
    kept = [c for c in df.columns if keep or c not in names]
    own = [F.col(f"`{c.replace('`', '``')}`") for c in kept]
    inputs = [F.col(f"`{column}`").cast("string")] + ([] if also is None else [also])
    source = df.select(*own, *[c.alias(f"_input_{i}_") for i, c in enumerate(inputs)])
    schema = T.StructType(df.select(*own).schema.fields + ([] if keep else fields))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = work()
        # Some rows at a time: what is made of a batch, and the rows of it that stay, take room beside it.
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            made = run(*batch.columns[len(kept):])
            columns = batch.columns[:len(kept)]
            if keep:
                mask = pa.array(made[keep], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in columns], names=kept)
            else:
                yield pa.RecordBatch.from_arrays(columns + [pa.array(made[n]) for n in names], names=kept + names)

    return source.mapInArrow(frugal(apply), schema)


def held_out(doc_id="doc_id"):
    """Whether a document is kept from all fitting: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, longest: int) -> DataFrame:
    """At most ``limit`` labelled rows (text, n_chars, label) outside the held-out fold, chosen by a hash of their id.

    Texts of over ``longest`` characters and rows without text or label are passed
    over, so the sample has at most ``limit * longest`` characters. Of rows with one
    id the least text counts. The choice does not depend on how the tables are partitioned.
    """
    names = set(docs.columns)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                       (F.col("n_chars").cast("long") if "n_chars" in names else F.lit(None).cast("long")).alias("n_chars"))
    rows = rows.where(F.col("text").isNotNull() & (F.length("text") <= longest) & ~held_out())
    marks = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.min("_label").alias("_label"))
    # Ids are chosen first: no text moves before its row is known to be in the sample, which is small enough to broadcast.
    ids = rows.select("doc_id").join(marks, "doc_id").distinct().orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id").limit(limit)
    chosen = rows.join(F.broadcast(store(ids, "sample")), "doc_id").groupBy("doc_id", "_label").agg(
        F.min(F.struct("text", "n_chars")).alias("_row"))
    return chosen.select("_row.text", "_row.n_chars", F.col("_label").alias("label"))


def fit_sample(sample: DataFrame, fit: Callable[[list[tuple[str, int | None, int]]], object]) -> object:
    """What ``fit`` makes of the rows of a bounded sample, in their order by value.

    One task holds the sample and returns the model alone, so that neither texts nor features reach the driver.
    ``fit`` returns arrays and plain values: a worker's classes need not be those of the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(frugal(run), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])
