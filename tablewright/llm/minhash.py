"""Near-duplicate documents by MinHash over word shingles.

Many universal hash minima make a signature, bands of it propose candidates, the
signature and then the whole shingle sets decide, and documents fall into
connected components. Each group of equal shingle sets is one item, so exact
copies are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm import signatures as sg, text as tx
from tablewright.llm.similar import connected_components, linked, shared_bands, union_find
from tablewright.llm.tables import BITS, bit_map, frugal, has_bit, store, unused

WORDS = 5
#: Minima of a signature, bands, and minima of a band. Bands draw on the same minima in different choices: long bands
#: keep apart documents that only share a passage, and many of them find pairs. A pair at a similarity of 0.85 shares
#: no band in about 1 of 10,000 cases, at 0.8 in 5 of 1,000.
SIGNATURE, BANDS, ROWS = 128, 56, 9
#: Longs of the outline that tells pairs under the threshold before they are made.
OUTLINE = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(array: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, members, offsets): the sorted distinct shingle hashes of each text, one after another."""
    for at, end, data, offsets in tx.byte_chunks(array):
        data = tx.LOWER[data]
        starts, ends, rows = tx.words(data, offsets)
        hi, lo = tx.span_names(data, starts, ends)
        hashes = tx.mix(hi * _ODD + tx.mix(lo))
        grams, where = tx.ngrams(hashes, rows, words)
        bounds = np.searchsorted(rows, np.arange(end - at + 1))
        gram_bounds = np.searchsorted(rows[where], np.arange(end - at + 1))
        sets, lengths = [], np.zeros(end - at + 1, np.int64)
        for i in range(end - at):
            n = bounds[i + 1] - bounds[i]
            if n >= words:
                found = np.unique(grams[gram_bounds[i]:gram_bounds[i + 1]])
            elif n:
                whole, _ = tx.ngrams(hashes[bounds[i]:bounds[i + 1]], rows[bounds[i]:bounds[i + 1]], int(n))
                found = tx.mix(whole + np.uint64(n))
            else:
                continue
            sets.append(found)
            lengths[i + 1] = len(found)
        yield at, end, np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(lengths)


def _digests(members: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """A digest of each set, from sums over its members."""
    low = np.add.reduceat(members, starts)
    high = np.add.reduceat(tx.mix(members ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    return [x.tobytes() + y.tobytes() for x, y in zip(low, high)]


def _sketch(words: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, found = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for at, end, members, offsets in shingle_sets(batch.column(1), words):
                sizes[at:end] = np.diff(offsets)
                full = np.flatnonzero(np.diff(offsets))
                if not len(full):
                    continue
                minima = sg.signatures(members, offsets[:-1][full], length).astype(np.uint16)
                for k, (i, digest) in enumerate(zip(full, _digests(members, offsets[:-1][full]))):
                    found[at + i] = minima[k].tobytes()
                    digests[at + i] = digest
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(found, pa.binary())],
                names=["doc_id", "version", "n_shingles", "digest", "signature"])
    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                minima = np.stack([np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()])
                keys = sg.bands_of(minima.astype(np.uint32), bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(keys.ravel())], names=["id", "band"])
    return run


def _members(words: int, bits):
    """The shingle sets of the texts whose place has a bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(bits.value, batch.column(3).to_numpy())))
            for at, _, members, offsets in shingle_sets(batch.column(1), words):
                full = np.flatnonzero(np.diff(offsets))
                yield pa.RecordBatch.from_arrays(
                    [*batch.select([0, 2]).take(pa.array(at + full)).columns, pa.array(_digests(members, offsets[:-1][full]) if len(full) else [], pa.binary()),
                     pa.array([members[offsets[i]:offsets[i + 1]].tobytes() for i in full], pa.binary())], names=["doc_id", "version", "digest", "content"])
    return run


def _expand(contents: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint64) for c in contents]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's version, which tells rows of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def _components(docs: DataFrame, percent: int, words: int, signature: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows of :func:`_rows`, and (digest, doc_id, component) of each group of equal shingle sets.

    A group is named by a number of its own; its component is the smallest number reachable by links.
    """
    sketch = store(docs.mapInArrow(frugal(_sketch(words, signature)), "doc_id long, version long, n_shingles long, digest binary, signature binary"), "sketch")
    named = sketch.where("digest is not null and doc_id is not null")
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "version")).alias("_first"), F.first("signature").alias("signature"))
    classes = store(classes.select("digest", "_first.*", "signature", F.monotonically_increasing_id().alias("id")), "classes")
    banded = shared_bands(classes.select("id", "signature").mapInArrow(_bands(bands, rows), "id long, band long"))
    chosen = classes.join(banded.select("id").distinct(), "id", "left_semi")
    spot = F.xxhash64("doc_id", "version").bitwiseAND((1 << BITS) - 1)
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(chosen, spot))
    members = docs.select("doc_id", "text", "version", spot.alias("spot")).where("doc_id is not null and text is not null").mapInArrow(
        frugal(_members(words, bits)), "doc_id long, version long, digest binary, content binary")
    sets = store(chosen.join(members, ["doc_id", "version", "digest"]).dropDuplicates(["id"]).select("id", "signature", "content"), "sets")
    found = linked(banded, sets, percent, signature, _expand, OUTLINE, union_find)
    return sketch, classes.select("id", "digest", "doc_id").join(found, "id", "left").select(
        "digest", "doc_id", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, signature: int = SIGNATURE, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text, ...).

    Two documents are linked when 100 * intersection >= percent * union of their
    sets of ``words``-word shingles; a shorter text is one shingle. component_id is
    the smallest doc_id reachable by links.

    * null, empty and blank texts: n_shingles 0, linked with nothing, kept
    * very long texts: whole, one at a time
    * null doc_id: linked with nothing, component_id null, kept
    * rows with one doc_id: one document, linked through their id
    * other columns of ``docs`` are not read
    * empty table: no rows
    """
    sketch, classes = _components(_rows(docs), percent, words, signature, bands, rows)
    # From here a component is named by its smallest doc_id.
    least = classes.groupBy("component").agg(F.min("doc_id").alias("least"))
    labels = classes.join(least, "component").select("digest", F.col("least").alias("component"))
    named = sketch.where("digest is not null and doc_id is not null")
    # Rows with one id but several texts tie the classes of those texts together.
    member_class = named.select("doc_id", "digest").join(labels, "digest").select("doc_id", "component")
    by_id = store(member_class.groupBy("doc_id").agg(F.min("component").alias("low"), F.max("component").alias("high")), "members")
    ties = by_id.where("low < high")
    if not ties.isEmpty():
        joined = connected_components(member_class.join(ties.select("doc_id", "low"), "doc_id")
                                              .select(F.col("component").alias("a"), F.col("low").alias("b")))
        by_id = by_id.join(joined.withColumnRenamed("id", "low").withColumnRenamed("component", "_tied"), "low", "left").withColumn(
            "low", F.coalesce("_tied", "low"))
    result = sketch.select("doc_id", "n_shingles").join(by_id.select("doc_id", F.col("low").alias("component_id")), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of texts, all columns.

    A row goes only if a row linked to it through texts stays: the one with the smallest (doc_id, version). Rows that
    only share their id are not linked. Of rows with that id and text one stays, which one is not defined. Rows
    without id or words all stay.
    """
    key, version = unused(docs, "_key", "_version")
    sketch, classes = _components(_rows(docs), percent, WORDS, SIGNATURE, BANDS, ROWS)
    named = sketch.where("digest is not null and doc_id is not null").select("doc_id", "version", "digest")
    named = named.join(classes.select("digest", "component"), "digest")
    keepers = named.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("_first"))
    gone = named.join(keepers, "component").where(F.struct("doc_id", "version") != F.col("_first"))
    gone = gone.select(F.col("doc_id").alias(key), F.col("version").alias(version)).distinct()
    rows = docs.select("*", F.col("doc_id").cast("long").alias(key), F.xxhash64(F.col("text").cast("string")).alias(version))
    left = rows.join(gone, [key, version], "left_anti")
    # Only rows with words are linked, even with their like.
    alone = F.col(key).isNull() | ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.where(~alone).dropDuplicates([key, version]).unionByName(left.where(alone)).drop(key, version)
