"""Fuzzy line de-duplication over all documents.

Lines are sets of character shingles. MinHash signatures and many short bands
propose pairs, exact Jaccard similarity decides, distributed union-find makes
components, and one line of each stays: the first in order of document and line number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm import signatures as sg, text as tx
from tablewright.llm.similar import BUCKET, linked, packed, shared_packed_bands, union_find
from tablewright.llm.tables import BITS, bit_map, discard, frugal, has_bit, store

#: Characters of a shingle.
WIDTH = 8
#: Minima of a signature, bands, and minima of a band; see :mod:`~tablewright.llm.minhash`. Pairs at a similarity of 0.8 share no band in
#: about 5 of 1,000 cases, at 0.9 in 3 of 10,000.
SIGNATURE, BANDS, ROWS = 40, 16, 5
#: Longs of the outline that tells pairs under the threshold before they are made.
OUTLINE = 8

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Spreads line numbers over the bit map; small enough for no product to overflow.
_STRIDE = 40_503
#: White space as one space, A-Z in lower case.
_PLAIN = np.where(tx.IS_SPACE, np.uint8(32), tx.LOWER)
_FACTORS = np.random.default_rng(31).integers(0, 2**64, 3, dtype=np.uint64) | np.uint64(1)


def _normal(data: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines in lower case without outer white space and with single spaces, one after another, as bytes and offsets."""
    breaks = np.concatenate([np.flatnonzero(data == 0x0A), offsets])
    data = _PLAIN[data]
    solid = data != 32
    keep = solid.copy()
    if len(data):
        # The first of a run of white space stays, unless a line ends within the run or beside it.
        keep[1:] |= solid[:-1]
        first = np.flatnonzero(keep & ~solid)
        # Where the run begins that a line's end is in, or that goes on behind it.
        run = np.searchsorted(first, np.where(breaks > 0, breaks - 1, 0), "right") - 1
        open_ = (breaks > 0) & ~solid[breaks - 1]
        edge = np.append(first[run[open_ & (run >= 0)]], breaks[~open_ & (breaks < len(data))])
        keep[edge[~solid[edge]]] = False
    gone = np.flatnonzero(~keep)
    return data[keep], np.append(starts - np.searchsorted(gone, starts), len(data) - len(gone))


def _lines_of(array: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each line, number of each line in its text, bytes, offsets) of normal lines."""
    for at, end, data, offsets in tx.byte_chunks(array, 1 << 18):
        starts, ends, rows = tx.lines(data, offsets)
        first = np.searchsorted(rows, np.arange(end - at))
        numbers = np.arange(len(rows)) - first[rows]
        data, bounds = _normal(data, starts, offsets)
        yield at, rows, numbers, data, bounds


def _names(data: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the name of the lines ``which``, and a hash of it."""
    hi, lo = tx.span_names(data, bounds[which], bounds[which + 1])
    return hi, lo, tx.mix(hi * _ODD + tx.mix(lo))


def _shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all lines, and where those of each line begin and end; a line of fewer characters is one shingle."""
    follows = (data & 0xC0) == 0x80
    at = np.flatnonzero(follows)
    codes, edges = data[~follows].astype(np.uint64) if len(at) else data.astype(np.uint64), bounds - np.searchsorted(at, bounds)
    if len(at):
        # Bytes that go on with a character, by how far they are from its first one, which has no such byte before it but those counted.
        n = np.arange(len(at))
        head = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), n, 0))
        place, k = at[head] - 1 - head, n - head + 1
        for width in range(1, 4):
            more = np.flatnonzero((k == width) & (place >= 0))
            codes[place[more]] |= data[at[more]].astype(np.uint64) << np.uint64(8 * width)
    # Windows of 2, 4 and 8 characters, each from two of half its length, at every character.
    windows, half = codes, 1
    for factor in _FACTORS:
        wider = windows * factor
        wider[:-half] += windows[half:]
        windows, half = wider, half * 2
    length = np.diff(edges)
    whole = np.ones(len(codes), bool)
    long_line = np.flatnonzero(length >= WIDTH)
    for k in range(1, WIDTH):
        whole[edges[1:][long_line] - k] = False
    short = np.flatnonzero((length > 0) & (length < WIDTH))
    if len(short):
        # One shingle at the first character, which is the line's name.
        for k in range(1, WIDTH - 1):
            whole[(edges[:-1][short] + k)[length[short] > k]] = False
        windows[edges[:-1][short]] = _names(data, bounds, short)[2]
    count = np.maximum(length - WIDTH + 1, (length > 0).astype(np.int64))
    ends = np.cumsum(count)
    return tx.mix(windows[whole]), ends - count, ends


def _expand(contents: list[bytes]) -> list[np.ndarray]:
    """The shingle sets of normal lines."""
    bounds = np.cumsum([0, *map(len, contents)])
    shingles, starts, ends = _shingles(np.frombuffer(b"".join(contents), np.uint8), bounds)
    return [tx.distinct(shingles[a:b]) for a, b in zip(starts, ends)]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.select(["doc_id", "version"])
        for at, rows, numbers, data, bounds in _lines_of(batch.column(2)):
            full = np.flatnonzero(np.diff(bounds))
            hi, lo, name = _names(data, bounds, full)
            owner = keys.take(pa.array(at + rows[full]))
            yield pa.RecordBatch.from_arrays(
                [*owner.columns, pa.array(numbers[full].astype(np.int32)), *[pa.array(x.view(np.int64)) for x in (hi, lo, name)]],
                names=["doc_id", "version", "line", "hi", "lo", "name"])


def _bands(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows of the lines' names and band keys; see :func:`~tablewright.llm.similar.packed`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bands, n = [], [], 0
        for name, keys in _banded(batches):
            ids.append(np.repeat(name, BANDS))
            bands.append(keys.ravel())
            n += len(ids[-1])
            if n >= 1 << 20:
                yield packed(np.concatenate(ids), np.concatenate(bands), buckets)
                ids, bands, n = [], [], 0
        if n:
            yield packed(np.concatenate(ids), np.concatenate(bands), buckets)
    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    # The lines that this task has met of late: a common line is banded once in a task, not once for each document.
    met, older = set(), set()
    for batch in batches:
        for _, _, _, data, bounds in _lines_of(batch.column(0)):
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            hi, lo, name = _names(data, bounds, full)
            new = []
            for i, key in enumerate(zip(hi.tolist(), lo.tolist())):
                if key not in met:
                    met.add(key)
                    if key not in older:
                        new.append(i)
            if len(met) >= 50_000:
                met, older = set(), met
            if not new:
                continue
            # Only these lines are cut into shingles.
            which = full[new]
            if len(which) < len(full):
                size = bounds[which + 1] - bounds[which]
                edges = np.append(0, np.cumsum(size))
                data, bounds = data[np.arange(edges[-1]) + np.repeat(bounds[which] - edges[:-1], size)], edges
            else:
                bounds = np.append(bounds[which], bounds[-1])
            shingles, starts, _ = _shingles(data, bounds)
            yield name[new].view(np.int64), sg.bands_of(sg.fast_signatures(shingles, starts, SIGNATURE), BANDS, ROWS)


def _spot(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Place of a line in the bit map; :func:`repeated_lines` has the same in SQL."""
    most = np.int64((1 << BITS) - 1)
    return (key & most) ^ ((line.astype(np.int64) * _STRIDE) & most)


def _contents(bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Signature and normal text of the lines whose place has a bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(3).to_numpy()
            for at, end, data, offsets in tx.byte_chunks(batch.column(2), 1 << 18):
                starts, ends, rows = tx.lines(data, offsets)
                first = np.searchsorted(rows, np.arange(end - at))
                numbers = np.arange(len(rows)) - first[rows]
                which = np.flatnonzero((ends > starts) & has_bit(bits.value, _spot(key[at + rows], numbers)))
                if not len(which):
                    continue
                # Only these lines are made normal: they follow one another without line feeds, as texts do.
                size = ends[which] - starts[which]
                edges = np.append(0, np.cumsum(size))
                data, bounds = _normal(data[np.arange(edges[-1]) + np.repeat(starts[which] - edges[:-1], size)], edges[:-1], edges)
                full = np.flatnonzero(np.diff(bounds))
                which = which[full]
                if not len(which):
                    continue
                contents = [data[bounds[i]:bounds[i + 1]].tobytes() for i in full]
                shingles, starts, _ = _shingles(np.frombuffer(b"".join(contents), np.uint8), np.cumsum([0, *map(len, contents)]))
                signature = np.ascontiguousarray(sg.fast_signatures(shingles, starts, SIGNATURE).astype(np.uint16))
                owner = batch.select([0, 1]).take(pa.array(at + rows[which]))
                yield pa.RecordBatch.from_arrays(
                    [*owner.columns, pa.array(numbers[which].astype(np.int32)), pa.array([x.tobytes() for x in signature], pa.binary()),
                     pa.array(contents, pa.binary())], names=["doc_id", "version", "line", "signature", "content"])
    return run


PLACE = ["doc_id", "version", "line"]


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, version, gone): the numbers of the lines to drop of each text, from 0, in order.

    Two lines are linked when the sets of their 8-character shingles, in lower case with
    single spaces, have 100 * intersection >= percent * union; a shorter line is one
    shingle. Of each component the line with the smallest (doc_id, version, number) stays; version is the
    xxhash64 of the text, so rows with one doc_id and different texts are documents of their own,
    and rows with the same of both are one document.

    Lines without a word, and documents without id or text, are left alone. Lines are
    told apart by their bytes or, over 15 bytes, by 128-bit digests.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")).where(
        "doc_id is not null and text is not null")
    seen = store(docs.mapInArrow(frugal(_occurrences), "doc_id long, version long, line int, hi long, lo long, name long"), "lines")
    buckets = -(-seen.count() * BANDS // BUCKET) or 1
    bands = shared_packed_bands(docs.select("text").mapInArrow(frugal(_bands(buckets)), "bucket long, pairs binary"))
    # Lines with a candidate get numbers, and their text is fetched from where they stand first.
    wanted = bands.select(F.col("id").alias("name")).distinct()
    numbered = seen.join(wanted, "name", "left_semi").groupBy("hi", "lo").agg(F.min(F.struct(*PLACE)).alias("first"), F.min("name").alias("name"))
    numbered = store(numbered.select("hi", "lo", "name", "first.*", F.monotonically_increasing_id().alias("id")), "numbered")
    key = F.xxhash64("doc_id", "version")
    most = (1 << BITS) - 1
    spot = key.bitwiseAND(most).bitwiseXOR((F.col("line").cast("long") * _STRIDE).bitwiseAND(most))
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(numbered, spot))
    found = docs.select("doc_id", "version", "text", key.alias("key")).mapInArrow(
        frugal(_contents(bits)), "doc_id long, version long, line int, signature binary, content binary")
    sets = store(numbered.select("id", *PLACE).join(found, PLACE).dropDuplicates(["id"]).select("id", "signature", "content"), "sets")
    members = store(bands.withColumnRenamed("id", "name").join(numbered.select("name", "id"), "name").select("id", "band"), "members")
    discard(bands)
    components = linked(members, sets, percent, SIGNATURE, _expand, OUTLINE, union_find)
    linked_lines = numbered.join(components, "id").select("hi", "lo", "component")
    # Only lines that stand twice or have a link need a decision.
    first = seen.groupBy("hi", "lo").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n"))
    classes = store(first.join(linked_lines, ["hi", "lo"], "left").where("n > 1 or component is not null").drop("n"), "classes")
    keepers = classes.where("component is not null").groupBy("component").agg(F.min("first").alias("keeper"))
    decided = classes.join(keepers, "component", "left").select("hi", "lo", F.coalesce("keeper", "first").alias("keeper"))
    gone = seen.join(decided, ["hi", "lo"]).where(F.struct(*PLACE) != F.col("keeper"))
    return gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone = (batch.column(i).to_pylist() for i in (0, 1))
        made = [t if t is None or not g else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
                for t, g in zip(texts, (g and set(g) for g in gone))]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(made, pa.string()),
                                          pa.array([len(g or ()) for g in gone], pa.int64())],
                                         names=[*batch.schema.names[2:], "clean", "dropped"])


def drop_repeated_lines(docs: DataFrame, percent: int = 80, clean: str = "_clean", dropped: str = "_dropped") -> DataFrame:
    """``docs`` with two more columns: ``clean`` (the text without repeated lines) and ``dropped`` (how many they were).

    See :func:`repeated_lines`. Columns of ``docs`` with one of these names are replaced. Null texts
    stay null; empty texts, and texts of any length, are cut as a whole; an empty table stays empty.
    """
    gone = store(repeated_lines(docs, percent), "gone")
    kept = [c for c in docs.columns if c not in (clean, dropped)]
    ref = [F.col(f"`{c.replace('`', '``')}`") for c in kept]
    rows = docs.select(F.struct(*ref).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    rows = rows.withColumn("version", F.xxhash64("_text")).join(gone, ["doc_id", "version"], "left").select("_text", "gone", "_row")
    schema = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("clean", T.StringType()), T.StructField("dropped", T.LongType())])
    made = rows.mapInArrow(frugal(_without), schema)
    return made.select("_row.*", F.col("clean").alias(clean), F.col("dropped").alias(dropped))
