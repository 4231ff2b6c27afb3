"""Packs tokenised documents into sequences of a fixed length.

Shortest-pack-first over the length histogram: lengths are placed longest first,
each into the packs with the most space left, and only counts of packing patterns
are kept. The patterns are then joined back to the documents by their rank among
those of the same length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.caches import Recent, kept
from tablewright.llm.tables import frugal, store

CAPACITY = 4096
END = 2


def word_ids(path: str) -> Recent:
    """Token ids, as little-endian uint32 bytes, by stretch of text between ASCII white space.

    The tokenizer drops white space and never merges across it, so a text's ids are
    those of its stretches in order. Stretches of ASCII and of Latin letters that
    composing leaves as they are get cut here as the tokenizer cuts them; everything
    else goes through its own steps.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, normalise, cut = tokenizer.model, tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
    # The tokenizer's own pattern, for lower-case text without control characters. Of the letters from U+00C0 to U+017E
    # one has a lower case of two characters and is left out.
    plain = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u012f\u0131-\u017e]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u012f\u0131-\u017e]+").findall
    printable = re.compile("[!-~]+").fullmatch
    latin = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]+").fullmatch
    # How the model sees a letter beyond ASCII: its bytes, each as a character.
    as_bytes = {c: cut(chr(c))[0][0] for c in range(0xDF, 0x17F) if c not in (0xF7, 0x130)}

    def of_part(part: str) -> bytes:
        ids = [t.id for t in model.tokenize(part)]
        return pack_ids(f"<{len(ids)}I", *ids)

    parts = Recent(of_part, 200_000)

    def of_stretch(stretch: str) -> bytes:
        if "<|" in stretch:  # may be a special token, which is found before anything else
            return np.array(tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes()
        if stretch.isascii() and stretch.isalpha():  # one part, as most are
            return parts[stretch.lower()]
        if printable(stretch):
            return b"".join(map(parts.__getitem__, plain(stretch.lower())))
        if latin(stretch):
            if stretch.isalpha():
                return parts[stretch.lower().translate(as_bytes)]
            return b"".join([parts[p.translate(as_bytes)] for p in plain(stretch.lower())])
        return b"".join([parts[p] for p, _ in cut(normalise(stretch))])

    return Recent(of_stretch, 200_000)


def _pieces(path: str, capacity: int, end_id: int):
    # str.split also cuts at four control characters that are no white space to the tokenizer.
    odd, stretches = re.compile("[\x1c-\x1f]").search, re.compile(r"[^ \t\n\r\x0b\x0c]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = kept(f"word_ids_{path}", lambda: word_ids(path))
        tail, part = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                ids = memoryview(b"".join(map(ids_of.__getitem__, stretches(text) if odd(text) else text.split())) + tail)
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start:4 * (start + capacity)]
                    rows.append((i, start, len(piece) // 4, zlib.crc32(piece), total))
            at, *rest = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), *map(pa.array, rest), pa.array(np.full(len(at), part, np.int32))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"])
    return run


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, [(length, times), ...]) for each pattern, longest lengths first.

    At most two patterns arise for each length, and the distinct lengths of a pattern
    sum to ``capacity`` at most, so the result is bounded whatever the counts are.
    """
    packs: dict[int, list[tuple[int, tuple]]] = {}
    spaces: list[int] = []

    def put(space: int, number: int, pattern: tuple) -> None:
        if not packs.get(space):
            packs[space] = []
            heapq.heappush(spaces, -space)
        packs[space].append((number, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while spaces and not packs.get(-spaces[0]):
                heapq.heappop(spaces)
            if not spaces or -spaces[0] < length:
                put(capacity - length, left, ((length, 1),))
                break
            space = -spaces[0]
            number, pattern = packs[space].pop()
            taken = min(number, left)
            # The same length may fit several times.
            times = min(space // length, max(1, left // number)) if taken == number else 1
            if number > taken:
                packs[space].append((number - taken, pattern))
            put(space - times * length, taken, (*pattern, (length, times)))
            left -= taken * times
    return [(n, list(p)) for groups in packs.values() for n, p in groups]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """For each length and pattern: first rank, packs, first sequence and offset; sorted by length and first rank."""
    rows, next_rank, sequence = [], {}, 0
    for number, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = next_rank.get(length, 0)
            rows.append((length, first, number, sequence, offset))
            next_rank[length] = first + number * times
            offset += length * times
        sequence += number
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "packs", "sequence", "offset"), columns))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents of over ``capacity`` tokens are cut into whole sequences and a rest;
    nothing else is cut. Null and empty texts are the end id alone. Rows are packed as
    they come: repeated rows and null ids are pieces of their own. Columns other than
    doc_id and text are not read. An empty table has no pieces.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = store(source.mapInArrow(_pieces(path, capacity, end_id),
                                     "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int"), "pieces")
    # A count for each task and length: their sums place the ranks of each task.
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "base")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(histogram, capacity), capacity))
    ranked = pieces.withColumn("rank", F.row_number().over(
        Window.partitionBy("part", "length").orderBy("doc_id", "start", "ids_crc32")) - 1).join(bases, ["part", "length"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        by_length = np.searchsorted(s["length"], np.arange(capacity + 2))
        wide = int(s["first"].max(initial=0)) + 1
        keys = s["length"] * wide + s["first"]
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            # Keys are in order, and a rank past a length's last first rank belongs to that last slot.
            slot = np.minimum(np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), "right"), by_length[length + 1]) - 1
            past = rank - s["first"][slot]
            packs = s["packs"][slot]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(s["sequence"][slot] + past % packs),
                 pa.array(s["offset"][slot] + past // packs * length)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(
        frugal(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
