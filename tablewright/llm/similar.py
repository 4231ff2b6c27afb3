"""Links between near-equal sets and the components they form, without making all pairs of a group.

Items come with band keys. Items that share a band key are candidates. Within a
band key the items already known to be connected need no more pairs, so work goes
in rounds: the first items of a key act as pivots, every item outside a pivot's
component is checked against it, components are joined, and keys whose items are
all in one component are done. The number of pivots grows eightfold each round until
every pair of different components has been checked or joined, and all items are
pivots once few pairs are left. The components
therefore equal those of all candidate pairs, while a group of thousands of copies
costs a few checks for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm import text as tx
from tablewright.llm.tables import discard, frugal, store

PAIR = "a long, b long"
#: Items of one band key that meet its pivots in one group.
PART = 4096
#: So many pairs that share an open key are checked in one round, without pivots first.
EVERY = 1 << 22
#: The same once a round of several pivots has joined what is alike: few of the pairs are left to be made then.
MOST = 1 << 26
#: Edges that one task joins at most when it finishes the components.
LAST = 2_000_000
#: From contents to the sorted distinct 64-bit members of each.
Expand = Callable[[list[bytes]], list[np.ndarray]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b): component is its smallest reachable id.

    Alternates large-star (each node hands its larger neighbours its smallest
    one) and small-star (each node hands its smaller ones) until nothing changes.
    """
    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, last = None, edges
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        met = edges.join(least, "a")
        edges = store(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .union(least.select("a", "m")).distinct(), "edges")
        discard(last)
        last = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                edges.select("b", "b")).distinct()
        before = now


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a task: every end with the smallest one it is joined to there."""
    ends = [np.zeros((2, 0), np.int64)] + [np.stack([batch.column(k).to_numpy() for k in (0, 1)]) for batch in batches]
    edges = np.concatenate(ends, axis=1)
    nodes, where = np.unique(edges, return_inverse=True)
    a, b = where.reshape(edges.shape)
    root = np.arange(len(nodes))
    while len(a):
        # Each root is hung below the smallest root that an edge joins it to; then all paths are cut short.
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["id", "root"])


def union_find(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b), as :func:`connected_components`, by distributed union-find.

    Each task joins its edges to a forest; an end that has roots in several tasks gets the
    smallest, and its other roots are joined to that one in the next round. Edges need no
    common key, so an end with very many edges is dealt over all tasks. What is left of the
    edges goes to one task when LAST of them fit, else they are dealt anew; when a round
    does not halve them, large-star and small-star finish.
    """
    edges = store(edges.where("a <> b").select("a", "b"), "edges")
    left, found = edges.count(), None
    while left:
        dealt = edges.coalesce(1) if left <= LAST else edges.repartition(-(-left // LAST), "a")
        forest = store(dealt.mapInArrow(_forests, "id long, root long"), "forest")
        if left <= LAST:
            # All edges that are left have met: each end is there once, with its smallest.
            discard(edges)
            last = forest.withColumnRenamed("root", "component")
            if found is None:
                return last
            moved = last.toDF("component", "_to")
            return found.join(moved, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
        label = store(forest.groupBy("id").agg(F.min("root").alias("component")), "roots")
        links = store(forest.join(label, "id").where("root <> component").select(F.col("root").alias("a"), F.col("component").alias("b")).distinct(), "edges")
        if found is None:
            found = label
        else:
            moved = label.toDF("component", "_to")
            found = found.join(moved, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
        before, left = left, links.count()
        discard(edges, forest)
        edges = links
        if left > LAST and 2 * left > before:
            moved = connected_components(edges).toDF("component", "_to")
            return found.join(moved, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")) if found is None else found


def verified(pairs: DataFrame, sets: DataFrame, percent: int, least_alike: float, expand: Expand) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union.

    ``sets`` holds id, signature and content, one row per id; ``expand`` makes sorted
    members of contents. A pivot may be in very many pairs: its content is dealt out to
    as many groups as it has 64s of pairs.
    """
    share = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / 64).cast("int").alias("parts"))
    pivots = (share.join(sets.withColumnRenamed("id", "a"), "a")
              .select("a", "signature", "content", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    rest = (pairs.join(share, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
            .join(sets.select(F.col("id").alias("b"), F.col("signature").alias("signature_b"), F.col("content").alias("content_b")), "b"))
    met = rest.join(pivots, ["a", "part"]).select("a", "b", "signature", "content", "signature_b", "content_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Some pairs at a time: the members of a batch's contents take many times the room of the contents.
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            a, b, signature, content, signature_b, content_b = (c.to_pylist() for c in batch.columns)
            ours, theirs = (np.frombuffer(b"".join(c), np.uint16).reshape(len(a), -1) for c in (signature, signature_b))
            near = np.flatnonzero((ours == theirs).sum(axis=1) >= least_alike * ours.shape[1]).tolist()
            # Neighbouring pairs have the same pivot: each content is expanded once.
            known: dict[bytes, int] = {}
            for i in near:
                known.setdefault(content[i], len(known))
                known.setdefault(content_b[i], len(known))
            members = expand(list(known))
            good = []
            for i in near:
                x, y = members[known[content[i]]], members[known[content_b[i]]]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = np.count_nonzero(both[1:] == both[:-1])
                if 100 * common >= percent * (len(x) + len(y) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])

    return met.mapInArrow(frugal(confirm), PAIR)


def outlines(sets: DataFrame, expand: Expand, words: int) -> DataFrame:
    """(id, size, alone, mark_0, ...): members of each set, how many of them are in no other set of ``sets``, and the parities of the others.

    Members are dealt to 64 * ``words`` places; a bit of the marks says whether an odd number of members
    has its place. Two sets differ in at least as many members as their marks differ in
    bits, and besides in those that each has alone. Members are told apart by 32 bits, which can
    make this bound too low, never too high. A member in very many sets is
    combined in the tasks before the shuffle.
    """
    marks = [f"mark_{k}" for k in range(words)]
    sets = sets.select("id", "content")

    def distinct(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[int]]]:
        ids = batch.column(0).to_numpy()
        for at in range(0, len(ids), 256):
            members = expand(batch.column(1).slice(at, 256).to_pylist())
            yield ids[at:at + 256], [tx.distinct((m >> np.uint64(32)).astype(np.uint32)) for m in members], [len(m) for m in members]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, keys, n = [], [], 0
        for batch in batches:
            for ids, members, _ in distinct(batch):
                owners.append(np.repeat(ids, [len(m) for m in members]))
                keys.append(np.concatenate(members).astype(np.uint64) << np.uint64(32))
                n += len(keys[-1])
                if n >= 1 << 20:
                    yield packed(*_first_and_last(np.concatenate(owners), np.concatenate(keys).view(np.int64)), buckets)
                    owners, keys, n = [], [], 0
        if n:
            yield packed(*_first_and_last(np.concatenate(owners), np.concatenate(keys).view(np.int64)), buckets)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, members, sizes in distinct(batch):
                odd = np.stack([np.bincount(m % np.uint32(64 * words), minlength=64 * words) & 1 for m in members]).astype(np.uint8)
                bits = np.packbits(odd, axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes, pa.int64()), *[pa.array(bits[:, k].copy()) for k in range(words)]],
                                                 names=["id", "size", *marks])

    # A set has no more members than its content has bytes.
    buckets = -(-(sets.agg(F.sum(F.octet_length("content"))).first()[0] or 0) // BUCKET) or 1
    dealt = sets.mapInArrow(spread, "bucket long, pairs binary").repartition("bucket").sortWithinPartitions("bucket")
    own = dealt.mapInArrow(frugal(_alone), "id long, member int")
    place = F.col("member").bitwiseAND(64 * words - 1)
    own = own.select("id", F.shiftright(place, 6).alias("_word"), F.expr("shiftleft(1L, member & 63)").alias("_bit")).groupBy("id").agg(
        F.count("*").alias("alone"), *[F.expr(f"bit_xor(if(_word = {k}, _bit, 0L))").alias(f"_own_{k}") for k in range(words)])
    every = sets.mapInArrow(mark, ", ".join(["id long", "size long", *[f"{m} long" for m in marks]]))
    return every.join(own, "id", "left").select(
        "id", "size", F.coalesce("alone", F.lit(0)).alias("alone"),
        *[F.col(m).bitwiseXOR(F.coalesce(F.col(f"_own_{k}"), F.lit(0))).alias(m) for k, m in enumerate(marks)])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, band) in order of band those whose key has another id; rows with the id of a key's first row count once."""
    last, first, told = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, bands = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        begins = np.append(True, bands[1:] != bands[:-1])
        at, key = np.flatnonzero(begins), np.cumsum(begins) - 1
        heads, goes_on = ids[at], last is not None and bool(bands[0] == last)
        if goes_on:
            heads[0] = first
        keep = ids != heads[key]
        shared = np.zeros(len(at), bool)
        shared[key[keep]] = True
        # The first row of a key that goes on came with an earlier batch, and went with one if the key was known to be shared.
        late = int(goes_on and shared[0] and not told)
        keep[at[goes_on:][shared[goes_on:]]] = True
        last, told, first = bands[-1], shared[-1] or (told and goes_on and len(at) == 1), heads[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(heads[:late], ids[keep])), pa.array(np.append(bands[:late], bands[keep]))], names=["id", "band"])


def shared_bands(banded: DataFrame) -> DataFrame:
    """The rows (id, band) of ``banded`` whose band key has another id, in a stored table; some rows that repeat another are left out."""
    # One exchange and one sort, then a scan that holds no key's rows: nearly all keys have one row.
    dealt = banded.select("id", "band").repartition("band").sortWithinPartitions("band")
    return store(dealt.mapInArrow(frugal(_shared), "id long, band long"), "bands")


#: Rows (id, band) of a bucket, and of one packed row of it.
BUCKET, PACK = 1 << 18, 256


def packed(ids: np.ndarray, bands: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, pairs) with up to PACK pairs of id and band key in each row; keys, which are hashes, fall into ``buckets`` ranges."""
    bucket = ((bands.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    pairs, bucket = np.stack([ids[order], bands[order]], axis=1), bucket[order]
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
    size = np.diff(np.append(begins, len(bucket)))
    rows = -(-size // PACK)
    cuts = np.repeat(begins, rows) + PACK * (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows))
    offsets = (16 * np.append(cuts, len(bucket))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts].astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(pairs)])],
        names=["bucket", "pairs"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of rows made by :func:`packed`, in their order, and pairs of each, some at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets, column = batch.column(0).to_numpy(), batch.column(1)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        pairs = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.int64).reshape(-1, 2)
        ends = (offsets - offsets[0]) // 16
        begins = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        for a, z in zip(begins, np.append(begins[1:], len(buckets))):
            yield buckets[a], pairs[ends[a]:ends[z]]


class _Keys:
    """The band keys of a bucket met so far: the first id of each, and whether its row was given out."""

    def __init__(self) -> None:
        self.keys, self.first, self.told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def shared(self, pairs: np.ndarray, more: bool) -> pa.RecordBatch:
        """The rows of ``pairs`` and earlier ones known to share their key only now; the keys are kept if ``more`` pairs follow."""
        pairs = pairs[np.argsort(pairs[:, 1])]
        ids, bands = pairs[:, 0], pairs[:, 1]
        begins = np.append(True, bands[1:] != bands[:-1])
        at, key = np.flatnonzero(begins), np.cumsum(begins) - 1
        own, heads, told = bands[at], ids[at], np.zeros(len(at), bool)
        old = np.zeros(len(at), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            old = self.keys[place] == own
            heads, told = np.where(old, self.first[place], heads), old & self.told[place]
        keep = ids != heads[key]
        found = np.zeros(len(at), bool)
        found[key[keep]] = True
        late = found & ~told
        if more:
            if old.any():
                self.told[place[old]] |= found[old]
            keys = np.concatenate([self.keys, own[~old]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.first = np.concatenate([self.first, heads[~old]])[order]
            self.told = np.concatenate([self.told, found[~old]])[order]
        ids, bands = np.concatenate([heads[late], ids[keep]]), np.concatenate([own[late], bands[keep]])
        order = np.lexsort((ids, bands))
        ids, bands = ids[order], bands[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (bands[1:] != bands[:-1]))[:len(ids)]
        return pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(bands[new])], names=["id", "band"])


def _shared_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows in order of bucket the (id, band) whose key has another id."""
    last, waiting, n, known = None, [], 0, _Keys()
    for bucket, pairs in _unpacked(batches):
        if bucket != last:
            if waiting:
                yield known.shared(np.concatenate(waiting), False)
            last, waiting, n, known = bucket, [], 0, _Keys()
        elif n >= 2 * BUCKET:
            # A bucket with a very frequent key: its rows go as they come, only its keys stay.
            yield known.shared(np.concatenate(waiting), True)
            waiting, n = [], 0
        waiting.append(pairs)
        n += len(pairs)
    if waiting:
        yield known.shared(np.concatenate(waiting), False)


def _first_and_last(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest id of each key, and its key beside each; a key of one id comes once."""
    order = np.argsort(keys)
    ids, keys = ids[order], keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    if not len(at):
        return ids, keys
    first, last, keys = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at), keys[at]
    more = first != last
    return np.concatenate([first, last[more]]), np.concatenate([keys, keys[more]])


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows in order of bucket the ids and members (the upper halves of the keys) whose key has no other id."""
    def made() -> pa.RecordBatch:
        ids, keys = _first_and_last(*np.concatenate(waiting).T)
        order = np.argsort(keys)
        ids, keys = ids[order], keys[order]
        other = np.append(keys[1:] != keys[:-1], True)
        other[1:] &= keys[1:] != keys[:-1]
        return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array((keys[other] >> 32).astype(np.int32))], names=["id", "member"])

    last, waiting, n = None, [], 0
    for bucket, pairs in _unpacked(batches):
        if bucket != last:
            if waiting:
                yield made()
            last, waiting, n = bucket, [], 0
        waiting.append(pairs)
        n += len(pairs)
        if n >= 4 * BUCKET:
            # Members in very many sets: of each, two ids at most stay.
            waiting, n = [np.stack(_first_and_last(*np.concatenate(waiting).T), axis=1)], 0
    if waiting:
        yield made()


def shared_packed_bands(rows: DataFrame) -> DataFrame:
    """:func:`shared_bands` of rows made by :func:`packed`, which Spark deals and sorts by bucket only."""
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return store(dealt.mapInArrow(frugal(_shared_packed), "id long, band long"), "bands")


def _first_pairs(members: DataFrame) -> DataFrame:
    """Each item of a key with the smallest item of the key."""
    low = F.min("id").over(Window.partitionBy("band"))
    return store(members.select(low.alias("a"), F.col("id").alias("b")).where("a <> b").distinct(), "pairs")


def _open(members: DataFrame, components: DataFrame | None, most: int, label: str) -> DataFrame:
    """The (id, band, component, _n) of keys that have over ``most`` items, _n in all, and several components."""
    # A window over narrow rows: joins with the counted keys would make and move all rows twice.
    every = Window.partitionBy("band")
    own = members.select("id", "band")
    if components is None:
        own = own.withColumn("component", F.col("id"))
    else:
        own = own.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    state = own.withColumns({"_low": F.min("component").over(every), "_high": F.max("component").over(every), "_n": F.count("*").over(every)})
    return store(state.where((F.col("_low") < F.col("_high")) & (F.col("_n") > most)).drop("_low", "_high"), label)


def _with_common(open_bands: DataFrame, known: DataFrame) -> DataFrame:
    """The open keys' items, each with its outline and all its open keys, of which there are no more than it has bands."""
    own = open_bands.groupBy("id").agg(F.collect_list("band").alias("bands")).join(known, "id")
    return open_bands.join(own, "id")


def _pairs(open_bands: DataFrame, above: int, upto: int, percent: int) -> DataFrame:
    """Pairs of the items of rank ``above`` + 1 to ``upto`` of each key with the items of other components that follow under it.

    Items before them were pivots earlier, or are in the same round: each pair is made once, with its smaller id as pivot.
    A key with many items is dealt to parts of about PART items, and its pivots to all of them.
    """
    order = Window.partitionBy("band").orderBy("id")
    marks = [c for c in open_bands.columns if c.startswith("mark_")]
    own = ["size", "component", "alone", "bands", *marks]
    parts = F.ceil(F.col("_n") / PART).cast("int")
    chosen = (open_bands.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= upto).where(F.col("_rank") > above)
              .select("band", F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}_a") for c in own]))
    rest = open_bands.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    fits = ((chosen["band"] == rest["band"]) & (chosen["part"] == rest["part"]) & (rest["id"] > F.col("a"))
            & (F.col("component") != F.col("component_a"))
            & (100 * F.least("size", "size_a") >= percent * F.greatest("size", "size_a")))
    # No pair has more in common than either has not alone.
    most = F.least(F.col("size") - F.col("alone"), F.col("size_a") - F.col("alone_a"))
    fits &= 100 * most >= percent * (F.col("size") + F.col("size_a") - most)
    # Nor may it differ in more members than the threshold leaves.
    differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}_a"))) for m in marks), F.col("alone") + F.col("alone_a"))
    fits &= (100 + percent) * differ <= (100 - percent) * (F.col("size") + F.col("size_a"))
    # A pair that shares several keys is made at the first of them only.
    # Not as an equality, which Spark would also put before the cheaper conditions.
    fits &= F.array_min(F.array_intersect("bands", "bands_a")) >= chosen["band"]
    # An item may stand twice under a key.
    return store(chosen.join(rest, fits).select("a", F.col("id").alias("b")).distinct(), "pairs")


def linked(members: DataFrame, sets: DataFrame, percent: int, signature_length: int, expand: Expand, words: int,
           components_of: Callable[[DataFrame], DataFrame] = connected_components) -> DataFrame:
    """(id, component) of every item with a link; component is the smallest id.

    ``members`` are the (id, band) of keys with several items (:func:`shared_bands`), ``sets`` has id, signature
    (uint16 bytes) and content of these items, of which ``expand`` makes the sorted members; both are stored tables. The
    signatures rule out a pair only when they agree less than five standard
    deviations below the threshold.

    After the first round the members that one open item alone has are counted, and the others outlined
    in ``words`` longs (see :func:`outlines`): an item with too many members of its own has no link, and a pair
    that must differ in too many is not made. Near copies just under the threshold mostly fall out here.
    """
    s = percent / 100
    least_alike = s - 5 * (s * (1 - s) / signature_length) ** 0.5
    components, edges, open_bands, known = None, None, None, None
    tried, pivots = 0, 1
    while True:
        met = None if known is None else store(_with_common(open_bands, known), "met")
        pairs = _first_pairs(members) if met is None else _pairs(met, tried, pivots, percent)
        discard(met)
        found = store(verified(pairs, sets, percent, least_alike, expand), "links")
        discard(pairs)
        edges = found if edges is None else edges.union(found)
        if not found.isEmpty():
            discard(components)
            components = store(components_of(edges), "components")
        # A key is done when its items are one component or all of them have been pivots.
        before, open_bands = open_bands, _open(members if known is None else open_bands, components, pivots + 1, "open")
        discard(before)
        tried = pivots
        if known is None:
            if open_bands.isEmpty():
                break
            own = store(sets.select("id", "content").join(open_bands.select("id").distinct(), "id", "left_semi"), "contents")
            known = outlines(own, expand, words)
            known = store(known.where(100 * (F.col("size") - F.col("alone")) >= percent * F.col("size")), "outlines")
            discard(own)
            # Ranks begin anew, as items are gone.
            before, open_bands = open_bands, _open(open_bands.join(known, "id", "left_semi"), components, 1, "open")
            discard(before)
            tried, pivots = 0, 1
        # Each row stands for the pairs with the others of its key.
        n, left, longest = open_bands.agg(F.count("*"), F.sum(F.col("_n") - 1), F.max("_n")).first()
        if not n:
            discard(known)
            break
        pivots = longest if left <= 2 * (EVERY if tried < 8 else MOST) else pivots * 8
    if components is None:
        return members.where("false").select("id", F.col("id").alias("component"))
    return components
