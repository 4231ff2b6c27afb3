"""Band keys are dealt some hundred to a row, pairs are made once, and wanted lines alone are made normal."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import lines, similar
from tablewright.llm.tables import has_bit, store


def spread(draw, keys):
    return draw.integers(-2**63, 2**63, len(set(keys.tolist())), dtype=np.int64)[np.unique(keys, return_inverse=True)[1]]


def test_packed_rows_hold_all_pairs():
    draw = np.random.default_rng(4)
    for n, buckets in ((0, 3), (1, 1), (2000, 1), (2000, 7), (3000, 100_000)):
        ids, bands = draw.integers(-9, 2**62, n), draw.integers(-2**63, 2**63, n)
        rows = similar.packed(ids, bands, buckets)
        blobs = rows.column(1).to_pylist()
        assert all(0 < len(x) <= 16 * similar.PACK for x in blobs)
        pairs = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
        assert sorted(map(tuple, pairs.tolist())) == sorted(zip(ids.tolist(), bands.tolist()))
        owner = {}
        for bucket, blob in zip(rows.column(0).to_pylist(), blobs):
            assert 0 <= bucket < buckets
            for band in np.frombuffer(blob, np.int64)[1::2].tolist():
                assert owner.setdefault(band, bucket) == bucket


@pytest.mark.parametrize("bucket", [1 << 18, 20])
def test_shared_keys_of_packed_rows(monkeypatch, bucket):
    monkeypatch.setattr(similar, "BUCKET", bucket)
    monkeypatch.setattr(similar, "PACK", 8)
    draw = np.random.default_rng(5)
    for _ in range(300):
        n, buckets = int(draw.integers(1, 300)), int(draw.integers(1, 5))
        bands = draw.integers(0, n // draw.integers(1, 6) + 1, n)
        # One key has a third of all rows.
        bands[draw.random(n) < 1 / 3] = 0
        ids, bands = draw.integers(0, draw.integers(1, 30), n), spread(draw, bands)
        rows = pa.Table.from_batches([similar.packed(ids[a::3], bands[a::3], buckets) for a in range(3)]).sort_by("bucket")
        parts = (x for x in rows.combine_chunks().to_batches(max_chunksize=int(draw.integers(1, 9))))
        found = [pair for part in similar._shared_packed(parts) for pair in zip(*(c.to_pylist() for c in part.columns))]
        assert set(found) == {(i, b) for i, b in zip(ids.tolist(), bands.tolist()) if len(set(ids[bands == b].tolist())) > 1}
        assert bucket == 20 or len(found) == len(set(found))


def test_lines_deal_few_rows(spark, monkeypatch):
    made = []
    monkeypatch.setattr(lines, "shared_packed_bands", lambda rows: made.append(rows.count()) or similar.shared_packed_bands(rows))
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "concat('line number ', id, ' of the table ', sha2(cast(id as string), 256)) as text")
    assert lines.repeated_lines(docs).count() == 0
    # 48,000 band keys.
    assert made == [-(-3000 * lines.BANDS // similar.PACK)]


def test_pairs_are_made_once(spark, monkeypatch):
    made = []
    rows = [(i, band, i, 30, 50, 0, [1, 2], 0) for i in range(30) for band in (1, 2)]
    bands = store(spark.createDataFrame(rows, "id long, band long, component long, _n long, size long, alone long, bands array<long>, mark_0 long"), "met")

    def seen(df, label):
        made.append(df)
        return store(df, label)

    monkeypatch.setattr(similar, "store", seen)
    first, second = ({tuple(r) for r in similar._pairs(bands, a, z, 80).collect()} for a, z in ((0, 8), (8, 30)))
    assert not first & second and first | second == {(a, b) for a in range(30) for b in range(a + 1, 30)}
    # No pair came both ways round, to be merged again.
    assert len(made) == 2 and not any("least(" in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0] for df in made)


def test_wanted_lines_are_normal_as_in_their_texts():
    texts = ["  A  b\t\n\n x\r\n", "", "\n \nÄ  Öl\x0b", " ", "one line  ", "  next", "z\n" * 40 + " last \t one"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array([7] * len(texts)), pa.array(texts), pa.array([3 + 1000 * i for i in range(len(texts))])],
        names=["doc_id", "version", "text", "key"])
    expected = {}
    for at, rows, numbers, data, bounds in lines._lines_of(batch.column(2)):
        for i in np.flatnonzero(np.diff(bounds)):
            expected[int(at + rows[i]), int(numbers[i])] = data[bounds[i]:bounds[i + 1]].tobytes()
    assert len(expected) == 46

    class Bits:
        value = np.full(1 << (lines.BITS - 6), -1, np.int64).view(np.uint64)

    for choose in (lambda places: True, lambda places: places[1] % 2 == 0, lambda places: places[0] == 4, lambda places: False):
        bits = Bits()
        wanted = {k for k in expected if choose(k)}
        bits.value = np.zeros(1 << (lines.BITS - 6), np.uint64)
        for row, number in wanted:
            spot = int(lines._spot(np.array([3 + 1000 * row]), np.array([number]))[0])
            bits.value[spot >> 6] |= np.uint64(1) << np.uint64(spot & 63)
        found = {(r["doc_id"], r["line"]): r for part in lines._contents(bits)([batch]) for r in part.to_pylist()}
        assert wanted <= set(found) and all(r["content"] == expected[k] for k, r in found.items())
        assert all(len(r["signature"]) == 2 * lines.SIGNATURE for r in found.values())
