"""Line de-duplication moves and cuts no more than it needs, with the results of the plain way."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import lines, queries, similar, text as tx


def test_only_lines_not_met_yet_are_cut_into_shingles(monkeypatch):
    cut, plain = [], lines._shingles
    monkeypatch.setattr(lines, "_shingles", lambda data, bounds: cut.append(data.tobytes()) or plain(data, bounds))
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in
               ("A first line\n\nand  one more", "and one more\nthe third line of all\n a first LINE", "and one more")]
    found = list(lines._banded(iter(batches)))
    assert cut == [b"a first lineand one more", b"the third line of all"]
    assert [len(names) for names, _ in found] == [2, 1]
    # The bands of a line are the same wherever it stands.
    alone = list(lines._banded(iter([pa.RecordBatch.from_arrays([pa.array(["the third line of all"])], names=["text"])])))
    assert found[1][0].tolist() == alone[0][0].tolist() and found[1][1].tolist() == alone[0][1].tolist()


def test_op2_carries_the_new_text_in_the_place_of_the_old_one(spark, tmp_path, monkeypatch):
    rows = [(1, "The same long line here\nand another one"), (2, "x\nthe same long line here!"), (3, None), (4, ""), (None, "x"), (5, "alone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, plain = [], lines.drop_repeated_lines

    def watched(*args, **named):
        seen.append(plain(*args, **named))
        return seen[-1]

    monkeypatch.setattr(lines, "drop_repeated_lines", watched)
    found = {r["doc_id"]: (r["n_dropped"], r["text_sha256"]) for r in queries.QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {1: (0, sha(rows[0][1])), 2: (1, sha("x")), 3: (0, None), 4: (0, sha("")), None: (0, sha("x")), 5: (0, sha("alone"))}
    assert seen[0].columns == ["doc_id", "text", "_dropped"]


@pytest.mark.parametrize("bucket", [4, 1 << 18])
def test_members_of_one_set_are_found_in_packed_rows(monkeypatch, bucket):
    monkeypatch.setattr(similar, "BUCKET", bucket)
    draw = np.random.default_rng(3)
    ids, members = draw.integers(0, 60, 4000), draw.integers(0, 2**32, 1500, dtype=np.uint64)[draw.integers(0, 1500, 4000)]
    # One member of all sets.
    ids, members = np.append(ids, np.arange(60)), np.append(members, np.full(60, 7, np.uint64))
    keys = (members << np.uint64(32)).view(np.int64)
    rows = pa.Table.from_batches([similar.packed(*similar._first_and_last(ids[a::5], keys[a::5]), 3) for a in range(5)]).sort_by("bucket")
    made = [r for batch in similar._alone(iter(rows.combine_chunks().to_batches(max_chunksize=2))) for r in batch.to_pylist()]
    owners = {}
    for i, m in zip(ids.tolist(), members.astype(np.uint32).view(np.int32).tolist()):
        owners.setdefault(m, set()).add(i)
    assert sorted((r["member"], r["id"]) for r in made) == sorted((m, *own) for m, own in owners.items() if len(own) == 1)
    assert list(similar._alone(iter([]))) == []


def test_lines_are_made_normal_as_by_a_pattern():
    draw = np.random.default_rng(9)
    signs = np.array(["a", "B", " ", " ", "\n", "\t", "\r\n", "é", "漢", "😀", "xyz"])
    for _ in range(300):
        texts = ["".join(draw.choice(signs, draw.integers(0, 30))) for _ in range(4)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
        starts, _, _ = tx.lines(data, offsets)
        made, bounds = lines._normal(data, starts, offsets)
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        wanted = [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").translate(lower) for t in texts for x in t.split("\n")]
        assert [made[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])] == wanted
        _, first, end = lines._shingles(made, bounds)
        assert (end - first).tolist() == [max(len(x) - lines.WIDTH + 1, int(bool(x))) for x in wanted]


def test_distinct_values_come_in_order():
    for values in ([], [3], [2, 1, 2, 2**64 - 1, 1]):
        assert tx.distinct(np.array(values, np.uint64)).tolist() == sorted(set(values))
