"""Fill-in-middle against a plain version, with odd texts and round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.llm import infill

TEXTS = [
    (1, "one two, three\nfour"), (2, None), (3, ""), (4, " "), (5, "with <P> inside"), (6, "ends in <"), (7, "> begins"), (8, "$1 \\2 ${a}"),
    (9, "日本 é\U0001f600 źx"), (None, "no id at all"), (10, "same"), (10, "same"), (11, "<S"), (12, "S><M"), (13, "a" * 50_000),
    (14, "word, " * 400_000), (15, "\r\n\t\x00\x0b"), (-16, "minus id, some words here"),
] + [(i, f"text {i} <of> some-{i}-units; P> <S <M") for i in range(20, 80)]


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.createDataFrame([(i, t, "keep", "old") for i, t in TEXTS], "doc_id long, text string, form_of string, form string")
    return infill.fill_in_middle(docs.repartition(3)).withColumn("back", infill.restored())


def test_equals_the_plain_version_and_can_be_undone(made):
    rows = made.collect()
    assert len(rows) == len(TEXTS)
    assert made.columns == ["doc_id", "text", "form_of", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_version(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_an_empty_table_and_odd_column_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, `a.b` int, n int")
    assert infill.fill_in_middle(docs).columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert infill.fill_in_middle(docs).count() == 0


def test_no_python_in_the_plan(made):
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange SinglePartition" not in plan


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab <>PSM$\\1\né\U0001f600", max_size=30), min_size=1, max_size=30))
def test_any_text_comes_back(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wrong = infill.fill_in_middle(docs, transformed=100, suffix_first=50).where(infill.restored() != F.col("text"))
    assert wrong.count() == 0
