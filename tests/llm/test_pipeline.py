"""The queries against SQL on the smallest tables, and the pipeline stage by stage."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from oracle import compare, connect  # noqa: E402
from tablewright.llm.queries import ORACLES, QUERIES  # noqa: E402
from tablewright.llm.tables import read_table, store  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data_dir, name):
    n, problem = compare(spark, connect(data_dir), data_dir, QUERIES[name], ORACLES[name])
    assert problem is None and n


def test_stages_keep_the_columns_and_only_drop(spark, data_dir):
    docs = read_table(spark, data_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = store(stage(spark, docs, data_dir), name)
        assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        if name != "line_dedup":
            assert after.exceptAll(docs).count() == 0
        docs = after
    packed = corpus_pipeline.pack(spark, docs, data_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_take_an_empty_table(spark, data_dir):
    docs = read_table(spark, data_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data_dir).count() == 0
