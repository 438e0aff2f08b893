"""The registered queries: SQL where there is some, the pipeline stage by stage."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from capsift.llm import queries
from conftest import SF_DIR
from tools.compare import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    ok, text = compare(spark, connect(SF_DIR), SF_DIR, name)
    assert ok and "types differ" not in text, text


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_keeps_columns_and_drops_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF_DIR)
        assert after.columns == docs.columns, name
        before = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < before.count() <= docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF_DIR)
    assert set(docs.columns) <= set(last.columns) and not last.filter("taken <= 0").count()
