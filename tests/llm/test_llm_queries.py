import pytest
from oracle import both

import corpus_pipeline
from flowlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    got, want = both(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert got == want


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(docs.count())
        assert docs.select("doc_id").distinct().count() == kept[-1]
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5


def test_stages_survive_an_empty_table(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
