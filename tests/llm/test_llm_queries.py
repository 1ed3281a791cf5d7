import pytest

import corpus_pipeline
from mnemospark.llm import queries
from oracle import DATA, compare

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.queries()[name], ORACLES[name])


def test_pipeline(spark, tmp_path):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = docs.count()
        if name != "packing":
            assert docs.columns == before.columns
    assert 0 < seen["near_duplicates"] < seen["toxicity"] <= 200
    total = docs.groupBy("doc_id").agg({"doc_tokens": "max"}).count()
    assert total == spark.read.parquet(str(tmp_path / "mixing")).select("doc_id").distinct().count()
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "length").groupBy().sum("length").collect())) == sorted(map(str, docs.groupBy().sum("length").collect()))
