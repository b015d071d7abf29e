"""What Python workers keep, and what the native operators start."""

import pytest
from pyspark.sql import SparkSession

from lorekeep.llm import decontam, minhash, nbsvm, tokens


def kept():
    return tokens.encoder.cache_info().currsize


@pytest.mark.parametrize("other", [minhash._prints(5), minhash._sets(5)])
def test_a_worker_drops_the_token_cache_for_other_work(other):
    first = tokens.encoder(tokens.vocabulary_path())
    assert tokens.encoder(tokens.vocabulary_path()) is first and kept() == 1
    assert list(other(iter([]))) == [] and kept() == 0


def test_workers_of_a_session_drop_the_token_cache(spark):
    path = tokens.vocabulary_path()

    def filled(batches):
        tokens.encoder(path)
        yield from batches

    def asked(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [tokens.encoder.cache_info().currsize] * batch.num_rows})

    docs = spark.range(64).repartition(8).selectExpr("id AS doc_id", "'a b c ' || id AS text")
    labels = spark.range(64).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    docs.mapInArrow(filled, docs.schema).count()
    assert docs.mapInArrow(asked, "n long").groupBy().max("n").first()[0] == 1
    nbsvm.filter_rows(docs, nbsvm.train(docs, labels), threshold=0.0).count()
    rows = docs.mapInArrow(asked, "n long")
    assert rows.groupBy().sum("n").first()[0] < 64


def test_postings_start_no_python(spark, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("rows from the driver pass through a Python worker")

    docs = spark.sql("SELECT 1 AS doc_id, 'b a b' AS text UNION ALL SELECT 2, NULL")
    terms = spark.sql("SELECT 'b' AS term, 7L AS tid")
    monkeypatch.setattr(SparkSession, "createDataFrame", refused)
    got = {(r.tid, r.pos, r.id) for r in decontam.postings(docs, terms).collect()}
    assert got == {(7, 0, None), (7, 2, None), (None, 3, 1), (None, 0, 2)}
