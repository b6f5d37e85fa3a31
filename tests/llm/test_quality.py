"""Word vectors of the quality classifier against a plain count."""
import numpy as np
import pytest
from pyspark.sql import SparkSession

from ledgermill.llm import quality


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def test_vectors_learn_from_unlabelled_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "TOKENS", 40)
    texts = [None, "", "one", "a a a a", *(f"w{i} w{i + 1} x, w{i % 7} end" for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4, 12)], "doc_id long, quality int")
    base = quality.index_vectors()
    want = base.copy()
    for t in texts:
        x = quality.buckets(t)
        for gap in (1, 2):
            for a, b in zip(x, x[gap:]):
                want[a] += base[b]
                want[b] += base[a]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.train(docs, labels)[0], want, atol=1e-6)
    assert quality.score(docs, labels).count() == len(texts)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
