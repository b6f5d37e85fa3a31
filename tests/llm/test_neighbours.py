"""Nearest neighbours against brute force."""
import numpy as np
import pytest
from pyspark.sql import SparkSession

from ledgermill.llm import neighbours


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, query_id long, rank int")


def brute(rows):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            out[i] = [j for _, j in sorted((-(v @ w), j) for j, w in good if j != i and len(w) == len(v))[:20]]
    return out


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 0.0] if i % 3 == 0 else rng.normal(size=3).astype(np.float32).tolist()) for i in range(90)]
    rows += [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [None, 1.0, 2.0]), (180, [float("nan"), 1.0, 1.0]), (200, [float("inf"), 1.0, 1.0]), (220, [3.0, 4.0])]
    got = neighbours.search(table(spark, [(i, v, 0, 7, 7) for i, v in rows]))
    want = brute(rows)
    assert answers(got) == {k: v for k, v in want.items() if v}


def test_recall_over_shards(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 16)).astype(np.float32))]
    got, want = answers(neighbours.search(table(spark, [(i, v, 0, 0, 0) for i, v in rows]), shard=300)), brute(rows)
    assert got.keys() == want.keys()
    assert sum(len(set(got[k]) & set(want[k])) for k in want) >= 0.9 * sum(map(len, want.values()))


def test_empty(spark):
    assert neighbours.search(table(spark, [])).count() == 0
