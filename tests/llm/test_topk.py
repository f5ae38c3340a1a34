import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm.topk import top_k


def _brute(rows, k):
    good = [
        (r.vec_id, [math.floor(256 * x) for x in r.embedding])
        for r in rows
        if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)
    ]
    out = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def _got(vectors, k):
    return sorted(tuple(r) for r in top_k(vectors, F.col("vec_id") % 50 == 0, k).collect())


def test_embeddings(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert _got(vectors, 5) == _brute(vectors.collect(), 5)


@pytest.mark.parametrize("block", [4096, 16])
def test_odd_vectors(spark, monkeypatch, block):
    import random

    monkeypatch.setattr("tidemark.llm.topk.BLOCK", block)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 9) for _ in range(6)], 1) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1) for i in range(40)]
    rows += [(50_000, None, 1), (2000, [float("nan")] * 6, 1), (2001, [1.0, None, 1.0], 1), (None, [1.0] * 6, 1)]
    rows += [(2050, [1.0, 2.0], 1), (2051, [], 1), (2052, [float("inf")], 1), (2053, [1e12] * 6, 1), (2100, [0.0] * 6, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    assert _got(vectors, 5) == _brute(vectors.collect(), 5)
    assert top_k(vectors.limit(0), F.lit(True)).count() == 0
    assert len(_got(vectors.filter("vec_id in (0, 3, 7)"), 5)) == 2
