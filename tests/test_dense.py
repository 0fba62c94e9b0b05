"""The dense channel against plain products, on both layouts of its grid."""

import numpy as np
import pytest

from papertrellis.operators import lexical


def plain(queries, docs, k):
    out = []
    for q, v in queries:
        scored = []
        for d, w in docs:
            if len(w) == len(v):
                a, b = np.array(v), np.array(w)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(a @ b / n), 8) if n else 0.0, d))
        out += [(q, rank, d, -s + 0.0) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_dense_channel(spark, monkeypatch, small):
    monkeypatch.setattr(lexical, "is_small", lambda df, *a: small)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    monkeypatch.setattr(lexical, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(lexical, "GRID_COLUMNS", 5)
    rng = np.random.default_rng(8)
    docs = [(f"d{i:03d}", rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(90)] + [("e1", [0.0] * 6), ("e2", [1.0, 2.0])]
    queries = [(f"q{i}", rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(11)] + [("z", [0.0] * 6), ("two", [1.0, 1.0]), ("none", [1.0])]
    q = spark.createDataFrame(queries, "query_id string, vector array<double>").repartition(3)
    d = spark.createDataFrame(docs, "entity_id string, vector array<double>").repartition(4)
    out = lexical.dense_channel(q, d, seed_limit=5)
    got = sorted((r["query_id"], r["rank"], r["entity_id"], round(r["raw_score"], 8) + 0.0) for r in out.collect())
    assert got == plain(queries, docs, 5)
    assert lexical.dense_channel(q.limit(0), d).count() == 0 and lexical.dense_channel(q, d.limit(0)).count() == 0
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    more = spark.createDataFrame([(f"m{i}", [1.0] * 6) for i in range(400)], "query_id string, vector array<double>").repartition(3)
    shape = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert shape(lexical.dense_channel(more, d, seed_limit=5)) == shape(out)
