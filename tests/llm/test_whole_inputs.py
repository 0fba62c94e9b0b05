"""Rows that operators once left out: benchmark items without an id, further vectors of an id."""

import collections

import numpy as np

from papertrellis.llm import decontam, neighbours


def test_items_without_an_id_are_searched(spark):
    bench = spark.createDataFrame([(1, "named passage"), (None, "unnamed passage")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "an unnamed passage"), (2, "a named passage, an unnamed passage"), (3, "neither")], "doc_id long, text string")
    windows = decontam.load(bench)
    assert [r["doc_id"] for r in decontam.clean_documents(docs, windows).collect()] == [3]
    marks = lambda **how: {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.scan(docs, windows, **how).collect()}
    assert marks(unnamed=True) == {1: (2, 0, True), 2: (4, 1, True), 3: (0, 0, False)}
    assert marks() == {1: (0, 0, False), 2: (2, 1, True), 3: (0, 0, False)}


def test_all_vectors_of_an_id_take_part(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 6))
    rows = [(i % 40, x.tolist()) for i, x in enumerate(v)]
    usable = neighbours.usable(spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>"))
    assert usable.count() == 60
    got = collections.Counter((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in neighbours.nearest(usable, usable.where("id < 5"), query_rows=3, block_rows=7).collect())
    want = collections.Counter()
    for q in [i for i in range(60) if i % 40 < 5]:
        c = neighbours.cosines(v, np.repeat(v[q:q + 1], 60, 0))
        best = sorted((i for i in range(60) if i != q), key=lambda i: (-c[i], i % 40))[:5]
        want.update((q % 40, k + 1, i % 40, round(float(c[i]), 9)) for k, i in enumerate(best))
    assert got == want
