"""Pairs of authors against plain Python, and what moves for them."""

import time
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from papertrellis.operators import graph


@pytest.mark.parametrize("lists", [256, 3])
def test_coauthors_are_all_pairs(spark, monkeypatch, lists):
    monkeypatch.setattr(graph, "LIST_AUTHORS", lists, raising=False)
    links = [(f"p{p}", f"a{a}") for p in range(6) for a in range(p * p % 7 + 9 * (p == 5))] + [("p5", "a1"), ("p1", "a0"), (None, "a1"), (None, "a2"), ("p2", None)]
    want = {}
    for p in {p for p, _ in links if p}:
        for a, b in permutations([a for q, a in links if q == p and a], 2):
            if a != b:
                want[a, b] = want.get((a, b), 0) + 1
    found = graph.coauthors(spark.createDataFrame(links, "paper_id string, academic_id string"))
    assert {(r[0], r[1]): r[2] for r in found.collect()} == want


def test_links_move_once_to_their_paper(spark):
    links = spark.range(20_000).select(F.expr("cast(id div 2 as string)").alias("paper_id"), F.col("id").cast("string").alias("academic_id"))

    def moved():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before, threshold = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        assert graph.coauthors(links).count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    time.sleep(1)
    assert moved() - before < 3 * 20_000  # the links, and the counts of 10,000 pairs
