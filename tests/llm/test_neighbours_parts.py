"""Query blocks go to the candidates in bounded parts; none is repeated for a task."""

import numpy as np
from pyspark.sql import functions as F

from papertrellis.llm import neighbours


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 6)]) for i in range(400)] + [(900, [1.0, 2.0]), (901, [2.0, 1.0]), (950, [1.0, 1.0])]
    return neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))


def test_parts_give_the_same_rows(spark):
    table = vectors(spark)
    asked = table.where(F.col("id") % 50 < 3)
    whole = sorted(map(tuple, neighbours.nearest(table, asked).collect()))
    parts = sorted(map(tuple, neighbours.nearest(table, asked, query_rows=4, block_rows=64, part_bytes=1000).collect()))
    assert whole == parts and len({r[0] for r in whole}) == 27


def test_a_broadcast_holds_query_blocks_once(spark):
    table = vectors(spark)
    plan = neighbours.nearest(table, table.where(F.col("id") % 50 == 0))._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in plan and "Generate" not in plan and "BroadcastHashJoin" in plan
