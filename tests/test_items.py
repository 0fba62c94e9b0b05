"""Lists of items: distinct without regard to case."""

import time

from pyspark.sql import functions as F

from papertrellis.functions.relations import distinct_ci


def test_a_long_list_of_items_is_no_square_of_work(spark):
    items = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: F.concat(F.lit(" Item "), (i % 5000).cast("string"))).alias("items"))
    began = time.time()
    found = items.select(distinct_ci(F.col("items")).alias("x")).first()[0]
    assert found == [f"Item {i % 5000}" for i in range(1, 5001)]
    assert time.time() - began < 15
    rows = spark.createDataFrame([(["b", " B", "a", "", "A ", None, "c", "b"],), (None,), ([],)], "x array<string>")
    assert [r[0] for r in rows.select(distinct_ci(F.col("x"))).collect()] == [["b", "a", "c"], None, []]
