"""Places of rows within groups of any size: rows dealt by ranges, numbered where they lie, and offsets from the counts of the ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrellis.llm.tables import written

#: Rows of a range, about.
RANGE_ROWS = 1 << 15
_LOW = (1 << 33) - 1


def dealt(df: DataFrame, group: str, order: list[Column], rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with part and at: ranges in the order of group and ``order`` (nulls first), and places in a range. Written, so they are fixed.

    Rows alike in all of these are told apart at random, so that even they fill many ranges. ``df`` is read twice; have it written.
    """
    many = max(1, math.ceil(df.count() / rows))
    keys = [F.col(group), *order, F.col("__salt")]
    laid = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(many, *keys).sortWithinPartitions(*keys)
    return written(laid.drop("__salt").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))), "dealt")


def runs(laid: DataFrame, group: str) -> DataFrame:
    """(part, group, from_at, run, before, total): a row for each group of each range; ``before`` counts the group's rows in earlier ranges."""
    per = laid.groupBy("part", group).agg(F.min("at").alias("from_at"), F.count("*").alias("run"))
    by = Window.partitionBy(group)
    upto = by.orderBy("part")
    return per.select("*", (F.sum("run").over(upto) - F.col("run")).alias("before"), F.sum("run").over(by).alias("total"))


def placed(laid: DataFrame, group_runs: DataFrame, group: str, out: str = "place") -> DataFrame:
    """``laid`` with each row's place in its group, from 0, and the columns of its run."""
    return laid.join(group_runs, ["part", group]).withColumn(out, F.col("at") - F.col("from_at") + F.col("before"))
