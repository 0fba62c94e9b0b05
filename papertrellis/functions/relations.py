"""Helpers for ordered array relations and for numbering without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrellis.session import cut_lineage

# Rows of a range in the two-level numbering below, about.
RANGE_ROWS = 1 << 17


def explode_ids(df: DataFrame, array: str, member: str, pos: str = "pos", keep: list[str] | None = None) -> DataFrame:
    """One row per array member with its position; null members are skipped."""
    cols = keep if keep is not None else [c for c in df.columns if c != array]
    out = df.select(*cols, F.posexplode(array).alias(pos, member))
    return out.where(F.col(member).isNotNull())


def ordered_distinct(df: DataFrame, keys: list[str], member: str, order: list[str], out: str) -> DataFrame:
    """Per key the distinct members as an array, ordered by first occurrence.

    The first aggregation keeps one row per (key, member) and combines on the
    map side, so repeats never reach the collecting task.
    """
    first = df.groupBy(*keys, member).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_at", F.col(member).alias("_m")))), lambda s: s["_m"]
        ).alias(out)
    )


def ordered_list(df: DataFrame, keys: list[str], member: str, order: list[str], out: str) -> DataFrame:
    """Per key all members (repeats kept) as an array in the given order."""
    return df.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(*order, F.col(member).alias("_m")))), lambda s: s["_m"]
        ).alias(out)
    )


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row; the row is broadcast."""
    return df.join(F.broadcast(row), F.lit(True), "left")


def empty_if_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.array().cast("array<string>"))


def distinct_ci(items: Column) -> Column:
    """Stripped, non-empty members of an array, case-insensitively distinct, first spelling kept.

    Equal members are told by sorting, not each against all others, so a long array is no square of work.
    """
    from papertrellis.functions.text import let, strip

    cleaned = F.filter(F.transform(items, strip), lambda x: F.coalesce(x != "", F.lit(False)))
    placed = F.sort_array(F.transform(cleaned, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at"), x.alias("item"))))
    first = let(placed, lambda rows: F.filter(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["key"] != r["key"])))
    ordered = F.sort_array(F.transform(first, lambda r: F.struct(r["at"], r["item"])))
    return F.transform(ordered, lambda r: r["item"])


def dense_ids(df: DataFrame, order: list[str | Column], out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """0-based dense numbering in the order of ``order``, whatever its columns are and however their values are spread.

    Two levels: rows are dealt by sampled splits into ranges of about ``rows`` rows, sorted and kept; the counts of the ranges (one
    number each) give their offsets, and each row adds its place in its range. Rows alike in all of ``order`` are dealt by a hash
    besides, so that not one key fills a range; which of them comes first is left open. ``df`` is computed once.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    kept = cut_lineage(df)
    many = max(1, -(-kept.count() // rows))
    salted = kept.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    laid = salted.repartitionByRange(many, *keys, "_salt").sortWithinPartitions(*keys, "_salt").withColumn("_range", F.spark_partition_id())
    laid = laid.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("_salt")
    offsets = [0]
    if many > 1:
        laid = cut_lineage(laid)
        found = {r[0]: r[1] for r in laid.groupBy("_range").agg(F.count(F.lit(1))).collect()}
        for k in range(max(found, default=0)):
            offsets.append(offsets[-1] + found.get(k, 0))
    start = F.get(F.array(*[F.lit(n).cast("long") for n in offsets]), F.col("_range"))
    return laid.withColumn(out, (start + F.col("_place")).cast("long")).drop("_range", "_place")


def cumulative_histogram(df: DataFrame, value: str, keys: list[str] | None = None, buckets: int = 4096) -> DataFrame:
    """Distinct values in [0, 1] with their count, how many rows lie below them, and the group size.

    Equal values collapse first, with map-side combining; the remaining values
    are cut into ranges of equal width whose totals give each range its offset.
    """
    keys = keys or []
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal"))
    hist = hist.withColumn("_bucket", F.least(F.floor(F.col(value) * buckets), F.lit(buckets - 1)).cast("int"))
    totals = hist.groupBy(*keys, "_bucket").agg(F.sum("n_equal").alias("_total"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = whole.orderBy("_bucket")
    totals = totals.select(
        *keys,
        "_bucket",
        (F.sum("_total").over(upto) - F.col("_total")).alias("_below"),
        F.sum("_total").over(whole).alias("n_all"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    local = F.sum("n_equal").over(inside) - F.col("n_equal")
    return (
        hist.withColumn("_local", local)
        .join(totals, [*keys, "_bucket"])
        .withColumn("n_less", F.col("_below") + F.col("_local"))
        .select(*keys, value, "n_equal", "n_less", "n_all")
    )
